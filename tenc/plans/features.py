"""From a prepared table to a feature vector: one action per column, in schema order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from tenc.functions.cleaning import quoted
from tenc.operators.encoders.plain import one_hot_stages
from tenc.operators.prepare import DELETE, ONE_HOT, resolve_roles
from tenc.operators.profile import one_hot_guard
from tenc.operators.scaling import fit_vector_scaling
from tenc.plans.registry import ENCODERS, Encoding, resolve

_RAW = "_assembled"


@dataclass(frozen=True)
class FeatureModel:
    """Fitted column actions, the assembler and the scaler.

    Columns travel under plain positional names (``x0``, ``x1``, ...) between the steps, since
    raw column names may hold dots and blanks that vector stages do not accept.
    """

    inputs: dict[str, str]
    encodings: dict[str, Encoding]
    vector_stages: list[Transformer]
    scaler: Transformer | None = None
    output: str = "features"

    @property
    def size(self) -> int:
        return len(self.scaler.getScalingVec())

    def _assembled(self, df: DataFrame, training: bool) -> DataFrame:
        kept = df.columns
        df = df.select(
            *[quoted(c) for c in kept],
            *[quoted(c).alias(x) for c, x in self.inputs.items()],
        )
        for encoding in self.encodings.values():
            own = getattr(encoding, "apply_training", None) if training else None
            df = (own or encoding.apply)(df, suffix="_enc")
        for stage in self.vector_stages:
            df = stage.transform(df)
        return df.select(*[quoted(c) for c in kept], _RAW)

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Add the scaled feature vector; ``training`` marks the rows the model was fitted on."""
        return self.scaler.transform(self._assembled(df, training)).drop(_RAW)


def fit_features(
    df: DataFrame, roles: Mapping[str, str], encoder: str, task: str, y: str, key: str,
    one_hot_limit: int | None = None, output: str = "features",
) -> FeatureModel:
    """Fit every column's action on training rows, then the scaling of the whole vector."""
    columns = resolve_roles(roles)
    actions = {c: resolve(roles[c], encoder) for c in columns.features}
    used = {c: a for c, a in actions.items() if a != DELETE}
    if not used:
        raise ValueError("no feature column is left")
    inputs = {c: f"x{i}" for i, c in enumerate(used)}
    named = df.select(
        *[quoted(c) for c in df.columns], *[quoted(c).alias(x) for c, x in inputs.items()]
    )
    hot = [inputs[c] for c, a in used.items() if a in ONE_HOT]
    if hot and one_hot_limit is not None:
        wide = one_hot_guard(named, hot, one_hot_limit).where("skip_one_hot").collect()
        if wide:
            raise ValueError(f"too many categories for one-hot encoding: {[r[0] for r in wide]}")
    encodings: dict[str, Encoding] = {}
    slots: list[str] = []
    for c, action in used.items():
        x = inputs[c]
        if action in ONE_HOT:
            slots.append(x + "_onehot")
        elif action in ENCODERS:
            encodings[x] = ENCODERS[action].fit(named, x, y, task, key)
            stats = getattr(encodings[x], "stats", None) or encodings[x].encoding.stats
            slots += stats.output_names(x, "_enc")
        else:
            slots.append(x)
    vector_stages: list[Transformer] = []
    if hot:
        indexer, one_hot = one_hot_stages(hot)
        model = indexer.fit(named)
        vector_stages += [model, one_hot.fit(model.transform(named))]
    vector_stages.append(VectorAssembler(inputCols=slots, outputCol=_RAW, handleInvalid="error"))
    draft = FeatureModel(inputs, encodings, vector_stages, output=output)
    scaler = fit_vector_scaling(draft._assembled(df, training=True), _RAW, output)
    return FeatureModel(inputs, encodings, vector_stages, scaler, output)
