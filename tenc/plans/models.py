"""Models by name, with the settings the benchmark compares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.operators.encoders.heldout import fold_of
from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.neighbours import nearest, vote
from tenc.plans.boosting import BoostedModel, Growth, candidates, fit_boosting
from tenc.plans.foldcube import FoldRows
from tenc.plans.linear import LOGISTIC_CS, RIDGE_ALPHAS, LinearFit, fit_logistic, fit_ridge

# The searched settings.
LGBM_GRID = {"stepSize": (0.1, 0.05, 0.5), "numLeaves": (7, 15, 31)}
XGB_GRID = {"stepSize": (0.1, 0.05, 0.3), "maxDepth": (3, 6, 9)}
CV_FOLDS = 3
N_TREES = 100
N_NEIGHBOURS = 5

LINEAR = "L2RegularizedLinearModel"
BOOSTING = "GradientBoosting"
MODEL_NAMES = (LINEAR, BOOSTING, "LGBM", "XGB", "KNN")
# How trees grow where a grid does not say otherwise.
GROWTHS = {
    BOOSTING: Growth(rate=0.1, max_depth=3, by_rows=True),
    "LGBM": Growth(rate=0.1, max_leaves=31, min_rows=20, min_curve=1e-3),
    "XGB": Growth(rate=0.3, max_depth=6, ridge=1.0, min_curve=1.0),
}

_FEATURES, _LABEL, _FOLD = "features", "label", "_cv_fold"


def _linear_prediction(fit: LinearFit):
    """The prediction, class-1 probability or number of the class of a vector by the model of the first fold."""
    x = vector_to_array(_FEATURES)

    def margin(output: int):
        weights = F.array(*[F.lit(float(w)) for w in fit.weights[0, output]])
        return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(fit.intercepts[0, output])), lambda s, v: s + v)

    if fit.task == REGRESSION:
        return margin(0)
    if fit.task == BINARY:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(0)))
    margins = F.array(*[margin(c) for c in range(fit.weights.shape[1])])
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("double")


def _boosted_prediction(model: BoostedModel):
    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(model.predict(np.stack(x.to_numpy())))

    return predict(vector_to_array(_FEATURES))


def _train_boosting(rows: DataFrame, name: str, task: str, labels: tuple[str, ...], trees: int, grid) -> BoostedModel:
    chosen = {BOOSTING: {}, "LGBM": grid or LGBM_GRID, "XGB": grid or XGB_GRID}[name]
    x = rows.select(F.col(_LABEL).alias("label"), F.col(_FOLD).alias("part"), vector_to_array(_FEATURES).alias("x"))
    outputs = len(labels) if task == MULTICLASS and len(labels) > 2 else 1
    # Two classes under names are a single margin as well.
    kind = BINARY if task == MULTICLASS and outputs == 1 else task
    return fit_boosting(x, kind, outputs, candidates(GROWTHS[name], chosen), trees, task == BINARY and name == "LGBM")


def _train_linear(rows: DataFrame, task: str, labels: tuple[str, ...], penalties) -> LinearFit:
    """Fit on the vectors as they are; ``rows`` has the label and the number of the inner fold."""
    vectors = rows.select(
        F.col(_LABEL).alias("label"), F.col(_FOLD).alias("part"), vector_to_array(_FEATURES).alias("shared"),
        F.array(F.lit(False)).alias("test"),
    )
    first = vectors.select(F.size("shared")).first()
    if first is None:
        raise ValueError("no rows to train on")
    data = FoldRows(vectors, 1, first[0], (), labels)
    if task == REGRESSION:
        return fit_ridge(data, penalties or RIDGE_ALPHAS, scale=False)
    return fit_logistic(data, penalties or LOGISTIC_CS, balanced=task == BINARY, scale=False)


@dataclass(frozen=True)
class FittedModel:
    """A trained model; ``predict`` adds ``prediction`` (and ``score`` for two classes)."""

    name: str
    task: str
    model: BoostedModel | LinearFit | None
    labels: tuple[str, ...]
    train: DataFrame | None = None
    key: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` without its vector, plus ``prediction`` (the class-1 score for two classes).

        Columns go through the model under plain names; raw names may hold dots.
        """
        kept = [c for c in df.columns if c != _FEATURES]
        plain = {c: f"c{i}" for i, c in enumerate(kept)}
        x = df.select(_FEATURES, *[quoted(c).alias(p) for c, p in plain.items()])
        if self.name == "KNN":
            out = self._predict_nearest(x, plain[self.key])
        elif self.name == LINEAR:
            out = x.withColumn("prediction", _linear_prediction(self.model))
        else:
            out = x.withColumn("prediction", _boosted_prediction(self.model))
        prediction = F.col("prediction")
        if self.task == MULTICLASS:
            if isinstance(self.model, BoostedModel) and self.model.task == BINARY:
                prediction = (prediction > 0.5).cast("int")
            names = F.array(*[F.lit(c) for c in self.labels])
            prediction = F.get(names, prediction.cast("int"))
        return out.select(
            *[F.col(p).alias(c) for c, p in plain.items()], prediction.alias("prediction")
        )

    def _predict_nearest(self, x: DataFrame, key: str) -> DataFrame:
        vectors = lambda d: d.withColumn("_v", vector_to_array(_FEATURES))
        train = vectors(self.train).withColumnRenamed("_key", key)
        found = nearest(train, vectors(x), key, "_v", _LABEL, N_NEIGHBOURS)
        # For two classes the score is the share of neighbours in class 1: their mean.
        task = MULTICLASS if self.task == MULTICLASS else REGRESSION
        return x.join(vote(found, task).withColumnRenamed("query", key), key)


def train_model(
    df: DataFrame, name: str, task: str, y: str, key: str, trees: int = N_TREES,
    penalties: tuple[float, ...] | None = None, grid: dict | None = None,
) -> FittedModel:
    """Train on a table with ``features``; folds of a search follow the row key.

    Nothing is drawn at random, so there is no seed: the same rows give the same model.
    """
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown model {name!r}, expected one of {MODEL_NAMES}")
    labels: tuple[str, ...] = ()
    rows = df.select(quoted(key).alias("_key"), quoted(y).alias("_y"), _FEATURES)
    if task == MULTICLASS:
        text = rows.withColumn("_y", F.col("_y").cast("string"))
        indexer = StringIndexer(
            inputCol="_y", outputCol=_LABEL, stringOrderType="alphabetAsc"
        ).fit(text)
        labels = tuple(indexer.labels)
        rows = indexer.transform(text)
    else:
        rows = rows.withColumn(_LABEL, F.col("_y").cast("double"))
    if name == "KNN":
        return FittedModel(name, task, None, labels, rows, key)
    rows = rows.withColumn(_FOLD, fold_of("_key", CV_FOLDS))
    if name == LINEAR:
        return FittedModel(name, task, _train_linear(rows, task, labels, penalties), labels)
    return FittedModel(name, task, _train_boosting(rows, name, task, labels, trees, grid), labels)
