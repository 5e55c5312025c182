"""Folds, runs and grids of runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import SAMPLE_SEED, SPLIT_SEED
from tenc.operators.encoders.stats import BINARY, REGRESSION
from tenc.operators.metrics import score_by_task
from tenc.operators.prepare import ONE_HOT, prepare, resolve_roles
from tenc.operators.rank import first_by_hash
from tenc.operators.relate import pending
from tenc.operators.splits import SplitPlan, marked_split, plan_shuffle_split, plan_stratified_split
from tenc.plans import foldcube
from tenc.plans.features import fit_features
from tenc.plans.linear import LOGISTIC_CS, RIDGE_ALPHAS, fit_logistic, fit_ridge, fold_scores
from tenc.plans.models import LINEAR, train_model
from tenc.session import materialise, written
from tenc.sources.runs import RESULT_FIELDS, RUN_SCHEMA, parameter_key, read_runs, write_runs

@dataclass(frozen=True)
class Dataset:
    """A cleaned table with its roles, task and row key."""

    name: str
    task: str
    roles: Mapping[str, str]
    key: str
    load: Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Settings:
    n_splits: int = 20
    test_size: float = 1 / 3
    normalise: bool = True
    # Above so many categories a one-hot run is skipped; None never skips.
    one_hot_limit: int | None = None
    # Training rows of a fold that the model is fitted on; None means all. Encodings, scores and
    # splits always use all rows.
    fit_rows: int | None = None
    model: Mapping = field(default_factory=dict)


def make_split(df: DataFrame, dataset: Dataset, settings: Settings) -> SplitPlan:
    """Plain repeated splits for regression, stratified ones for classes."""
    if dataset.task == REGRESSION:
        return plan_shuffle_split(df, dataset.key, settings.n_splits, settings.test_size)
    y = resolve_roles(dataset.roles).target
    return plan_stratified_split(df, dataset.key, y, settings.n_splits, settings.test_size)


def prepare_folds(spark: SparkSession, dataset: Dataset, settings: Settings) -> tuple[DataFrame, SplitPlan]:
    """The prepared rows, written with the marks of their folds, and the split."""
    prepared = written(prepare_rows(spark, dataset, settings), "prepared-rows")
    if settings.n_splits < 1:
        return prepared, make_split(prepared, dataset, settings)
    y = None if dataset.task == REGRESSION else resolve_roles(dataset.roles).target
    split, marked = marked_split(
        prepared, dataset.key, settings.n_splits, settings.test_size, y=y, name=foldcube.MARKS
    )
    return marked, split


def run_fold(
    prepared: DataFrame, split: SplitPlan, fold: int, dataset: Dataset, encoder: str, model: str,
    settings: Settings,
) -> dict[str, float]:
    """Encode, scale, train and score one fold; the clocks stop after the work is done."""
    y = resolve_roles(dataset.roles).target
    train = prepared.where(~split.is_test(fold))
    test = prepared.where(split.is_test(fold))

    start = time.time()
    features = fit_features(
        train, dataset.roles, encoder, dataset.task, y, dataset.key, settings.one_hot_limit
    )
    used = [quoted(dataset.key), quoted(y), F.col(features.output)]
    train_x = materialise(features.transform(train, training=True).select(*used))
    encoding_time = time.time() - start

    start = time.time()
    fitted_on = train_x
    if settings.fit_rows is not None:
        fitted_on = first_by_hash(train_x, dataset.key, settings.fit_rows)
    fitted = train_model(fitted_on, model, dataset.task, y, dataset.key, **settings.model)
    training_time = time.time() - start

    def score(x: DataFrame) -> float:
        predicted = fitted.predict(x)
        return score_by_task(predicted, dataset.task, y, "prediction").first()["score"]

    return {
        "fold": float(fold),
        "n_train_samples": float(train_x.count()),
        "n_train_features": float(features.size),
        "score": score(features.transform(test).select(*used)),
        "train_score": score(train_x),
        "encoding_time": encoding_time,
        "training_time": training_time,
    }


def run_folds(
    prepared: DataFrame, split: SplitPlan, dataset: Dataset, encoder: str, model: str, settings: Settings
) -> list[dict[str, float]]:
    """All folds. Linear models of all folds are trained together where the encoder allows it.

    Then the clocks stop after all folds, and each fold has an equal part of the time.
    """
    y = resolve_roles(dataset.roles).target
    together = model == LINEAR and settings.fit_rows is None and set(settings.model) <= {"penalties"}
    start = time.time()
    data = None
    if together:
        data = foldcube.build(
            prepared, split, dataset.roles, encoder, dataset.task, y, dataset.key, settings.one_hot_limit
        )
    if data is None:
        return [run_fold(prepared, split, i, dataset, encoder, model, settings) for i in range(split.n_splits)]
    encoding_time = (time.time() - start) / split.n_splits

    start = time.time()
    penalties = settings.model.get("penalties")
    if dataset.task == REGRESSION:
        fit = fit_ridge(data, penalties or RIDGE_ALPHAS)
    else:
        fit = fit_logistic(data, penalties or LOGISTIC_CS, balanced=dataset.task == BINARY)
    training_time = (time.time() - start) / split.n_splits
    train, test = fold_scores(data, fit)
    return [
        {
            "fold": float(i),
            "n_train_samples": float(fit.n_train[i]),
            "n_train_features": float(fit.n_features[i]),
            "score": float(test[i]),
            "train_score": float(train[i]),
            "encoding_time": encoding_time,
            "training_time": training_time,
        }
        for i in range(split.n_splits)
    ]


def _parameters(dataset: Dataset, encoder: str, model: str, settings: Settings) -> dict:
    """Everything that identifies a run, in the stored form."""
    text = {k: json.dumps(v) for k, v in settings.model.items()}
    return {
        "dataset": dataset.name,
        "n_splits": settings.n_splits,
        "test_size": float(settings.test_size),
        "n_rows": -1 if settings.fit_rows is None else settings.fit_rows,
        "encoder": encoder,
        "str_preprocess": settings.normalise,
        "clf": Row(label=model, name=model, params=text),
        "ShuffleSplit": [
            "ShuffleSplit" if dataset.task == REGRESSION else "StratifiedShuffleSplit"
        ],
        "scaler": Row(name="StandardScaler", params={"with_mean": "false"}),
        "sample_seed": SAMPLE_SEED,
        "shuffleseed": SPLIT_SEED,
        "col_action": dict(dataset.roles),
        "clf_type": dataset.task,
        "results": None,
    }


def _records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    ordered = [tuple(r[f.name] for f in RUN_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(ordered, RUN_SCHEMA)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], RUN_SCHEMA)
    return read_runs(spark, path)


def run_grid(
    spark: SparkSession, datasets: list[Dataset], encoders: list[str], models: list[str],
    path: str, settings: Settings | None = None,
) -> DataFrame:
    """Run every combination that is not stored yet and append its record.

    Returns one row per combination with ``status`` (``done``, ``stored``, ``skipped`` or
    ``failed``) and a message. A failing run does not stop the others. Each run is a series of
    Spark jobs; the driver only goes through the list of combinations.
    """
    settings = settings or Settings()
    combinations = [
        (d, e, m, _parameters(d, e, m, settings)) for d in datasets for e in encoders for m in models
    ]
    grid = parameter_key(_records(spark, [c[3] for c in combinations]))
    keys = ["run_key"]
    finished = parameter_key(_stored(spark, path).select(*[f.name for f in RUN_SCHEMA.fields]))
    # One row per combination of the grid.
    todo = {
        (r["dataset"], r["encoder"], r["clf"]["label"])
        for r in pending(grid, finished, keys).select("dataset", "encoder", "clf").collect()
    }
    outcome = []
    ready: dict[str, tuple[DataFrame, SplitPlan]] = {}
    for dataset, encoder, model, parameters in combinations:
        label = (dataset.name, encoder, model)
        if label not in todo:
            outcome.append((*label, "stored", ""))
            continue
        try:
            if dataset.name not in ready:
                # The encoders of a dataset share the marks of its folds.
                ready[dataset.name] = prepare_folds(spark, dataset, settings)
            prepared, split = ready[dataset.name]
            if _too_wide(prepared, dataset, encoder, settings):
                outcome.append((*label, "skipped", "too many categories for one-hot encoding"))
                continue
            folds = run_folds(prepared, split, dataset, encoder, model, settings)
            results = Row(*RESULT_FIELDS)(*[[f[c] for f in folds] for c in RESULT_FIELDS])
            write_runs(_records(spark, [{**parameters, "results": results}]).coalesce(1), path)
            outcome.append((*label, "done", ""))
        except Exception as error:  # noqa: BLE001
            outcome.append((*label, "failed", f"{type(error).__name__}: {error}"[:500]))
    return spark.createDataFrame(
        outcome, "dataset string, encoder string, clf string, status string, message string"
    )


def prepare_rows(spark: SparkSession, dataset: Dataset, settings: Settings) -> DataFrame:
    return prepare(
        dataset.load(spark), dataset.roles, dataset.key, normalise=settings.normalise
    )


def _too_wide(prepared: DataFrame, dataset: Dataset, encoder: str, settings: Settings) -> bool:
    special = resolve_roles(dataset.roles).special
    if settings.one_hot_limit is None or encoder not in ONE_HOT or special is None:
        return False
    distinct = prepared.select(quoted(special)).distinct().count()
    return distinct > settings.one_hot_limit
