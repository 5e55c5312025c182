"""Per-category target statistics: one aggregation, written once, shared by all encoders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.session import scratch_path

REGRESSION = "regression"
BINARY = "binary-clf"
MULTICLASS = "multiclass-clf"
TASKS = (REGRESSION, BINARY, MULTICLASS)


@dataclass(frozen=True)
class FeatureMeta:
    """Totals of one feature: rows, observed categories, bytes of its table and largest row."""

    name: str
    n_rows: int
    k: int
    table_bytes: int
    row_bytes: int


@dataclass(frozen=True)
class CategoryStats:
    """Fitted state: ``category, n, sums`` per feature as files, totals on the driver.

    ``sums`` has one entry per class (the number of rows of that class) for multiclass targets
    and a single entry (the sum of y) otherwise.
    """

    spark: SparkSession
    path: str
    task: str
    features: tuple[FeatureMeta, ...]
    classes: tuple[str, ...]
    priors: tuple[float, ...]

    @property
    def outputs(self) -> int:
        return len(self.priors)

    def feature(self, name: str) -> FeatureMeta:
        return next(f for f in self.features if f.name == name)

    def table(self, name: str) -> DataFrame:
        """``category, n, sums`` of one feature; missing values are not a category."""
        index = [f.name for f in self.features].index(name)
        files = self.spark.read.schema(_schema(self.task))
        raw = files.parquet(f"{self.path}/feature={index}").where("category is not null")
        if self.task != MULTICLASS:
            return raw.select("category", "n", F.array("s").alias("sums"))
        filled = [
            F.coalesce(F.try_element_at("s", F.lit(c)), F.lit(0)).cast("double")
            for c in self.classes
        ]
        return raw.select("category", "n", F.array(*filled).alias("sums"))

    def output_names(self, name: str, suffix: str) -> list[str]:
        """Encoded column names of a feature: one, or one per class in sorted order."""
        if self.task != MULTICLASS:
            return [name + suffix]
        return [f"{name}{suffix}_{c}" for c in self.classes]

    @cached_property
    def prior_array(self) -> Column:
        return F.array(*[F.lit(p) for p in self.priors])


def _schema(task: str) -> str:
    """Columns of the stored statistics; ``s`` is a sum, or rows by class."""
    return f"category string, n bigint, s {'map<string,bigint>' if task == MULTICLASS else 'double'}"


def fit_stats(
    df: DataFrame, columns: list[str], y: str, task: str = BINARY, path: str | None = None
) -> CategoryStats:
    """Count rows and add up y per category for all columns in one scan.

    Rows are combined before the shuffle, so a category with a third of all rows travels as one
    partial sum per task. The result is written to shared storage: fitting ends here, and every
    later use reads a table of one row per category. Rows whose target is missing do not count.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, expected one of {TASKS}")
    spark = df.sparkSession
    path = path or scratch_path(spark, "stats")
    target = quoted(y).cast("string") if task == MULTICLASS else quoted(y).cast("double")
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("feature"), quoted(c).cast("string").alias("category"))
            for i, c in enumerate(columns)
        ]
    )
    # A row without a target says nothing about its categories.
    long = df.select(target.alias("_y"), F.inline(pairs)).where("_y is not null")
    if task == MULTICLASS:
        per_class = long.groupBy("feature", "category", "_y").agg(F.count(F.lit(1)).alias("n"))
        grouped = per_class.groupBy("feature", "category").agg(
            F.sum("n").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("_y", "n"))).alias("s"),
        )
    else:
        grouped = long.groupBy("feature", "category").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")
        )
    grouped.write.partitionBy("feature").mode("overwrite").parquet(path)
    return _describe(spark, path, columns, task)


def _describe(spark: SparkSession, path: str, columns: list[str], task: str) -> CategoryStats:
    """Read the totals back: one row per feature, and one row per class."""
    written = spark.read.schema(_schema(task) + ", feature int").parquet(path)
    totals = written.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.count("category").alias("k"),
        F.sum(F.octet_length("category")).alias("key_bytes"),
        F.max(F.octet_length("category")).alias("longest"),
        *([] if task == MULTICLASS else [F.sum("s").alias("s")]),
    )
    rows = {r["feature"]: r for r in totals.collect()}
    n_rows = rows[0]["n_rows"] if rows else 0
    if task == MULTICLASS:
        # One class is one output column, so the classes always fit on the driver.
        by_class = (
            written.where("feature = 0")
            .select(F.explode("s").alias("label", "n"))
            .groupBy("label")
            .agg(F.sum("n").alias("n"))
            .orderBy("label")
            .collect()
        )
        classes = tuple(r["label"] for r in by_class)
        priors = tuple(r["n"] / n_rows for r in by_class)
    else:
        classes = ()
        priors = (rows[0]["s"] / n_rows,) if n_rows else (0.0,)
    width = 64 + 16 * len(priors)
    features = tuple(
        FeatureMeta(
            c,
            n_rows,
            rows[i]["k"] if i in rows else 0,
            (rows[i]["key_bytes"] or 0) + width * rows[i]["k"] if i in rows else 0,
            (rows[i]["longest"] or 0) + width if i in rows else 0,
        )
        for i, c in enumerate(columns)
    )
    return CategoryStats(spark, path, task, features, classes, priors)
