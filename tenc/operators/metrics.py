"""Scores, grouped by any columns (usually the fold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.session import materialise

SCORE_NAMES = {REGRESSION: "r2", BINARY: "av-prec", MULTICLASS: "accuracy"}
# The names reports show for each task's score.
SCORE_TYPES = {
    REGRESSION: "r2 score",
    BINARY: "average precision score",
    MULTICLASS: "accuracy score",
}


def r2_score(df: DataFrame, y: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """One minus residual over total sum of squares, in one pass; rows without a prediction are in neither sum."""
    by = by or []
    label = F.when(quoted(prediction).isNotNull(), quoted(y).cast("double"))
    error = label - quoted(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.sum(error * error).alias("_sse"),
        (F.var_pop(label) * F.count(label)).alias("_sst"),
        F.count(label).alias("_rows"),
    )
    score = F.when(F.col("_sst") > 0, F.lit(1.0) - F.try_divide("_sse", "_sst"))
    perfect = F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(*by, F.when(F.col("_rows") > 0, F.coalesce(score, perfect)).alias("score"))


def accuracy_score(
    df: DataFrame, y: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    by = by or []
    hit = quoted(y).cast("string").eqNullSafe(quoted(prediction).cast("string"))
    return df.groupBy(*by).agg(F.avg(hit.cast("int")).alias("score"))


def average_precision(
    df: DataFrame, y: str, score: str, by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Sum over distinct scores, highest first, of recall gain times precision.

    Rows with equal scores are combined first. The distinct scores are then written in ranges of
    falling score, so running totals are taken range by range and shifted by the totals of the
    ranges before: no group is sorted in one task.
    """
    by = by or []
    points = df.groupBy(*[quoted(c) for c in by], quoted(score).cast("double").alias("_score")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(quoted(y).cast("double")).alias("_pos")
    )
    n_ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        points.repartitionByRange(n_ranges, *by, F.desc("_score")).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    # At most one row per range and group.
    before = Window.partitionBy(*by).orderBy("_range")
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("_n").alias("_rn"), F.sum("_pos").alias("_rp"))
        .select(
            *[quoted(c).alias(f"_by{i}") for i, c in enumerate(by)],
            F.col("_range").alias("_same_range"),
            (F.sum("_rn").over(before) - F.col("_rn")).alias("_n_before"),
            (F.sum("_rp").over(before) - F.col("_rp")).alias("_pos_before"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("_score"))
    # Null-safe, so that a group without a name keeps its score.
    same = F.col("_range") == F.col("_same_range")
    for i, c in enumerate(by):
        same = same & quoted(c).eqNullSafe(F.col(f"_by{i}"))
    return (
        ranged.join(F.broadcast(offsets), same)
        .withColumns(
            {
                "_seen": F.col("_n_before") + F.sum("_n").over(inside),
                "_hits": F.col("_pos_before") + F.sum("_pos").over(inside),
            }
        )
        .groupBy(*by)
        .agg(
            F.try_divide(
                F.sum(F.col("_pos") * F.col("_hits") / F.col("_seen")), F.sum("_pos")
            ).alias("score")
        )
    )


def score_by_task(
    df: DataFrame, task: str, y: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    metric = {REGRESSION: r2_score, BINARY: average_precision, MULTICLASS: accuracy_score}[task]
    return metric(df, y, prediction, by)
