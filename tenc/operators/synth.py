"""Categorical columns drawn given a target, with Zipf-like category frequencies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import MODEL_SEED, key_hash, uniform

_CELLS = 1024
_BROADCAST_CATEGORIES = 100_000


def zipf_pmf(spark: SparkSession, n: int, s: float) -> DataFrame:
    """``category, p`` with ``p`` proportional to ``category ** -s`` for 1 to ``n``."""
    weights = spark.range(1, n + 1).select(
        F.col("id").alias("category"), F.pow(F.col("id").cast("double"), F.lit(-s)).alias("w")
    )
    return weights.select("category", (F.col("w") / weights.agg(F.sum("w")).scalar()).alias("p"))


def dirichlet_weights(
    spark: SparkSession, n_categories: int, classes: list[str], alpha: float, seed: int
) -> DataFrame:
    """``category, class, weight``: class shares per category; its size is set by parameters."""
    drawn = np.random.default_rng(seed).dirichlet([alpha] * len(classes), n_categories)
    rows = [
        (i + 1, c, float(drawn[i, j]))
        for i in range(n_categories)
        for j, c in enumerate(classes)
    ]
    return spark.createDataFrame(rows, "category bigint, class string, weight double")


def category_given_target(
    df: DataFrame, key: str, y: str, n_categories: int, s: float, weights: DataFrame,
    name: str, seed: int = MODEL_SEED,
) -> DataFrame:
    """Add a column of category numbers drawn with replacement given the class of ``y``.

    In class c, category i fills ``round(weight * p_i * rows)`` of the slots to draw from. A
    slot range is looked up through a fixed number of cells, so the join is on equal cells.
    """
    spark = df.sparkSession
    n_rows = df.count()
    sized = (
        weights.join(zipf_pmf(spark, n_categories, s), "category")
        .withColumn("slots", F.bround(F.col("weight") * F.col("p") * n_rows).cast("long"))
        .where("slots > 0")
    )
    per_class = Window.partitionBy("class")
    ranges = sized.withColumns(
        {
            "hi": F.sum("slots").over(per_class.orderBy("category")),
            "total": F.sum("slots").over(per_class),
        }
    ).withColumn("lo", F.col("hi") - F.col("slots"))
    cells = F.explode(
        F.sequence(
            F.floor(F.col("lo") * _CELLS / F.col("total")),
            F.floor((F.col("hi") - 1) * _CELLS / F.col("total")),
        )
    )
    # n_categories * classes plus 1024 rows per class, whatever the data.
    table = ranges.select(
        F.col("class").alias("_class"), cells.alias("_cell"), "lo", "hi",
        F.col("category").cast("int").alias(name),
    )
    totals = ranges.select(F.col("class").alias("_class"), "total").distinct()
    drawn = (
        df.withColumn("_class", quoted(y).cast("string"))
        .join(F.broadcast(totals), "_class", "left")
        .withColumn("_slot", F.floor(uniform(key_hash(key, seed, name)) * F.col("total")))
        .withColumn("_cell", F.floor(F.col("_slot") * _CELLS / F.col("total")))
    )
    return drawn.join(
        F.broadcast(table) if n_categories <= _BROADCAST_CATEGORIES else table,
        (drawn["_class"] == table["_class"])
        & (drawn["_cell"] == table["_cell"])
        & (drawn["_slot"] >= table["lo"])
        & (drawn["_slot"] < table["hi"]),
        "left",
    ).select(*[drawn["`" + c + "`"] for c in df.columns], name)


def categories_given_target(
    df: DataFrame, key: str, y: str, classes: list[str], n_categories: list[int] | int,
    s: list[float] | float, alpha: list[float] | float, count: int, seed: int = MODEL_SEED,
) -> DataFrame:
    """Add ``cat1`` to ``catN``; each setting is one value for all columns or one per column."""
    for i in range(count):
        pick = lambda v, i=i: v[i] if isinstance(v, list) else v
        n = pick(n_categories)
        weights = dirichlet_weights(df.sparkSession, n, classes, pick(alpha), seed + i)
        df = category_given_target(df, key, y, n, pick(s), weights, f"cat{i + 1}", seed)
    return df


# The preset of the generated benchmark table.
RANDOM_PRESET = {
    "n_categories": [100, 10, 3],
    "s": [2.0, 0.5, 0.1],
    "alpha": [0.5, 0.8, 2.0],
    "count": 3,
}
