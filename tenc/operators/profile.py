"""Category profiles. Everything starts from counts by value, so data is aggregated once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted

ONE_HOT_LIMIT = 5000
_CHUNK = 50_000


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` for all the columns, from one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, columns).select("column", "value")


def count_runs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, m``: how many values occur exactly ``n`` times.

    With N rows there are at most about sqrt(2 N) different counts, so what follows is small.
    """
    return (
        value_counts(df, columns)
        .where("value is not null")
        .groupBy("column", "n")
        .agg(F.count(F.lit(1)).alias("m"))
    )


def category_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, categories, largest count, median count, and categories rarer than mean / 5."""
    runs = count_runs(df, columns)
    whole = Window.partitionBy("column")
    marked = runs.withColumns(
        {
            "_rows": F.sum(F.col("n") * F.col("m")).over(whole),
            "_values": F.sum("m").over(whole),
            "_upto": F.sum("m").over(whole.orderBy("n")),
        }
    )
    # The middle positions of the sorted counts (equal when the number of values is odd).
    low = F.floor((F.col("_values") + 1) / 2)
    high = F.floor(F.col("_values") / 2) + 1
    covers = lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("m") < p)
    rare = F.col("n") * 5 * F.col("_values") < F.col("_rows")
    return marked.groupBy("column").agg(
        F.max("_rows").alias("n_rows"),
        F.max("_values").alias("n_categories"),
        F.max("n").alias("n_most_frequent"),
        (
            (F.max(F.when(covers(low), F.col("n"))) + F.max(F.when(covers(high), F.col("n")))) / 2
        ).alias("n_median"),
        F.sum(F.when(rare, F.col("m")).otherwise(0)).alias("n_under_mean5"),
    )


def _ranked_runs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Runs of equal counts with the ranks ``lo`` to ``hi`` they cover, largest count first."""
    descending = Window.partitionBy("column").orderBy(F.desc("n"))
    return (
        count_runs(df, columns)
        .withColumn("hi", F.sum("m").over(descending))
        .withColumn("lo", F.col("hi") - F.col("m") + 1)
        .withColumn("k", F.sum("m").over(Window.partitionBy("column")))
    )


def rank_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, rank, n``: the counts in falling order.

    A run of equal counts is unrolled in chunks, so no single row turns into a huge array.
    """
    chunks = F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _CHUNK))
    )
    first = F.col("lo") + F.col("_chunk") * _CHUNK
    last = F.least(F.col("hi"), first + (_CHUNK - 1))
    return (
        _ranked_runs(df, columns)
        .select("column", "n", "lo", "hi", chunks.alias("_chunk"))
        .select("column", "n", F.explode(F.sequence(first, last)).alias("rank"))
        .select("column", "rank", "n")
    )


def rank_frequency_resampled(df: DataFrame, columns: list[str], points: int = 1000) -> DataFrame:
    """The rank-frequency curve at equidistant points, linear between ranks.

    Point ``i`` sits at rank offset ``i (k - 1) / (points - 1)``. Every run of equal counts works
    out, in whole numbers, which points have their lower or upper neighbour inside it.
    """
    last = points - 1
    steps = F.col("k") - 1
    runs = _ranked_runs(df, columns)
    single = F.col("k") == 1

    def ceil_div(a, b):
        return -F.floor(-a / b)

    lower_from = F.greatest(ceil_div((F.col("lo") - 1) * last, steps), F.lit(0))
    lower_to = F.least(F.floor((F.col("hi") * last - 1) / steps), F.lit(last))
    upper_from = F.when(F.col("lo") == 1, F.lit(0).cast("long")).otherwise(
        F.floor((F.col("lo") - 2) * last / steps) + 1
    )
    upper_to = F.least(F.floor((F.col("hi") - 1) * last / steps), F.lit(last))

    def spread(start, stop, name):
        start = F.when(single, F.lit(0).cast("long")).otherwise(start.cast("long"))
        stop = F.when(single, F.lit(last).cast("long")).otherwise(stop.cast("long"))
        covered = F.when(start <= stop, F.sequence(start, stop))
        return runs.select(
            "column", "k", F.explode(covered).alias("point"), F.col("n").alias(name)
        )

    lower = spread(lower_from, lower_to, "_low")
    upper = spread(upper_from, upper_to, "_high").drop("k")
    share = ((F.col("point") * steps) % F.lit(last)) / F.lit(last)
    return lower.join(upper, ["column", "point"]).select(
        "column",
        "point",
        (F.col("point") / F.lit(last)).alias("x"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("frequency"),
    )


def one_hot_guard(df: DataFrame, columns: list[str], limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """Distinct values per column and whether one-hot encoding is still sensible."""
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.count("value").alias("n_categories"))
        .withColumn("skip_one_hot", F.col("n_categories") > limit)
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of every class and a mark on the most frequent one."""
    counts = df.groupBy(quoted(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per class.
    whole = Window.partitionBy(F.lit(1))
    return counts.select(
        "class",
        "n",
        (F.col("n") / F.sum("n").over(whole)).alias("fraction"),
        (F.col("n") == F.max("n").over(whole)).alias("most_frequent"),
    )


def target_kind(df: DataFrame, target: str) -> DataFrame:
    """``binary``, ``multiclass`` or ``continuous`` from the values of a target column."""
    numeric = dict(df.dtypes)[target] in ("double", "float")
    value = quoted(target)
    broken = F.max((value != F.floor(value)).cast("int")) if numeric else F.lit(0)
    values = df.select(value.alias(target)).where(value.isNotNull()).distinct()
    return values.agg(F.count(F.lit(1)).alias("n_values"), broken.alias("_broken")).select(
        "n_values",
        F.when(F.col("_broken") == 1, "continuous")
        .when(F.col("n_values") <= 2, "binary")
        .otherwise("multiclass")
        .alias("kind"),
    )
