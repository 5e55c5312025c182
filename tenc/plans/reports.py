"""Reports over long result tables."""

from __future__ import annotations

from collections.abc import Mapping
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.functions.hashing import SPLIT_SEED, key_hash, uniform
from tenc.operators.relate import first_per_key

RUN_GROUP = ["dataset", "encoder", "clf"]
_Z95 = 1.959963984540054


def group_sizes(results: DataFrame) -> DataFrame:
    return results.groupBy(*RUN_GROUP).agg(F.count(F.lit(1)).alias("n"))


def box_summary(results: DataFrame, value: str = "score") -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 interquartile ranges) and outliers."""
    quartiles = results.groupBy(*RUN_GROUP).agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")
    )
    fences = quartiles.select(
        *RUN_GROUP,
        F.col("_q")[0].alias("q1"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        results.join(fences, RUN_GROUP)
        .groupBy(*RUN_GROUP, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
        )
    )


def score_curve(
    results: DataFrame, condition: str, time: str = "threshold", value: str = "score"
) -> DataFrame:
    """Mean score per condition and threshold with a 95 % interval over the folds."""
    half = F.lit(_Z95) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return results.groupBy(condition, time).agg(
        F.avg(value).alias("mean"),
        (F.avg(value) - half).alias("low"),
        (F.avg(value) + half).alias("high"),
        F.count(value).alias("n"),
    )


# How often a row is drawn again: cumulative chances of the Poisson numbers 0, 1, 2, ... of mean one.
POISSON_CUTS = tuple(sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12))


def score_interval(
    results: DataFrame, condition: str, keys: list[str], time: str = "threshold", value: str = "score",
    replicates: int = 1000, level: float = 0.95, seed: int = SPLIT_SEED,
) -> DataFrame:
    """Mean score per condition and threshold with a bootstrap interval: percentiles of the means of ``replicates``.

    In each replicate a row counts a Poisson number of times that follows from a hash of its ``keys`` and the
    replicate (four replicates share a digest), so all of them are sums of one aggregate, and the same
    rows give the same interval on any cluster. A replicate in which a group has no row is left out.
    """
    digests = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)), lambda b: F.struct(b.alias("b"), key_hash(keys, seed, b).alias("h")))
    drawn = results.select(condition, time, F.col(value).alias("_value"), F.inline(digests))
    uniforms = F.array(*[F.struct((F.col("b") * 4 + w).alias("_replicate"), uniform("h", w).alias("_u")) for w in range(4)])
    spread = drawn.select(condition, time, "_value", F.inline(uniforms)).where(F.col("_replicate") < replicates)
    times = sum((F.col("_u") >= c).cast("int") for c in POISSON_CUTS)
    kept = spread.where("_value is not null").select(condition, time, "_value", "_replicate", times.alias("_times"))
    means = kept.groupBy(condition, time, "_replicate").agg(
        F.try_divide(F.sum(F.col("_times") * F.col("_value")), F.sum("_times")).alias("_mean")
    )
    tail = (1 - level) / 2
    bounds = means.groupBy(condition, time).agg(F.percentile("_mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"))
    plain = results.groupBy(condition, time).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (condition, time)]
    return plain.alias("p").join(bounds.alias("b"), same, "left").select(
        F.col(f"p.{condition}"), F.col(f"p.{time}"), "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "n"
    )


def score_range(results: DataFrame, value: str = "score") -> DataFrame:
    return results.agg(
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean")
    )


def filter_runs(runs: DataFrame, conditions: Mapping) -> DataFrame:
    """Keep runs that meet every condition.

    ``clf`` holds when its label contains any of the listed texts, ``encoder`` when it is in the
    list; ``reduction_method`` and ``n_components`` look into ``dimension_reduction``; anything
    else is an equality.
    """
    keep: Column = F.lit(True)
    for name, wanted in conditions.items():
        if name == "clf":
            is_struct = dict(runs.dtypes)["clf"].startswith("struct")
            label = F.col("clf.label") if is_struct else F.col("clf")
            any_of = F.lit(False)
            for text in wanted:
                any_of = any_of | label.contains(text)
            keep = keep & any_of
        elif name == "encoder":
            keep = keep & F.col("encoder").isin(list(wanted))
        elif name in ("reduction_method", "n_components"):
            field = "method" if name == "reduction_method" else "size"
            keep = keep & (F.col(f"dimension_reduction.{field}") == F.lit(wanted))
        else:
            keep = keep & (F.col(name) == F.lit(wanted))
    return runs.where(keep)


def baseline_delta(
    results: DataFrame, by: list[str], baseline: Column, value: str = "score"
) -> DataFrame:
    """Each score minus the baseline's score of the same fold."""
    name = f"{value}_baseline"
    reference = results.where(baseline).select(*by, F.col(value).alias(name))
    return results.join(reference, by, "left").withColumn(
        f"{value}_delta", F.col(value) - F.col(name)
    )


def threshold_percentile(
    results: DataFrame, percentiles: Mapping[int, float], column: str = "threshold"
) -> DataFrame:
    """Replace thresholds 0.0 to 1.0 by the percentile listed for their tenth; 1.0 is 100."""
    listed = {**percentiles, 10: 100}
    pairs = [F.lit(x) for k, v in listed.items() for x in (int(k), float(v))]
    tenth = (F.col(column) * 10).cast("int")
    return results.withColumn(column, F.try_element_at(F.create_map(*pairs), tenth))


def first_results(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Drop repeated results on a column subset, keeping the first by a unique column."""
    return first_per_key(results, keys, order)


def run_attributes(name: Column) -> Column:
    """Attributes in a file name ``key-value_key-value``; only the first dash separates."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.map_from_entries(
        F.transform(
            F.split(last, "_"),
            lambda part: F.struct(
                F.substring_index(part, "-", 1).alias("key"),
                F.when(
                    part.contains("-"), F.substring(part, F.instr(part, "-") + 1, F.length(part))
                )
                .otherwise(F.lit(""))
                .alias("value"),
            ),
        )
    )
