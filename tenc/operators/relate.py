"""Joins, anti joins, unions and duplicate removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted


def composite_key(*names: str) -> Column:
    """One text key from several columns."""
    return F.concat(*[quoted(n).cast("string") for n in names])


def left_join_suffixed(
    left: DataFrame, right: DataFrame, on: list[str], left_suffix: str, right_suffix: str,
    required: list[str] | None = None,
) -> DataFrame:
    """Left join; names on both sides get suffixes; rows lacking a required field are dropped.

    The final filter rejects nulls of the right side, so the optimiser runs an inner join.
    """
    shared = (set(left.columns) & set(right.columns)) - set(on)

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *[quoted(c).alias(c + suffix) if c in shared else quoted(c) for c in df.columns]
        )

    joined = renamed(left, left_suffix).join(renamed(right, right_suffix), on, "left")
    return joined.dropna(subset=required) if required else joined


def union_tagged(parts: dict[str, DataFrame], columns: list[str], tag: str) -> DataFrame:
    """Append tables that share columns, each marked with its name."""
    tagged = [
        df.select(*[quoted(c) for c in columns]).withColumn(tag, F.lit(name))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows that agree on ``keys``, the one with the smallest ``order`` (a unique column).

    Only the order column is aggregated, so hot keys shrink before the shuffle and no wide row is
    held or sorted; the rows are then picked by their order, which is unique.
    """
    firsts = df.groupBy(*[quoted(k) for k in keys]).agg(F.min(quoted(order)).alias("_first"))
    return df.join(firsts.select("_first"), quoted(order).eqNullSafe(F.col("_first")), "left_semi")


def unseen_values(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that ``known`` does not hold."""
    values = df.select(quoted(column).alias("value")).where("value is not null").distinct()
    return values.join(known.select(quoted(column).alias("value")), "value", "left_anti")


def pending(grid: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a run grid that no finished run equals on every parameter."""
    return grid.join(finished.select(*keys).distinct(), keys, "left_anti")
