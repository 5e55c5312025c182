"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import saved


def _nearest(edges: DataFrame) -> DataFrame:
    """For every left end, the smallest of its right ends and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all ends of ``edges``.

    ``edges`` has two long columns, ``u`` and ``v``. Every round points the larger neighbours of a
    node at its smallest neighbour, then its smaller ones; the number of rounds grows with
    the logarithm of the longest path. Rounds are written to the shared folder, so a lost
    executor costs no more than the round. Only a count and a checksum reach the driver.
    """
    state, seen = saved(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        ).distinct()
        small = large.join(_nearest(large), "u").select("u", "v", "_m")
        star = small.select("u", F.col("_m").alias("v")).union(
            small.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        )
        state = saved(star.where("u <> v").distinct(), "edges")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    found = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(state.select(F.col("v"), F.col("v"))).distinct()
