"""Joins on keys that may hold a large part of all rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.session import materialise

# Rows of one key that a task meets on either side; a key with more is cut into blocks.
BLOCK_ROWS = 2000
# Keys with blocks that may be broadcast; beyond that they are joined by key.
_HOT_KEYS = 200_000


def join_in_blocks(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inner join on ``key``; no task gets more than about ``block_rows`` rows of a key from a side.

    A crowded key's rows are dealt to blocks by their id, and every block of one side meets every
    block of the other in a group of its own. All pairs come out, each once. Columns other than
    ``key`` must differ between the sides.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"), F.lit(0).cast("long").alias("_r")).unionByName(
        right.groupBy(key).agg(F.lit(0).cast("long").alias("_l"), F.count(F.lit(1)).alias("_r"))
    )
    blocks = counts.groupBy(key).agg(
        F.ceil(F.sum("_l") / block_rows).alias("_l_blocks"), F.ceil(F.sum("_r") / block_rows).alias("_r_blocks")
    )
    # A key without rows on one side meets nothing, so it needs no blocks.
    hot = materialise(
        blocks.where((F.least("_l_blocks", "_r_blocks") > 0) & (F.greatest("_l_blocks", "_r_blocks") > 1))
    )
    small = hot.count() <= _HOT_KEYS

    def dealt(side: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        marked = side.join(F.broadcast(hot) if small else hot, key, "left")
        mine = F.pmod(F.xxhash64(id_column), F.coalesce(F.col(f"_{own}_blocks"), F.lit(1)))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"_{other}_blocks"), F.lit(1)) - 1))
        return marked.withColumn(f"_{own}", mine).withColumn(f"_{other}", theirs).drop("_l_blocks", "_r_blocks")

    return (
        dealt(left, left_id, "l", "r")
        .join(dealt(right, right_id, "r", "l"), [key, "_l", "_r"])
        .drop("_l", "_r")
    )
