"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks of equal size. A block has a release time and a
deadline that follow from its number and the source's target weight; in every slot the
released block with the earliest deadline runs. At any slot the blocks a source has had then
differ from its weight's share by less than one, as long as no source is used up.

``mixed`` takes release times and deadlines from the exact weights: the driver schedules all blocks,
a number of some bytes each, and documents join the order of their block. ``positions`` rounds: there,
weights become whole numbers of slots in a period. The schedule of one period, a small table, is
found by folding over its slots and repeats itself, so a document's slot is arithmetic on its
running total. Running totals are taken bucket by bucket in the order of a hash of the key, and
shifted by bucket offsets; a source of any size is spread over many tasks.

A missing source counts as the empty name. Rows of equal key keep their number; missing lengths
count as empty texts. No row is dropped: when a source is used up, its slots stay empty.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenc.llm.common import attach, saved

# Characters of a block, slots of a period, and how weights follow the sources' sizes by default.
BLOCK_CHARS = 65_536
PERIOD = 1024
TEMPERATURE = 0.5


def default_weights(docs: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """``source`` and ``weight``: the source's characters to the power of ``temperature``."""
    return sized(docs).groupBy("source").agg(F.sum("size").alias("size")).select(
        "source", F.pow(F.greatest(F.col("size"), F.lit(1)), F.lit(temperature)).alias("weight")
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with a source that is never missing and the text's length as ``size``."""
    return docs.withColumn("source", F.coalesce("source", F.lit(""))).withColumn(
        "size", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    )


def slots_of(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """``source``, ``slots`` (in a period of about ``period``, one at least) and the ``period``."""
    total = F.sum("weight").over(Window.partitionBy())
    share = F.greatest(F.round(F.col("weight") / total * period), F.lit(1)).cast("long")
    return weights.select("source", share.alias("slots")).withColumn(
        "period", F.sum("slots").over(Window.partitionBy())
    )


def schedule(slots: DataFrame) -> DataFrame:
    """``source``, ``slots``, ``period``, ``turn`` (from 0) and ``slot``: one period by earliest deadline first."""
    listed = slots.groupBy("period").agg(
        F.sort_array(F.collect_list(F.struct("source", "slots"))).alias("all")
    )
    period = F.col("period")

    def step(state, t):
        due = F.filter(
            F.transform(F.col("all"), lambda s, k: F.struct(
                F.ceil((F.get(state["done"], k) + 1) * period / s["slots"]).alias("deadline"),
                k.alias("k"),
                (
                    (F.get(state["done"], k) < s["slots"])
                    & (F.floor(F.get(state["done"], k) * period / s["slots"]) <= t)
                ).alias("ready"),
            )),
            lambda c: c["ready"],
        )
        pick = F.array_min(due)["k"]
        return F.transform(F.array(pick), lambda p: F.struct(
            F.transform(state["done"], lambda x, k: x + F.when(k == p, 1).otherwise(0)).alias("done"),
            F.concat(state["picked"], F.array(p)).alias("picked"),
        ))[0]

    start = F.struct(
        F.transform(F.col("all"), lambda s: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<int>").alias("picked"),
    )
    run = F.aggregate(
        F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda state: state["picked"]
    )
    picked = listed.select("period", "all", F.posexplode(run).alias("slot", "k")).select(
        F.get("all", F.col("k"))["source"].alias("source"),
        F.get("all", F.col("k"))["slots"].alias("slots"),
        "period", F.col("slot").cast("long").alias("slot"),
    )
    order = Window.partitionBy("source").orderBy("slot")
    return picked.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


def exact_order(weights: list[float], blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Source and number of every block, by earliest deadline first under the exact ``weights``.

    Sources without a weight above zero come after all others, in equal parts.
    """
    some = [i for i, w in enumerate(weights) if w > 0] or list(range(len(weights)))
    exact = {i: Fraction(weights[i]) if weights[i] > 0 else Fraction(1) for i in some}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    parts = {i: int(x * unit) for i, x in exact.items()}
    total = sum(parts.values())
    waiting, ready = [(0, i, 0) for i in some if blocks[i]], []
    n, t = sum(blocks[i] for i in some), 0
    source, number = np.empty(n, np.int32), np.empty(n, np.int64)
    for at in range(n):
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[i]), i, k))
        _, source[at], number[at] = _, i, k = heapq.heappop(ready)
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * total // parts[i], i, k + 1))
        t += 1
    rest = [i for i in range(len(weights)) if i not in exact]
    if rest:
        more, numbers = exact_order([1.0] * len(rest), [blocks[i] for i in rest])
        source = np.concatenate([source, np.array(rest, np.int32)[more]])
        number = np.concatenate([number, numbers])
    return source, number


def _hash_digits(n: int) -> int:
    """Hex digits that cut ``n`` keys into about as many buckets as a bucket has keys."""
    digits = 1
    while 16 ** (2 * digits) < n:
        digits += 1
    return digits


def _weighted(docs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``source`` and ``weight`` (zero at least) of every source of ``docs``.

    Weights given for one source several times are added up; what is no finite number counts as zero.
    """
    if weights is None:
        weights = default_weights(docs)
    else:
        weight = F.col("weight").cast("double")
        finite = ~F.isnan(weight) & (F.abs(weight) != float("inf"))
        weights = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
            F.sum(F.when(finite, weight).otherwise(F.lit(0.0))).alias("weight")
        )
    return sized(docs).select("source").distinct().join(weights, "source", "left").select(
        "source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")
    )


def _in_blocks(docs: DataFrame, block_chars: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``before`` and ``block``, and sums by source and bucket."""
    rows = sized(docs)
    digits = _hash_digits(docs.count())
    hashed = rows.select("doc_id", "source", "size", *[F.col(f"`{c}`") for c in carry]).withColumn(
        "_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ).withColumn("_bucket", F.substring("_hash", 1, digits))
    sums = hashed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("source").orderBy("_bucket")
    offsets = saved(
        sums.select("source", "_bucket", (F.sum("_sum").over(along) - F.col("_sum")).alias("_offset")),
        "offsets",
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = hashed.withColumn("_within", F.sum("size").over(inside) - F.col("size"))
    placed = attach(summed, offsets, ["source", "_bucket"], "inner").withColumn(
        "before", F.col("_offset") + F.col("_within")
    ).withColumn("block", F.floor(F.col("before") / block_chars))
    return placed, sums


def positions(
    docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS,
    period: int = PERIOD, carry: list[str] | None = None,
) -> DataFrame:
    """``doc_id``, ``source`` and ``carry`` with each row's place in the mixture.

    ``before`` is the size of the source's documents ahead of this one, ``block`` the number of
    the block it begins in, with its ``release``, ``deadline`` and ``slot``; ``balanced`` tells
    whether every source still has blocks at that slot. Sources without a weight above zero
    get the smallest share.
    """
    carry = [c for c in (carry or []) if c not in {"doc_id", "source"}]
    plan = saved(schedule(slots_of(_weighted(docs, weights), period)), "schedule")
    placed, sums = _in_blocks(docs, block_chars, carry)

    turns = plan.groupBy("source", "slots", "period").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "slot"))), lambda x: x["slot"]).alias("_turns")
    )

    def at(block):
        turn = F.get("_turns", F.pmod(block, F.col("slots")).cast("int"))
        return F.floor(block / F.col("slots")) * F.col("period") + turn

    # A row a source: how many blocks each has, and the first slot that one cannot fill.
    blocks = sums.groupBy("source").agg(F.ceil(F.sum("_sum") / block_chars).alias("_blocks"))
    table = saved(
        turns.join(blocks, "source").withColumn(
            "_end", F.min(at(F.col("_blocks"))).over(Window.partitionBy())
        ),
        "shares",
    )
    return attach(placed, table, ["source"], "inner").select(
        "doc_id", "source", *[F.col(f"`{c}`") for c in carry], "size", "before", "block",
        F.floor(F.col("block") * F.col("period") / F.col("slots")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("period") / F.col("slots")).alias("deadline"),
        at(F.col("block")).alias("slot"),
        (at(F.col("block")) < F.col("_end")).alias("balanced"),
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mixture, dealt to partitions by place.

    Blocks follow the exact weights. Sources without a weight above zero come last.
    """
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    renamed = docs.select("doc_id", "source", "text", *own)
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    # The text is carried once, as one of the own columns.
    placed, sums = _in_blocks(renamed, block_chars, names)
    # An empty text at the very end begins in a block of its own.
    blocks = sums.groupBy("source").agg((F.floor(F.sum("_sum") / block_chars) + 1).alias("blocks"))
    sources = sorted(_weighted(renamed, weights).join(blocks, "source").collect())
    source, number = exact_order([r["weight"] for r in sources], [r["blocks"] for r in sources])
    spark = docs.sparkSession
    listed = pa.DictionaryArray.from_arrays(pa.array(source), pa.array([r["source"] for r in sources], pa.string()))
    order = saved(
        spark.createDataFrame(pa.table({
            "source": listed.cast(pa.string()), "block": pa.array(number),
            "place": pa.array(np.arange(len(number))),
        })),
        "order",
    )
    return (
        attach(placed, order, ["source", "block"], "inner")
        .repartitionByRange("place", "before").sortWithinPartitions("place", "before", "doc_id")
        .select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    )
