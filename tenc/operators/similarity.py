"""How many categories lie within a similarity ball of each category.

Two similarities are known. ``3-gram`` is the Jaccard coefficient of 3-gram sets: grams are ordered
from rare to common, and two sets that are similar must share a gram among the first few of each,
have similar sizes, and still be able to reach the needed overlap from the position of that gram.
``levenshtein`` is one minus the edit distance over the longer length: the shorter of two texts at
most k edits apart is cut into k + 1 segments, one of which the longer text holds unchanged and
shifted by little. Neither compares all pairs; a gram or segment that very many categories share
is joined in blocks. Where so many pairs are similar that a list of them would be the cost, and for few
categories, all are compared in blocks instead and only the counts come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.similarity import gram_set, jaccard_of_sets
from tenc.operators.allpairs import count_partners, sampled_share
from tenc.operators.blocks import BLOCK_ROWS, join_in_blocks
from tenc.operators.lookup import lookup
from tenc.session import materialise

_TOLERANCE = 1e-9
# At or below this, segments can be empty: nearly all pairs of similar length would be candidates.
EDIT_FLOOR = 0.5
# Up to so many values, or from so large a share of similar pairs on, all pairs are compared and none is listed.
FEW_VALUES = 20_000
DENSE_SHARE = 0.002


def _gram_pairs(values: DataFrame, threshold: float, size: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``l_id, r_id, sim`` for every pair of ``id, value`` with 3-gram similarity ``threshold`` or more, once."""
    if not 0 < threshold <= 1:
        raise ValueError("the similarity threshold must lie in (0, 1]")
    sets = materialise(
        values.select("id", gram_set(F.col("value"), size).alias("grams")).withColumn("size", F.size("grams"))
    )
    exploded = sets.select("id", "size", F.explode("grams").alias("gram"))
    frequency = materialise(
        exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("freq", F.col("n"))
    )
    extent = frequency.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.octet_length("gram")).alias("bytes"),
    ).first()
    ranked = lookup(
        exploded, frequency, [F.col("gram")], ["gram"], ["freq"],
        (extent["bytes"] or 0) + 64 * extent["k"], "n", extent["n"] or 0, 64 + 4 * size,
    )
    # One set per value again, its grams from rare to common.
    ordered = ranked.groupBy("id", "size").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("freq", "gram"))), lambda g: g["gram"]
        ).alias("sorted")
    )
    keep = F.col("size") - F.ceil(F.col("size") * threshold - _TOLERANCE).cast("int") + 1
    heads = materialise(
        ordered.select("id", "size", F.slice("sorted", F.lit(1), keep).alias("head"))
        .select("id", "size", "head", F.posexplode("head").alias("pos", "gram"))
    )

    def side(prefix: str) -> DataFrame:
        return heads.select("gram", *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "size", "pos", "head")])

    needed = (F.col("l_size") + F.col("r_size")) * (threshold / (1 + threshold))
    reachable = F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos"))
    smaller, larger = F.least("l_size", "r_size"), F.greatest("l_size", "r_size")
    # Both heads follow one order of grams, so the first shared gram is the one with none shared before it.
    shared_before = F.arrays_overlap(
        F.slice("l_head", F.lit(1), F.col("l_pos")), F.slice("r_head", F.lit(1), F.col("r_pos"))
    )
    candidates = (
        join_in_blocks(side("l"), side("r"), "gram", "l_id", "r_id", block_rows)
        .where(F.col("l_id") < F.col("r_id"))
        .where(smaller >= larger * threshold - _TOLERANCE)
        .where(~shared_before)
        .where(reachable >= needed - _TOLERANCE)
        .select("l_id", "r_id")
    )
    grams = sets.select("id", "grams")
    return (
        candidates.join(grams.toDF("l_id", "l_grams"), "l_id")
        .join(grams.toDF("r_id", "r_grams"), "r_id")
        .select("l_id", "r_id", jaccard_of_sets(F.col("l_grams"), F.col("r_grams")).alias("sim"))
        .where(F.col("sim") >= threshold - _TOLERANCE)
    )


def _edits(length: Column, threshold: float) -> Column:
    """The edits that leave a similarity of ``threshold`` where the longer text has ``length`` characters."""
    return F.floor(length * (1 - threshold) + _TOLERANCE).cast("int")


def _edit_pairs(values: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``l_id, r_id, sim`` for every pair of ``id, value`` with edit similarity ``threshold`` or more, once.

    A text of L characters looks up about ((1 - threshold) * L) ** 3 * 2 / 3 substrings: this is for
    names and addresses, not for whole documents.
    """
    if not EDIT_FLOOR < threshold <= 1:
        raise ValueError(f"the edit similarity must lie in ({EDIT_FLOOR}, 1]")
    # Few short rows become very many: they are dealt to all tasks first.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = materialise(
        values.select("id", "value", F.length("value").alias("size")).where("size > 0").repartition(tasks, "id")
    )
    i, k, short = F.col("i"), F.col("k"), F.col("short")

    def cut(rows: DataFrame) -> DataFrame:
        """A row for each of the ``k + 1`` segments of a text of ``short`` characters: its start and length."""
        base, longer_from = F.floor(short / (k + 1)).cast("int"), k + 1 - short % (k + 1)
        return rows.withColumn("i", F.explode(F.sequence(F.lit(1), k + 1))).withColumns({
            "start": 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - longer_from),
            "length": base + (i > longer_from).cast("int"),
        })

    def keyed(rows: DataFrame, at: Column, prefix: str) -> DataFrame:
        # Equal keys of different segments only add candidates; all are checked below.
        text = F.substring("value", at, F.col("length"))
        return rows.select(
            F.xxhash64("short", "k", "i", text).alias("key"),
            F.col("id").alias(f"{prefix}_id"), F.col("size").alias(f"{prefix}_size"),
        )

    # As the shorter text: segments for every number of edits that a longer partner may allow.
    size = F.col("size")
    most = F.least(_edits(F.floor(size / threshold + _TOLERANCE), threshold), size - 1)
    fewest = F.least(_edits(size, threshold), most)
    index = keyed(
        cut(sized.withColumn("short", size).withColumn("k", F.explode(F.sequence(fewest, most)))), F.col("start"), "l"
    )
    # As the longer text: the substrings that can be such a segment. With i - 1 segments before it (and
    # k + 1 - i behind it) untouched by luck only, a match further off would need an edit too many.
    asking = cut(
        sized.withColumn("k", _edits(size, threshold)).withColumn("short", F.explode(F.sequence(size - k, size)))
    )
    start, apart = F.col("start"), size - short
    first = F.greatest(F.lit(1), start - (i - 1), start + apart - (k + 1 - i))
    last = F.least(size - F.col("length") + 1, start + (i - 1), start + apart + (k + 1 - i))
    probes = keyed(
        asking.withColumns({"_first": first, "_last": last}).where("_first <= _last")
        .withColumn("at", F.explode(F.sequence("_first", "_last"))),
        F.col("at"), "r",
    )
    # Pairs are numbers until each is compared once.
    candidates = (
        join_in_blocks(index, probes, "key", "l_id", "r_id", block_rows)
        .where((F.col("l_size") < F.col("r_size")) | ((F.col("l_size") == F.col("r_size")) & (F.col("l_id") < F.col("r_id"))))
        .select("l_id", "r_id").distinct()
    )
    known = sized.select("id", "value", "size")
    return (
        candidates.join(known.toDF("l_id", "l_value", "l_size"), "l_id")
        .join(known.withColumn("k", _edits(size, threshold)).toDF("r_id", "r_value", "r_size", "r_k"), "r_id")
        .withColumn("distance", F.expr("levenshtein(l_value, r_value, r_k)")).where("distance >= 0")
        .select("l_id", "r_id", (1 - F.col("distance") / F.col("r_size")).alias("sim"))
    )


_PAIRS = {"3-gram": _gram_pairs, "levenshtein": _edit_pairs}


def similar_pairs(
    values: DataFrame, threshold: float, similarity: str = "3-gram", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``left, right, sim`` for all ordered pairs of different values with ``sim >= threshold``.

    ``values`` has one row per distinct ``value``; ``threshold`` must be above zero, and above 0.5
    for ``levenshtein``.
    """
    known = materialise(values.select("value", F.monotonically_increasing_id().alias("id")))
    pairs = _both_ways(_PAIRS[similarity](known, threshold, block_rows=block_rows))
    return (
        pairs.join(known.toDF("left", "l_id"), "l_id").join(known.toDF("right", "r_id"), "r_id")
        .select("left", "right", "sim")
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(
        F.struct("l_id", "r_id", "sim"),
        F.struct(F.col("r_id").alias("l_id"), F.col("l_id").alias("r_id"), F.col("sim")),
    )))


def _weighted_values(df: DataFrame, column: str) -> DataFrame:
    value = quoted(column).cast("string")
    return materialise(
        df.where(value.isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("id", F.monotonically_increasing_id())
    )


def _partners(values: DataFrame, n: int, levels: list[float], similarity: str) -> DataFrame:
    """``id, _0, _1, ...``: how many of the other values are at least as similar as each of ``levels``."""
    least = min(*levels, 1.0)
    if similarity == "levenshtein" and not EDIT_FLOOR < least:
        raise ValueError(f"the edit similarity must lie in ({EDIT_FLOOR}, 1]")
    if n <= FEW_VALUES or sampled_share(values, least, similarity) >= DENSE_SHARE:
        return count_partners(values, n, levels, similarity)
    pairs = _PAIRS[similarity](values, least)
    reached = [F.sum((F.col("sim") >= t - _TOLERANCE).cast("long")).alias(f"_{i}") for i, t in enumerate(levels)]
    return _both_ways(pairs).groupBy(F.col("l_id").alias("id")).agg(*reached)


def _counts_at(values: DataFrame, levels: dict[float, float], similarity: str) -> DataFrame:
    """``value, weight, level, n``: distinct values with ``sim >= levels[level]``.

    Every value is in its own ball; a similarity of zero or less holds for all values.
    """
    k = values.count()
    positive = {name: t for name, t in levels.items() if t > 0}
    marks = F.explode(F.array(*[F.lit(float(n)) for n in levels])).alias("level")
    grid = values.select("id", "value", "weight", marks)
    everyone: Column = F.col("level").isin(*[float(n) for n in levels if n not in positive])
    if not positive:
        return grid.withColumn("n", F.lit(k).cast("long"))
    wide = _partners(values.select("id", "value"), k, list(positive.values()), similarity)
    per_level = F.inline(
        F.array(
            *[
                F.struct(F.lit(float(n)).alias("level"), F.col(f"_{i}").alias("others"))
                for i, n in enumerate(positive)
            ]
        )
    )
    others = wide.select("id", per_level)
    inside_self = F.col("level").isin(*[float(n) for n, t in levels.items() if t <= 1])
    own = F.when(inside_self, F.lit(1)).otherwise(F.lit(0))
    return grid.join(others, ["id", "level"], "left").select(
        "value",
        "weight",
        "level",
        F.when(everyone, F.lit(k))
        .otherwise(own + F.coalesce("others", F.lit(0)))
        .cast("long")
        .alias("n"),
    )


def ball_counts(df: DataFrame, column: str, bins: list[float], similarity: str = "3-gram") -> DataFrame:
    """``bin, n_pairs, per_row``: pairs of a row and a distinct category with ``sim >= bin``."""
    values = _weighted_values(df, column)
    counted = _counts_at(values, {b: b for b in bins}, similarity)
    pairs = F.sum(F.col("n") * F.col("weight"))
    return counted.groupBy(F.col("level").alias("bin")).agg(
        pairs.alias("n_pairs"), (pairs / F.sum("weight")).alias("per_row")
    )


def ball_by_value(df: DataFrame, column: str, radii: list[float], similarity: str = "3-gram") -> DataFrame:
    """``value, radius, n``: distinct categories with distance ``1 - sim <= radius``."""
    values = _weighted_values(df, column)
    return _counts_at(values, {r: 1.0 - r for r in sorted(radii)}, similarity).select(
        "value", F.col("level").alias("radius"), "n"
    )
