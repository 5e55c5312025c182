"""Counts of similar pairs, all texts against all, where too many pairs are similar to be listed.

Texts are dealt to blocks by their id, and every two blocks meet in a group of their own. A group compares strips of
its texts by matrix products and keeps only each text's number of partners by level: no pair leaves a task. Shared
frequent tokens come out of one product, rare ones are added by their lists.

By edit distance blocks are of about one length, and a block meets the texts that are not shorter, in parts
(``editballs``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.operators.editballs import LANES, EditTable, Texts, count_hits, most_edits  # noqa: F401

TOLERANCE = 1e-9
# Texts of a block; groups hold two blocks.
BLOCK_TEXTS = 16_384
# Fewer texts than this are not worth a group of their own.
_LEAST_TEXTS = 256
_LEFT, _RIGHT = 1024, 8192
# A token that this share of the pairs of a strip has in common is multiplied, not listed.
_FREQUENT = 0.005
# Lanes of a block unless texts are very many; and right texts that meet them at a time.
_MOST_OF_FEW = 4096
_RIGHT_TEXTS = 1 << 17


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and token number of every distinct 3-gram."""
    n = len(texts.sizes)
    c = np.concatenate([texts.chars, [0, 0]])
    left = texts.sizes[texts.owner] - texts.place()
    second, third = np.where(left > 1, c[1:-1], 0), np.where(left > 2, c[2:], 0)
    # A text shorter than three characters is its own only gram.
    used = (left > 2) | (texts.place() == 0)
    code = ((c[:-2] << 42) | (second << 21) | third)[used]
    empty = np.flatnonzero(texts.sizes == 0)
    known, number = np.unique(np.concatenate([code, np.zeros(len(empty), np.int64)]), return_inverse=True)
    owner = np.concatenate([texts.owner[used], empty])
    vocabulary = max(len(known), 1)
    pairs = np.unique(owner * vocabulary + number)
    return pairs // vocabulary, pairs % vocabulary, vocabulary


class _Sets:
    """Token sets by text; ``strip`` takes some texts out."""

    def __init__(self, owner: np.ndarray, token: np.ndarray, n: int):
        self.owner, self.token = owner, token
        self.sizes = np.bincount(owner, minlength=n)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])

    def strip(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[low], self.ends[high])
        return self.owner[at] - low, self.token[at]


def _shared(a, b, n_a: int, n_b: int, vocabulary: int) -> np.ndarray:
    """The number of tokens that each text of one strip has in common with each of the other."""
    in_a, in_b = np.bincount(a[1], minlength=vocabulary), np.bincount(b[1], minlength=vocabulary)
    dense = in_a * in_b > _FREQUENT * n_a * n_b
    column = np.cumsum(dense) - 1

    def matrix(owner, token, n):
        keep = dense[token]
        out = np.zeros((n, int(dense.sum())), np.float32)
        out[owner[keep], column[token[keep]]] = 1
        return out

    found = matrix(*a, n_a) @ matrix(*b, n_b).T
    listed = (in_a > 0) & (in_b > 0) & ~dense

    def lists(owner, token, counts):
        order = np.argsort(token, kind="stable")
        return owner[order], np.concatenate([[0], np.cumsum(counts)])

    of_a, end_a = lists(*a, in_a)
    of_b, end_b = lists(*b, in_b)
    for t in np.flatnonzero(listed):
        found[np.ix_(of_a[end_a[t] : end_a[t + 1]], of_b[end_b[t] : end_b[t + 1]])] += 1
    return found


def _needed(level: float, most: int) -> np.ndarray:
    """The least overlap that gives the level, by the sum of two set sizes."""
    total = np.arange(most + 1, dtype=np.float64)
    least = np.maximum(np.floor(total * level / (1 + level)) - 1, 0)
    for _ in range(4):
        sim = np.divide(least, total - least, out=np.full_like(total, np.inf), where=total > least)
        least += sim < level - TOLERANCE
    return least


def _gram_strip(shared, sizes_a, sizes_b, needed, hits):
    """``hits(level number, rows, columns by which rows hit)`` for rows of equal set size."""
    low = 0
    while low < len(sizes_a):
        high = int(np.searchsorted(sizes_a, sizes_a[low], side="right"))
        for number, least in enumerate(needed):
            hits(number, slice(low, high), shared[low:high] >= least[sizes_a[low] + sizes_b][None, :])
        low = high


def _group_counts(frame: pd.DataFrame, levels: list[float]) -> pd.DataFrame:
    """Partners by level for the texts of two blocks, from this meeting of theirs only."""
    same = frame["p"].iloc[0] == frame["q"].iloc[0]
    second = np.zeros(len(frame), bool) if same else (frame["own"] == frame["q"]).to_numpy()
    texts = frame["value"].tolist()
    all_texts = Texts(texts)
    owner, token, vocabulary = _tokens(all_texts)
    sizes = np.bincount(owner, minlength=len(texts))
    # Rows in order of block, then of size, so that rows of equal size lie side by side.
    order = np.lexsort((sizes, second))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    sort = np.argsort(position[owner], kind="stable")
    sets = _Sets(position[owner][sort], token[sort], len(texts))
    n_first = int((~second).sum())
    counts = np.zeros((len(levels), len(texts)), np.int64)
    most = int(sizes.max(initial=0))
    needed = [_needed(t, 2 * most) for t in levels]
    rights = range(0, n_first, _RIGHT) if same else range(n_first, len(texts), _RIGHT)
    for r in rights:
        r_end = min(r + _RIGHT, n_first if same else len(texts))
        right, size_r = sets.strip(r, r_end), sets.sizes[r:r_end]
        for a in range(0, r_end if same else n_first, _LEFT):
            a_end = min(a + _LEFT, n_first)
            size_a = sets.sizes[a:a_end]
            # Partners have sizes alike; a strip far from the other holds none.
            if min(size_a[-1], size_r[-1]) < max(size_a[0], size_r[0]) * levels[0] - TOLERANCE:
                continue
            shared = _shared(sets.strip(a, a_end), right, a_end - a, r_end - r, vocabulary)
            if same and a_end > r:
                # Each pair of a block once: the left text before the right one.
                shared[np.arange(a, a_end)[:, None] >= np.arange(r, r_end)[None, :]] = -1

            def hits(number, rows, hit):
                counts[number, a + rows.start : a + rows.stop] += np.count_nonzero(hit, axis=1)
                counts[number, r:r_end] += np.count_nonzero(hit, axis=0)

            _gram_strip(shared, size_a, size_r, needed, hits)
    columns = {f"_{k}": counts[k] for k in range(len(levels))}
    return pd.DataFrame({"id": frame["id"].to_numpy()[order], **columns})


def count_partners(
    values: DataFrame, n: int, levels: list[float], similarity: str, block_texts: int = BLOCK_TEXTS
) -> DataFrame:
    """``id, _0, _1, ...``: other texts of ``id, value`` (``n`` distinct ones) with similarity ``levels[0], ...`` or more."""
    if similarity == "levenshtein":
        return _count_edit_partners(values, levels, block_texts)
    spark = values.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # As many groups as keep all tasks busy, no block above its size.
    wanted = min(int((8 * tasks) ** 0.5) + 1, n // _LEAST_TEXTS)
    blocks = max(1, wanted, -(-n // block_texts))
    ordered = sorted(levels)
    own, other = F.col("own"), F.col("other")
    dealt = (
        values.select("id", "value", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("id", "value", "own", F.least(own, other).alias("p"), F.greatest(own, other).alias("q"))
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return _group_counts(frame, ordered)

    counted = dealt.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q").applyInPandas(
        meet, ", ".join(["id long", *[f"_{k} long" for k in range(len(levels))]])
    )
    return counted.groupBy("id").agg(*[F.sum(f"_{ordered.index(t)}").alias(f"_{k}") for k, t in enumerate(levels)])


def _edit_meetings(lengths: dict[int, int], edits: np.ndarray, most_lanes: int, groups: int):
    """How texts are dealt, from their number by length: blocks by length, and whom a block meets.

    Returns the number of blocks; by length the texts before it, their number and the first block it meets; and by block into how many
    parts those who meet it are dealt.
    """
    sizes, total = sorted(lengths), sum(lengths.values())
    lanes = min(LANES, most_lanes, max(_LEAST_TEXTS, min(_MOST_OF_FEW, -(-total // 4)), -(-total // 16)))
    blocks = -(-total // lanes)
    share = blocks / total
    before = dict(zip(sizes, np.cumsum([0, *[lengths[s] for s in sizes]]).tolist()))
    lowest = [int(before[s] * share) for s in sizes]
    # The longest text that a block can hold.
    longest = np.zeros(blocks, np.int64)
    np.maximum.at(longest, np.minimum(lowest, blocks - 1), sizes)
    longest = np.maximum.accumulate(longest)
    first = {s: int(np.searchsorted(longest, s - int(edits[s]), side="left")) for s in sizes}
    met = np.zeros(blocks)
    for s in sizes:
        at = np.arange(first[s], blocks)
        met[at] += np.clip(before[s] + lengths[s] - at / share, 0, lengths[s])
    part = min(_RIGHT_TEXTS, max(4 * _LEAST_TEXTS, -(-int(met.sum()) // groups)))
    return blocks, [(s, before[s], lengths[s], first[s]) for s in sizes], np.maximum(1, np.ceil(met / part)).astype(int).tolist()


def _count_edit_partners(values: DataFrame, levels: list[float], most_lanes: int) -> DataFrame:
    spark = values.sparkSession
    sized = values.select("id", "value", F.length("value").alias("size"))
    lengths = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    longest = max(lengths, default=0)
    # Distinct texts are an edit apart at least: where none is allowed there are no partners.
    used = [t for t in levels if most_edits(longest, t)[-1] > 0]
    if not used:
        return values.select("id", *[F.lit(0).cast("long").alias(f"_{k}") for k in range(len(levels))])
    blocks, dealing, parts = _edit_meetings(
        lengths, most_edits(longest, min(used)), most_lanes, 4 * spark.sparkContext.defaultParallelism
    )
    by_size = spark.createDataFrame(dealing, "size int, before long, n long, first int")
    by_block = spark.createDataFrame(list(enumerate(parts)), "p int, parts int")
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    block = F.least(F.floor((F.col("before") + drawn * F.col("n")) * (blocks / sum(lengths.values()))), F.lit(blocks - 1)).cast("int")
    placed = sized.join(F.broadcast(by_size), "size").select("id", "value", block.alias("own"), "first")
    lanes = placed.withColumn("p", F.col("own")).join(F.broadcast(by_block), "p").select(
        "id", "value", "own", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c"), F.lit(True).alias("lane")
    )
    # Whole blocks that are too short to be near are left out; a text meets those of its own block, too.
    others = placed.withColumn("p", F.explode(F.sequence(F.least("first", "own"), "own"))).join(F.broadcast(by_block), "p").select(
        "id", "value", "own", "p", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int").alias("c"), F.lit(False).alias("lane")
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["lane"]], frame[~frame["lane"]]
        # Both orders of a pair of one block come up by themselves.
        both = (right["own"] != right["p"]).to_numpy(bool)
        hits, others_hits = count_hits(left["value"].tolist(), right["value"].tolist(), both, used)
        kept = np.flatnonzero(others_hits.any(axis=0))
        ids = np.concatenate([left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)[kept]])
        return pd.DataFrame({"id": ids, **{f"_{k}": np.concatenate([hits[k], others_hits[k][kept]]) for k in range(len(used))}})

    counted = lanes.unionByName(others).repartition(sum(parts), "p", "c").groupBy("p", "c").applyInPandas(
        meet, ", ".join(["id long", *[f"_{k} long" for k in range(len(used))]])
    )
    # Every text has met itself once.
    sums = {t: F.sum(f"_{used.index(t)}") - 1 for t in used}
    return counted.groupBy("id").agg(*[sums.get(t, F.lit(0).cast("long")).alias(f"_{k}") for k, t in enumerate(levels)])


def sampled_share(values: DataFrame, threshold: float, similarity: str, n: int = 512) -> float:
    """The share of similar pairs among the first ``n`` texts in order of a hash of the text; it decides on speed only."""
    drawn = [r["value"] for r in values.select("value").orderBy(F.xxhash64("value"), "value").limit(n).collect()]
    if len(drawn) < 2:
        return 0.0
    if similarity == "levenshtein":
        found = count_hits(drawn, drawn, np.zeros(len(drawn), bool), [threshold])[0].sum() - len(drawn)
    else:
        frame = pd.DataFrame({"id": range(len(drawn)), "value": drawn, "own": 0, "p": 0, "q": 0})
        found = _group_counts(frame, [threshold])["_0"].sum()
    return float(found) / (len(drawn) * (len(drawn) - 1))
