"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by angle. For each cluster the candidates are sorted once by an upper bound of
the score that any member can reach: a candidate's length times the cosine of the angle between it and
the cluster's centre, less the widest angle of a member. Every member walks that list, in steps
that grow, until its worst kept score is above the bound of all that follows, so what it returns is certified.

Candidates are dealt by a hash of their key into chunks, anchors in groups of neighbouring clusters, and
a task has one chunk and one group. Each gives back its best few, which are put together by
anchor: positives first, then the negatives in the window that each positive's score opens.

Scores are integer inner products, so results do not depend on the order of addition. Rows without a key,
label or complete vector take no part; a shorter vector counts as filled up with zeros. Of rows with one key the
one with the smallest label and vector counts. Ties of a score go to the smaller key. Anchors without
positives, or positives without negatives in their window, give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenc.llm.common import saved
from tenc.llm.vectors import as_matrix, complete, packed, unpacked

# Anchors that centres are fitted on, the first by a hash of their keys; centres that they give at most.
SAMPLE_ANCHORS, MAX_CENTRES = 4096, 256
ANCHORS_A_CENTRE = 16
# Candidates of a chunk and anchors of a group, at most on average.
CHUNK_ROWS, GROUP_ANCHORS = 65_536, 2048
# First and last step of a walk.
FIRST_STEP, LAST_STEP = 1024, 16_384
_SEED, _ROUNDS = 42, 8
# Bounds are computed in floating point; they are raised by this share of the product of lengths.
_SLACK = 1e-9


def _clusters(vectors: np.ndarray) -> np.ndarray:
    """Unit centres of the directions of ``vectors``, by rounds of assigning and averaging."""
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors[lengths > 0] / lengths[lengths > 0][:, None]
    k = min(MAX_CENTRES, max(1, len(units) // ANCHORS_A_CENTRE))
    if not len(units):
        return np.zeros((1, vectors.shape[1]))
    centres = units[np.random.default_rng(_SEED).choice(len(units), k, replace=False)]
    for _ in range(_ROUNDS):
        nearest = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where((norms > 0)[:, None], sums / np.maximum(norms, 1e-300)[:, None], centres)
    return centres


def _prepare(batches, width: int, kind: type):
    for batch in batches:
        matrix = as_matrix(batch.column("vector"), width, kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), packed(matrix)], ["id", "label", "vector"]
        )


def _assign(batches, centres: np.ndarray):
    """Number of the centre that makes the smallest angle with each anchor."""
    for batch in batches:
        matrix = unpacked(batch.column("vector"), centres.shape[1], "<i8").astype(float)
        nearest = np.argmax(matrix @ centres.T, axis=1) if len(matrix) else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(nearest.astype(np.int32))], [*batch.schema.names, "cluster"]
        )


class _Scores:
    """Exact integer products of a chunk with some anchors, by the narrowest arithmetic that holds them."""

    def __init__(self, items: np.ndarray, anchors: np.ndarray):
        def longest(m):
            return float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max(initial=0))

        # Every partial sum of a product is at most the product of the lengths.
        most = longest(items) * longest(anchors)
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else object
        self.items, self.anchors = items.astype(kind), anchors.astype(kind)

    def __call__(self, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        product = self.items[rows] @ self.anchors[members].T
        if product.dtype == object and product.size and max(abs(product.min()), abs(product.max())) >= 2**63:
            raise ValueError("a score does not fit in 64 bits")
        return product.astype(np.int64)


def _best(owner: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each owner by descending score, then key."""
    order = np.lexsort((key, -score, owner))
    sorted_owner = owner[order]
    start = np.flatnonzero(np.diff(sorted_owner, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _walk(scores: _Scores, list_order, bounds, members, lengths, k, wanted, floor):
    """Walk one shared list for the ``members`` of a cluster.

    ``bounds`` descend along the list and hold for an anchor of length one. ``wanted(rows, members, scores)`` gives
    for each of several goals of a member which entries count. A goal is left when its ``k``-th score is above
    the bound of the rest, or the bound falls below its ``floor``. Returns goal, row and score of what is kept.
    """
    goals = floor.shape[1]
    found = [np.empty(0, np.int64)] * 3
    least = np.full((len(members), goals), np.iinfo(np.int64).min, np.int64)
    start, step = 0, FIRST_STEP
    active = np.arange(len(members))
    while start < len(list_order) and len(active):
        ahead = bounds[start] * lengths[active]
        # A tie of the bound may still have a smaller key.
        open_goals = (least[active] <= ahead[:, None]) & (floor[active] <= ahead[:, None])
        active = active[open_goals.any(axis=1)]
        if not len(active):
            break
        rows = list_order[start : start + step]
        product = scores(rows, members[active])
        member, goal, row, value = wanted(rows, active, product, least)
        place = member * goals + goal
        found = [np.concatenate(pair) for pair in zip(found, (place, row, value))]
        kept = _best(found[0], found[2], scores.keys[found[1]], k)
        found = [f[kept] for f in found]
        full, counts = np.unique(found[0], return_counts=True)
        full = full[counts == k]
        last = np.full(len(members) * goals, np.iinfo(np.int64).min, np.int64)
        # Kept entries stand by goal and descending score: the last of a goal is its worst.
        np.minimum.at(worst := np.full(len(last), np.iinfo(np.int64).max), found[0], found[2])
        last[full] = worst[full]
        least = last.reshape(least.shape)
        start, step = start + step, min(2 * step, LAST_STEP)
    return found


def _task(key, items: pa.Table, anchors: pa.Table, centres, k: int, share: tuple[int, int] | None) -> pa.Table:
    """The best candidates of one chunk for one group of anchors: positives, or negatives in a window a positive."""
    names = ["anchor_id", "goal", "id", "score"]
    empty = pa.table({n: pa.array([], pa.int64()) for n in names})
    if not items.num_rows or not anchors.num_rows:
        return empty
    width = centres.shape[1]
    vectors = unpacked(items.column("vector"), width, "<i8")
    anchor_vectors = unpacked(anchors.column("vector"), width, "<i8")
    ids, labels = items.column("id").to_numpy(), items.column("label").to_numpy()
    anchor_ids, anchor_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    cluster = anchors.column("cluster").to_numpy()
    scores = _Scores(vectors, anchor_vectors)
    scores.keys = ids
    floats, anchor_floats = vectors.astype(float), anchor_vectors.astype(float)
    size, length = np.linalg.norm(floats, axis=1), np.linalg.norm(anchor_floats, axis=1)
    if share is None:
        floor = np.full((len(anchor_ids), 1), -np.inf)
    else:
        positives = np.array(anchors.column("positives").to_pylist(), object)
        goals = max(len(p) for p in positives)
        # A goal that is not there opens no window.
        opened = np.array([[*p, *[-1] * (goals - len(p))] for p in positives], np.int64)
        there = np.arange(goals)[None, :] < np.array([len(p) for p in positives])[:, None]
        low, high = share
        floor = np.where(there & (opened >= 0), low * opened / 100, np.inf)
    result = []
    for c in np.unique(cluster):
        members = np.flatnonzero(cluster == c)
        centre = centres[c]

        def angle(v, n):
            return np.arccos(np.clip(v @ centre / np.maximum(n, 1e-300), -1, 1))

        widest = np.where(length[members] > 0, angle(anchor_floats[members], length[members]), 0).max()
        # Half a millionth of a turn more covers the rounding of the angles.
        bound = size * np.cos(np.clip(angle(floats, size) - widest - 1e-6, 0, np.pi)) + _SLACK * size
        order = np.argsort(-bound, kind="stable")

        def wanted(rows, active, product, least):
            same = labels[rows][:, None] == anchor_labels[members[active]][None, :]
            if share is None:
                mask = same & (ids[rows][:, None] != anchor_ids[members[active]][None, :])
                mask &= product >= least[active, 0][None, :]
                at, member = np.nonzero(mask)
                return active[member], np.zeros(len(at), np.int64), rows[at], product[at, member]
            parts = []
            for g in range(goals):
                p = opened[members[active], g]
                mask = (100 * product >= low * p) & (100 * product <= high * p) & ~same
                mask &= there[members[active], g][None, :] & (product >= least[active, g][None, :])
                at, member = np.nonzero(mask)
                parts.append((active[member], np.full(len(at), g), rows[at], product[at, member]))
            return tuple(np.concatenate(x) for x in zip(*parts))

        place, row, value = _walk(
            scores, order, bound[order], members, length[members], k, wanted, floor[members]
        )
        goals_here = floor.shape[1]
        result.append((anchor_ids[members[place // goals_here]], place % goals_here, ids[row], value))
    return pa.table({n: pa.array(np.concatenate(x).astype(np.int64)) for n, x in zip(names, zip(*result))})


def _search(items, anchors, chunks: int, groups: int, centres, k: int, share=None) -> DataFrame:
    """Run every chunk of candidates against every group of anchors and keep the first ``k`` of each goal."""
    spread_items = items.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread_anchors = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    task = partial(_task, centres=centres, k=k, share=share)
    found = (
        spread_items.groupBy("chunk", "group").cogroup(spread_anchors.groupBy("chunk", "group"))
        .applyInArrow(lambda key, left, right: task(key, left, right), "anchor_id long, goal long, id long, score long")
    )
    order = Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` has ``id``, ``label`` and an integer ``vector``; ``anchor`` says over ``id`` which rows are anchors. A
    negative has another label than its anchor and a score from ``low`` to ``high`` hundredths of the positive's.
    """
    vector = F.col("vector")
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull())
    once = fit.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), "vector").alias("v")).groupBy("id").agg(
        F.min("v").alias("v")
    ).select("id", "v.label", "v.vector")
    stats = fit.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stats["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    width = max(stats["width"], 1)
    spark = rows.sparkSession
    # Small tables are dealt to all cores, large ones in chunks of a stated size.
    cores = spark.sparkContext.defaultParallelism
    chunks = max(-(-stats["n"] // CHUNK_ROWS), min(2 * cores, -(-stats["n"] // 4096)))
    ready = once.mapInArrow(partial(_prepare, width=width, kind=np.int64), "id long, label long, vector binary")
    items = saved(
        ready.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "candidates"
    )
    picked = items.where(anchor).drop("chunk")
    sample = picked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ANCHORS).select("vector").toArrow()
    centres = _clusters(unpacked(sample.column("vector").combine_chunks(), width, "<i8").astype(float))
    placed = saved(
        picked.mapInArrow(partial(_assign, centres=centres), "id long, label long, vector binary, cluster int"), "anchors"
    )
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    # Groups of whole clusters; a cluster beyond a group's size is dealt to several by key.
    first, group, held = {}, 0, 0
    for c in sorted(sizes):
        parts = -(-sizes[c] // GROUP_ANCHORS)
        if held and held + sizes[c] > GROUP_ANCHORS:
            group, held = group + 1, 0
        first[c] = (group, parts)
        group, held = (group + parts - 1, held + sizes[c]) if parts == 1 else (group + parts, 0)
    groups = group + (1 if held else 0)
    cases = F.create_map(*[F.lit(x) for c, (g, _) in first.items() for x in (c, g)])
    parts = F.create_map(*[F.lit(x) for c, (_, p) in first.items() for x in (c, p)])
    grouped = placed.withColumn(
        "group", (cases[F.col("cluster")] + F.pmod(F.xxhash64("id"), parts[F.col("cluster")])).cast("int")
    )
    positives = saved(_search(items, grouped, chunks, groups, centres, n_positives), "positives")
    by_anchor = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives")
    )
    negatives = _search(
        items, grouped.join(by_anchor, "id"), chunks, groups, centres, n_negatives, (low, high)
    ).select("anchor_id", (F.col("goal") + 1).cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select(
        "anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def from_embeddings(rows: DataFrame) -> DataFrame:
    """``id``, ``label`` and the integer vector of embeddings, by fixed rules of the contract.

    A component becomes ``floor(256 x)``; every seventh key has its label moved on by one of ten. Rows with an
    incomplete vector or no label are left out.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(complete("embedding") & F.col("label").isNotNull()).select(
        F.col("vec_id").alias("id"), moved.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
    )
