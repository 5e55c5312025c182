"""Exact k nearest neighbours as a partitioned join.

Training vectors are assigned to their nearest of a few pivots and, within a pivot's cell, to a
ring of similar distance. Cells lie in blocks of bounded size in order of their cell, and so do the
queries. Every two blocks meet once; there the triangle inequality tells each query which rings can
hold one of its neighbours, and only queries and rings that need each other are compared. Distances
come from a matrix product; those that its rounding leaves in doubt are computed again from the
differences. Each meeting yields at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import MODEL_SEED, key_hash
from tenc.operators.encoders.stats import REGRESSION
from tenc.session import materialise

BLOCK_ROWS = 16_384
_LEAST_ROWS = 256
# Queries whose bounds to all rings are held at once.
_ROUTED = 512
MAX_PIVOTS = 256
_RINGS = 64


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.asarray(vectors.tolist(), dtype=np.float64)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances, a strip of rows at a time."""
    out = np.empty((len(left), len(right)))
    strip = max(1, 4_000_000 // max(1, right.size))
    for i in range(0, len(left), strip):
        gap = left[i : i + strip, None, :] - right[None, :, :]
        out[i : i + strip] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _closest(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of each query with their distances; of equal distances the earlier row.

    Squared distances from a product of matrices are off by a bounded rounding error. All rows that may be among the
    k nearest by that bound get their distance from the differences.
    """
    k = min(k, len(rows))
    centre = rows.mean(axis=0)
    q, r = queries - centre, rows - centre
    q_size, r_size = (q * q).sum(axis=1), (r * r).sum(axis=1)
    places = np.empty((len(q), k), np.int64)
    found = np.empty((len(q), k))
    scale = 8 * (q.shape[1] + 8) * np.finfo(float).eps
    strip = max(1, 8_000_000 // len(r))
    for low in range(0, len(q), strip):
        part = slice(low, min(low + strip, len(q)))
        square = q[part] @ r.T
        square *= -2
        square += r_size
        square += q_size[part, None]
        slack = scale * (q_size[part] + r_size.max())
        kth = np.partition(square, k - 1, axis=1)[:, k - 1] if k < len(r) else square.max(axis=1)
        near = square <= (kth + 2 * slack)[:, None]
        i, j = np.nonzero(near)
        exact = np.empty(len(i))
        for at in range(0, len(i), 100_000):
            gap = queries[low + i[at : at + 100_000]] - rows[j[at : at + 100_000]]
            exact[at : at + 100_000] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((j, exact, i))
        first = np.searchsorted(i[order], np.arange(part.stop - low))
        chosen = order[first[:, None] + np.arange(k)[None, :]]
        places[part], found[part] = j[chosen], exact[chosen]
    return places, found


def _pivots(train: DataFrame, n: int) -> np.ndarray:
    """A fixed number of distinct training vectors, the first in hash order of their id."""
    drawn = (
        train.select(key_hash("id", MODEL_SEED).alias("h"), "vector").orderBy("h").limit(n)
    ).collect()
    return np.unique(np.asarray([r["vector"] for r in drawn], dtype=np.float64), axis=0)


def _without_spare_copies(train: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k smallest keys: no other copy can be among k neighbours.

    The limit per group is applied before the shuffle already, so a vector with a third of all
    rows sends k rows per task.
    """
    copies = Window.partitionBy("vector").orderBy("id")
    return train.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop(
        "_copy"
    )


def _ring_width(pivots: np.ndarray) -> float:
    spread = _distances(pivots, pivots).max()
    return float(spread) / 16 if spread > 0 else 1.0


def _assign(train: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                dist = _distances(_matrix(batch["vector"]), pivots)
                cell = dist.argmin(axis=1)
                near = dist[np.arange(len(batch)), cell]
                ring = np.minimum(near // width, _RINGS - 1).astype(np.int64)
                yield batch.assign(ring=cell * _RINGS + ring, dist=near)

    return train.mapInPandas(
        rings, "id bigint, label double, vector array<double>, ring bigint, dist double"
    )


def _route(test: DataFrame, pivots: np.ndarray, rings: np.ndarray, k: int) -> DataFrame:
    """For each query the rings that may hold a neighbour, a bit for each ring.

    ``rings`` has columns id, rows, smallest and largest distance to its pivot.
    """
    ids = rings[:, 0].astype(np.int64)
    cells = ids // _RINGS
    counts, low, high = rings[:, 1], rings[:, 2], rings[:, 3]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + _ROUTED] for whole in batches for i in range(0, len(whole), _ROUTED)):
            to_pivot = _distances(_matrix(batch["vector"]), pivots)[:, cells]
            farthest = to_pivot + high
            order = farthest.argsort(axis=1)
            enough = (counts[order].cumsum(axis=1) >= k).argmax(axis=1)
            rows = np.arange(len(batch))
            bound = farthest[rows, order[rows, enough]]
            # With fewer than k training rows every ring is needed.
            bound = np.where(counts.sum() < k, np.inf, bound)
            nearest = np.maximum(np.maximum(to_pivot - high, low - to_pivot), 0.0)
            wanted = nearest <= bound[:, None] * (1 + 1e-9) + 1e-9
            yield batch.assign(wanted=[w.tobytes() for w in np.packbits(wanted, axis=1)])

    return test.mapInPandas(visit, "id bigint, vector array<double>, wanted binary")


def nearest(
    train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5,
    n_pivots: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query, neighbour, label, dist, place``: the k nearest training rows of each test row.

    Equal distances are settled by the smaller training key. Keys are whole numbers. By default
    there are as many pivots as full blocks of training rows, up to 256.
    """
    base = train.select(
        quoted(key).cast("long").alias("id"),
        quoted(label).cast("double").alias("label"),
        quoted(vector).cast("array<double>").alias("vector"),
    )
    queries = test.select(
        quoted(key).cast("long").alias("id"),
        quoted(vector).cast("array<double>").alias("vector"),
    )
    spark = train.sparkSession
    base, queries = materialise(_without_spare_copies(base, k)), materialise(queries)
    if n_pivots is None:
        n_pivots = min(max(base.count() // block_rows, 1), MAX_PIVOTS)
    pivots = _pivots(base, n_pivots)
    placed = _assign(base, pivots, _ring_width(pivots))
    # One row per pivot and ring: at most n_pivots * 64.
    ring_rows = (
        placed.groupBy("ring")
        .agg(F.count(F.lit(1)), F.min("dist"), F.max("dist"))
        .orderBy("ring")
        .collect()
    )
    ring_table = np.asarray([list(r) for r in ring_rows], dtype=np.float64)
    routed = _route(queries, pivots, ring_table, k)
    # Few blocks: every one travels to all blocks of the other side. Rows of a cell lie in as few blocks as they fill.
    n_rows, n_queries = int(ring_table[:, 1].sum()), queries.count()
    share = int((4 * spark.sparkContext.defaultParallelism) ** 0.5)
    train_blocks = max(1, -(-n_rows // block_rows), min(share, n_rows // _LEAST_ROWS))
    test_blocks = max(1, -(-n_queries // block_rows), min(share, n_queries // _LEAST_ROWS))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    ends = np.cumsum(ring_table[:, 1])
    starts = spark.createDataFrame(
        [(int(r[0]), int(e - r[1]), int(r[1])) for r, e in zip(ring_table, ends)], "ring bigint, before bigint, rows bigint"
    )
    # A row's place: those of the rings before, and a hash within its own.
    spread = F.pmod(F.xxhash64("id"), F.col("rows"))
    train_side = (
        placed.join(F.broadcast(starts), "ring")
        .withColumn("train_block", F.floor((F.col("before") + spread) * train_blocks / n_rows).cast("int"))
        .withColumn("test_block", every(test_blocks))
        .select("train_block", "test_block", "ring", "id", "label", "vector")
    )
    test_side = (
        routed.withColumn("test_block", F.pmod(F.xxhash64("id"), F.lit(test_blocks)).cast("int"))
        .withColumn("train_block", every(train_blocks))
        .select("train_block", "test_block", "id", "vector", "wanted")
    )
    ring_ids = ring_table[:, 0].astype(np.int64)

    def closest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbour": [], "label": [], "dist": []})
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values("id", ignore_index=True)
        number = np.searchsorted(ring_ids, rows["ring"].to_numpy())
        bits = np.frombuffer(b"".join(queries["wanted"]), np.uint8).reshape(len(queries), -1)
        wanted = np.unpackbits(bits, axis=1, count=len(ring_ids)).astype(bool)
        here = np.unique(number)
        wanted = wanted[:, here]
        asked = np.flatnonzero(wanted.any(axis=1))
        if not len(asked):
            return empty
        needed = np.flatnonzero(np.isin(number, here[wanted.any(axis=0)]))
        left, right = _matrix(queries["vector"].iloc[asked]), _matrix(rows["vector"].iloc[needed])
        best, dist = _closest(left, right, k)
        best = needed[best]
        return pd.DataFrame(
            {
                "query": np.repeat(queries["id"].to_numpy()[asked], best.shape[1]),
                "neighbour": rows["id"].to_numpy()[best].ravel(),
                "label": rows["label"].to_numpy()[best].ravel(),
                "dist": dist.ravel(),
            }
        )

    # A number of its own for each meeting, so that the meetings go to as many tasks.
    groups = ["train_block", "test_block"]
    tasks = train_blocks * test_blocks
    candidates = (
        test_side.repartition(tasks, *groups).groupBy(*groups)
        .cogroup(train_side.repartition(tasks, *groups).groupBy(*groups))
        .applyInPandas(closest, "query bigint, neighbour bigint, label double, dist double")
    )
    order = Window.partitionBy("query").orderBy("dist", "neighbour")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def vote(neighbours: DataFrame, task: str) -> DataFrame:
    """``query, prediction``: the neighbours' mean, or their most frequent class (the smallest
    of equally frequent ones)."""
    if task == REGRESSION:
        return neighbours.groupBy("query").agg(F.avg("label").alias("prediction"))
    counts = neighbours.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("query").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("prediction")
    )
