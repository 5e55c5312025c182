"""Near-duplicate embeddings by product quantisation.

Every distinct vector lies in the inverted list of its nearest coarse centre, as a code of its residual: one
byte for each subspace. A vector asks its own list and every list whose border lies near it. In a list its residual
makes a table of squared distances to the codewords of each subspace, and the sum of looked-up entries is the
distance to a coded vector. How far a code is from its vector is stored with it, so by the
triangle inequality the table leaves out no pair within the radius. What is left is compared by exact cosine.

Recall depends on the probes alone. A pair is found if either side asks the other's list. Two vectors of the
wanted cosine are at most ``radius`` apart; a list is asked if the plane between its centre and the nearest one
is at most a part of the radius away. In ``d`` dimensions a step of the radius in a random direction
moves toward that plane by ``1 / sqrt(d)`` of it (root mean square), so the part is ``REACH / sqrt(d)``, with ``d`` the
dimension that the sample really has (the participation ratio of its variances), and 1 at most: then no list
that can hold a partner is left out. At 2.0, 2,000 of 2,000 partners at cosine 0.9501 are found in 64 dimensions,
where some seven lists are asked whether there are 450 or 1,800.

Long lists are cut into blocks, each two blocks of stored and asking rows being a task. A task gives back
counts and a star of each connected part, not pairs. Equal vectors are compared once and counted by number.
A missing, zero or not finite vector links with nothing; shorter vectors count as filled up with zeros. Repeated
rows are vectors of their own, which link with each other. A missing key counts as no smallest key; it
names a class only where no other does.
"""

from __future__ import annotations

from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import saved
from tenc.llm.graph import components
from tenc.llm.vectors import as_matrix, complete, packed, unpacked

# Vectors that centres and codewords are fitted on, the first by a hash of the vector; every vector is indexed.
SAMPLE_ROWS = 20_000
MAX_LISTS, SUBSPACES, CODEWORDS = 4096, 16, 256
REACH = 2.0
# Stored or asking rows of a task, on average.
BLOCK_ROWS = 2048
# Rows compared with the centres at a time.
_BATCH, _ROUNDS, _SEED = 1024, 8, 42
# Added to bounds, for the rounding of single precision.
_SLACK = 1e-4


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _lloyd(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    for _ in range(_ROUNDS):
        nearest = np.concatenate(
            [np.argmin(_squared(points[i : i + _BATCH], centres), axis=1) for i in range(0, len(points), _BATCH)]
        )
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _apart(points: np.ndarray, wanted: int, gap: float) -> np.ndarray:
    """At most ``wanted`` of ``points``, none nearer than ``gap`` to another: a dense spot gets few centres."""
    chosen: list[int] = []
    nearest = np.full(len(points), np.inf)
    for i in range(len(points)):
        if nearest[i] > gap * gap:
            chosen.append(i)
            nearest = np.minimum(nearest, _squared(points, points[i : i + 1])[:, 0])
            if len(chosen) == wanted:
                break
    return points[chosen]


class Index:
    """Coarse centres and the codewords of each subspace, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, radius: float):
        self.radius = radius
        random = np.random.default_rng(_SEED)
        points = sample[random.permutation(len(sample))]
        wanted = min(MAX_LISTS, max(1, ceil(2 * sqrt(n))), max(1, len(points) // 4))
        self.centres = _lloyd(points, _apart(points, wanted, 2 * radius))
        width = points.shape[1]
        self.cuts = [c for c in np.array_split(np.arange(width), min(SUBSPACES, width)) if len(c)]
        variances = np.linalg.eigvalsh(np.atleast_2d(np.cov(points.T))) if len(points) > 1 else np.zeros(1)
        squares = (variances**2).sum()
        self.dimension = max(variances.sum() ** 2 / squares, 1.0) if squares > 0 else 1.0
        home = self.nearest(points)
        residual = points - self.centres[home]
        self.words = []
        for cut in self.cuts:
            part = residual[:, cut]
            first = part[random.choice(len(part), min(CODEWORDS, len(part)), replace=False)]
            self.words.append(_lloyd(part, first).astype(np.float32))

    def nearest(self, units: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [np.argmin(_squared(units[i : i + _BATCH], self.centres), axis=1) for i in range(0, len(units), _BATCH)]
        ) if len(units) else np.zeros(0, np.int64)

    def probes(self, units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list of each row, and pairs of a row and another list that it asks."""
        part = min(1.0, reach / sqrt(self.dimension))
        rows, lists, homes = [], [], []
        for start in range(0, len(units), _BATCH):
            d = _squared(units[start : start + _BATCH], self.centres)
            home = np.argmin(d, axis=1)
            own = d[np.arange(len(d)), home]
            gap = np.sqrt(_squared(self.centres[home], self.centres))
            # Distance to the plane between two centres: half the difference of squares over their gap.
            near = d - own[:, None] <= 2 * part * self.radius * gap + 1e-9
            near[np.arange(len(d)), home] = False
            r, c = np.nonzero(near)
            rows.append(r + start), lists.append(c), homes.append(home)
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(lists)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each code's point is from its residual."""
        codes = np.zeros((len(residual), len(self.cuts)), np.uint8)
        error = np.zeros(len(residual))
        for j, (cut, words) in enumerate(zip(self.cuts, self.words)):
            d = _squared(residual[:, cut], words.astype(float))
            codes[:, j] = np.argmin(d, axis=1)
            error += d[np.arange(len(d)), codes[:, j]]
        return codes, np.sqrt(error)

    def table_distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances: rows of ``residual`` to coded vectors, by looking up each subspace."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for j, (cut, words) in enumerate(zip(self.cuts, self.words)):
            table = _squared(residual[:, cut].astype(np.float32), words)
            total += table[:, codes[:, j]]
        return total


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; components are scaled first, so that no square overflows or vanishes."""
    top = np.abs(vectors).max(axis=1, initial=0)
    scaled = vectors / np.where(top > 0, top, 1)[:, None]
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1), 1e-300)[:, None]


def _pack(batches, width: int, kind: str):
    for batch in batches:
        matrix = as_matrix(batch.column("vector"), width, np.dtype(kind).type)
        # Both zeros are the same number.
        yield pa.RecordBatch.from_arrays([batch.column("id"), packed(matrix + 0)], ["id", "vector"])


def _spread(batches, index: Index, kind: str, reach: float):
    """A row for each list that a vector lies in or asks."""
    width = index.centres.shape[1]
    for whole in batches:
        for at in range(0, whole.num_rows, _BATCH):
            batch = whole.slice(at, _BATCH)
            units = _units(unpacked(batch.column("vector"), width, kind).astype(float))
            home, row, asked = index.probes(units, reach)
            codes, error = index.encode(units - index.centres[home])
            every = np.concatenate([np.arange(len(home)), row])
            order = np.argsort(row, kind="stable")
            counts = np.bincount(row, minlength=len(home))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            probed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(asked[order].astype(np.int32)))
            take = pa.array(every)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([home, asked]).astype(np.int32)),
                    pa.array(home.astype(np.int32)).take(take), batch.column("node").take(take),
                    batch.column("copies").take(take), batch.column("vector").take(take),
                    packed(codes).take(take), pa.array(error.astype(np.float32)).take(take), probed.take(take),
                ],
                ["list", "home", "node", "copies", "vector", "code", "error", "probed"],
            )


def _stars(linked: np.ndarray) -> np.ndarray:
    """For asking rows (first) and stored columns (after them), the first of each one's connected part."""
    n, m = linked.shape
    root = np.full(n + m, -1)
    for i in np.flatnonzero(linked.any(axis=1)):
        if root[i] >= 0:
            continue
        rows, root[i] = np.array([i]), i
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & (root[n:] < 0))
            root[n + columns] = i
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & (root[:n] < 0)) if len(columns) else columns
            root[rows] = i
    return root


def _compare(key, asking: pa.Table, stored: pa.Table, index: Index, cosine: float, kind: str) -> pa.Table:
    """Links of one block of asking rows with one block of stored rows of a list.

    Gives rows ``node``, ``other``, ``links``: either a part of a count (``other`` missing) or an edge.
    """
    names = ["node", "other", "links"]
    empty = pa.table({n: pa.array([], pa.int64()) for n in names})
    if not asking.num_rows or not stored.num_rows:
        return empty
    width = index.centres.shape[1]
    here = asking.column("list")[0].as_py()
    a_units = _units(unpacked(asking.column("vector").combine_chunks(), width, kind).astype(float))
    s_units = _units(unpacked(stored.column("vector").combine_chunks(), width, kind).astype(float))
    codes = unpacked(stored.column("code").combine_chunks(), len(index.cuts), "u1")
    error = stored.column("error").to_numpy()
    a_node, s_node = asking.column("node").to_numpy(), stored.column("node").to_numpy()
    limit = (index.radius + error + _SLACK) ** 2
    close = index.table_distances(a_units - index.centres[here], codes) <= limit[None, :]
    close &= a_node[:, None] != s_node[None, :]
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return empty
    linked = (a_units[rows] @ s_units[columns].T >= cosine) & close[np.ix_(rows, columns)]
    if not linked.any():
        return empty
    a_copies = asking.column("copies").to_numpy()[rows]
    s_copies = stored.column("copies").to_numpy()[columns]
    # A stored row that does not ask the other's list itself has the link counted here.
    home = asking.column("home").to_numpy()[rows]
    probed = stored.column("probed").combine_chunks().take(pa.array(columns))
    owner = np.repeat(np.arange(len(columns)), probed.value_lengths().to_numpy())
    asks = np.zeros((len(columns), len(index.centres)), bool)
    asks[owner, probed.flatten().to_numpy()] = True
    asks[:, here] = True
    unseen = linked & ~asks[:, home].T
    nodes = np.concatenate([a_node[rows], s_node[columns]])
    counts = np.concatenate([linked @ s_copies, a_copies @ unseen])
    root = _stars(linked)
    part = np.flatnonzero((root >= 0) & (root != np.arange(len(root))))
    some = np.flatnonzero(counts)
    node = np.concatenate([nodes[some], nodes[root[part]]])
    other = pa.array(
        np.concatenate([np.zeros(len(some), np.int64), nodes[part]]),
        mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(part), bool)]),
    )
    links = np.concatenate([counts[some], np.zeros(len(part), np.int64)])
    return pa.table({"node": pa.array(node), "other": other, "links": pa.array(links.astype(np.int64))})


def _linked(vectors: DataFrame, index: Index, cosine: float, kind: str, reach: float, block: int) -> DataFrame:
    """Counts and edges of all lists, block by block."""
    spread = saved(
        vectors.mapInArrow(
            partial(_spread, index=index, kind=kind, reach=reach),
            "list int, home int, node long, copies long, vector binary, code binary, error float, probed array<int>",
        ),
        "lists",
    )
    # One row a list, of which there are MAX_LISTS at most.
    sizes = spread.groupBy("list").agg(
        F.ceil(F.count_if(F.col("list") == F.col("home")) / block).cast("int").alias("stores"),
        F.ceil(F.count("*") / block).cast("int").alias("asks"),
    )
    placed = spread.join(F.broadcast(sizes), "list")

    def own(n, salt):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asking = placed.where("stores > 0").withColumn("ask", own("asks", 1)).withColumn("store", every("stores"))
    stored = placed.where("list = home").withColumn("store", own("stores", 2)).withColumn("ask", every("asks"))
    # Both sides come from one table; new names of one side's columns tell them apart.
    stored = stored.select(*[F.col(c).alias(c) for c in stored.columns])
    keys = ["list", "store", "ask"]
    compare = partial(_compare, index=index, cosine=cosine, kind=kind)
    return asking.drop("code", "error", "probed").groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(
        lambda key, left, right: compare(key, left, right), "node long, other long, links long"
    )


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95,
    reach: float = REACH, block: int = BLOCK_ROWS,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row: links are pairs of at least ``cosine``."""
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    good = complete("vector") & F.exists("vector", lambda x: x != 0)
    alone = plain.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    fit = plain.where(good)
    width = fit.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return _named(alone, key)
    base = saved(fit.mapInArrow(partial(_pack, width=width, kind=kind), "id long, vector binary"), "vectors")
    # Numbers are given when the groups are written; from then on they stay.
    groups = saved(
        base.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    drawn = groups.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = _units(unpacked(drawn.column("vector").combine_chunks(), width, kind).astype(float))
    index = Index(sample, groups.count(), sqrt(max(2 - 2 * cosine, 0)))
    found = saved(_linked(groups.select("node", "copies", "vector"), index, cosine, kind, reach, block), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    roots = components(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    named = (
        groups.select("node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    result = saved(
        named.join(smallest, "root").select(
            "node", "first", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "classes",
    )
    single = result.where("copies = 1").select(F.col("first").alias("id"), "n_links", "component_id")
    several = result.where("copies > 1").join(groups.select("node", "vector"), "node").select("vector", "n_links", "component_id")
    repeated = base.join(several, "vector").select("id", "n_links", "component_id")
    return _named(single.unionByName(repeated).unionByName(alone), key)


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
