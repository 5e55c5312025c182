import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenc.llm import negatives, pq

SCHEMA = "vec_id long, embedding array<float>, label int, links long, id string, node int"


def embeddings(spark, rows):
    return spark.createDataFrame([(k, v, l, 1, "x", None) for k, v, l in rows], SCHEMA)


def odd():
    return [
        (1001, None, 1), (1002, [], 1), (1003, [float("nan"), 1.0], 1), (1004, [float("inf"), 1.0], 2),
        (1005, [None, 1.0], 3), (1006, [0.0, 0.0, 0.0], 4), (None, [1.0, 0.0], 4), (1007, [1.0], None),
    ]


def brute_negatives(rows, anchors, n_positives=5, n_negatives=10, low=30, high=90):
    once = {}
    for k, v, label in rows:
        if k is None or v is None or label is None or not all(x is not None and np.isfinite(np.float32(x)) for x in v):
            continue
        label = (label + 1) % 10 if k % 7 == 0 else label
        ints = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        once[k] = min(once.get(k, (label, ints)), (label, ints))
    found = []
    for a in sorted(k for k in once if anchors(k)):
        label, v = once[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k) for k, (_, w) in once.items() if k != a)
        for p, positive in [(-s, k) for s, k in scored if once[k][0] == label][:n_positives]:
            window = [(-s, k) for s, k in scored if once[k][0] != label and low * p <= -100 * s <= high * p]
            found += [(a, positive, i + 1, k, p, s) for i, (s, k) in enumerate(window[:n_negatives])]
    return sorted(found)


def random_rows(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        v = spots[i % 5] + spread * rng.normal(size=width)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(10))))
    return rows


@pytest.mark.parametrize("spread", [0.1, 1.0, 5.0])
def test_negatives_equal_brute_force(spark, monkeypatch, spread):
    """Tight and loose clusters, many chunks and groups, short steps: the certificate must hold."""
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 150)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 7)
    monkeypatch.setattr(negatives, "ANCHORS_A_CENTRE", 4)
    monkeypatch.setattr(negatives, "FIRST_STEP", 8)
    monkeypatch.setattr(negatives, "LAST_STEP", 32)
    rows = random_rows(500, 12, 1, spread) + odd()
    rows += [(i, rows[0][1], 5) for i in range(600, 640)] + [rows[3], (20, rows[5][1], 2), (20, rows[6][1], 1)]
    vectors = negatives.from_embeddings(embeddings(spark, rows))
    found = negatives.hard_negatives(vectors, F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, lambda k: k % 20 == 0)


def test_walks_end_early_in_clustered_data():
    rng = np.random.default_rng(3)
    spots = np.eye(8)[np.arange(4000) % 8] * 1000
    items = np.round(spots + rng.normal(size=(4000, 8)) * 5).astype(np.int64)
    seen = []

    class Counted(negatives._Scores):
        def __call__(self, rows, members):
            seen.append(len(rows) * len(members))
            return super().__call__(rows, members)

    scores = Counted(items, items[:80])
    scores.keys = np.arange(4000)
    centre = items[0] / np.linalg.norm(items[0])
    members = np.arange(0, 80, 8)
    size = np.linalg.norm(items, axis=1)
    angle = np.arccos(np.clip(items @ centre / size, -1, 1))
    bound = size * np.cos(np.clip(angle - angle[members].max() - 1e-6, 0, np.pi))
    order = np.argsort(-bound, kind="stable")

    def wanted(rows, active, product, least):
        at, member = np.nonzero(product >= least[active, 0][None, :])
        return active[member], np.zeros(len(at), np.int64), rows[at], product[at, member]

    place, row, value = negatives._walk(
        scores, order, bound[order], members, size[members], 5, wanted, np.full((len(members), 1), -np.inf)
    )
    assert sum(seen) < 0.3 * 4000 * len(members)
    for m in range(len(members)):
        expected = sorted(((-int(items[i] @ items[members[m]]), i) for i in range(4000)))[:5]
        mine = place == m
        assert sorted(zip((-value[mine]).tolist(), row[mine].tolist())) == expected


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**38 + i, 1.0 - i], i % 2) for i in range(12)]
    vectors = spark.createDataFrame([(k, [int(x) for x in v], l) for k, v, l in rows], "id long, vector array<long>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(vectors, F.col("id") == 0).collect()
    small = spark.createDataFrame([(k, [2**30 + k, 7 * k], k % 2) for k in range(12)], "id long, vector array<long>, label int")
    found = {r["positive_id"]: r["positive_score"] for r in negatives.hard_negatives(small, F.col("id") == 0, high=100).collect()}
    assert found and all(s == 2**30 * (2**30 + k) for k, s in found.items())


def test_no_rows_and_no_anchors(spark):
    empty = negatives.from_embeddings(embeddings(spark, odd()[:5]))
    assert negatives.hard_negatives(empty, F.col("id") % 100 == 0).count() == 0
    some = negatives.from_embeddings(embeddings(spark, random_rows(20, 4, 2)))
    assert negatives.hard_negatives(some, F.col("id") < 0).count() == 0
    assert negatives.hard_negatives(some.limit(1), F.col("id") >= 0).count() == 0


def brute_links(rows, cosine=0.95):
    width = max(len(v or []) for _, v, _ in rows)
    units = []
    for _, v, _ in rows:
        good = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array([*map(np.float32, v), *[0.0] * (width - len(v))], float) if good else np.full(width, np.nan)
        units.append(x / np.linalg.norm(x))
    linked = np.array(units) @ np.array(units).T >= cosine
    np.fill_diagonal(linked, False)
    root = list(range(len(rows)))
    for i, j in zip(*np.nonzero(linked)):
        a, b = root[i], root[j]
        if a != b:
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, (k, _, _) in zip(root, rows):
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return linked, sorted(
        (str(k), int(linked[i].sum()), str(least[root[i]]), k == least[root[i]]) for i, (k, _, _) in enumerate(rows)
    )


def planted(seed, n=400, width=64):
    """Random vectors, partners at a cosine just above and below the limit, a large near group, and equal vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def at(v, cosine):
        other = rng.normal(size=width)
        other -= other @ v * v
        return cosine * v + np.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)

    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(1000 + i, at(base[i], c).tolist(), 0) for i, c in enumerate(np.tile([0.951, 0.96, 0.98, 0.949, 0.9], 60))]
    rows += [(2000 + i, (3.5 * at(base[7], 0.97)).tolist(), 0) for i in range(200)]
    rows += [(3000 + i, base[11].tolist(), 0) for i in range(150)]
    return rows


@pytest.mark.parametrize("block", [64, pq.BLOCK_ROWS])
def test_links_and_classes_equal_brute_force(spark, block):
    rows = planted(4) + odd() + [(None, planted(4)[3][1], 1), (5, planted(4)[5][1], 1)]
    docs = embeddings(spark, rows).repartition(7)
    linked, expected = brute_links(rows)
    found = pq.near_duplicates(docs, block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found.collect())
    # Nothing is linked below the limit; here no link is missed either.
    assert got == expected and linked.sum() > 20_000


def test_recall_at_the_limit_and_share_of_lists_asked():
    """Partners at exactly the limit, the hardest to find: rows of every twentieth key against all rows."""
    rng = np.random.default_rng(9)
    n = 6000
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(n, 64))
    other -= (other * base).sum(axis=1)[:, None] * base
    partner = 0.9501 * base + np.sqrt(1 - 0.9501**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    every = np.concatenate([base, partner])
    index = pq.Index(every[rng.permutation(len(every))[: pq.SAMPLE_ROWS]], len(every), np.sqrt(0.1))
    home, row, asked = index.probes(every, pq.REACH)
    asks = {(int(r), int(c)) for r, c in zip(row, asked)}
    queries = range(0, n, 20)
    found = [home[i] == home[n + i] or (i, home[n + i]) in asks or (n + i, home[i]) in asks for i in queries]
    assert np.mean(found) >= 0.99
    assert 50 < index.dimension <= 64 and len(row) / len(every) < 0.05 * len(index.centres)
    # The table of distances never leaves out a near pair.
    residual = partner[:500] - index.centres[home[:500]]
    codes, error = index.encode(residual)
    mine = base[:500] - index.centres[home[:500]]
    near = np.diag(index.table_distances(mine, codes))
    assert (near <= (index.radius + error + pq._SLACK) ** 2).all()


def test_extreme_lengths_and_one_dense_spot(spark):
    rng = random.Random(2)
    rows = [(i, [1e-30 * (1 + rng.random() / 9), 1e-30], 0) for i in range(30)]
    rows += [(100 + i, [3e38, 3e38 * (1 - i / 500)], 0) for i in range(30)]
    _, expected = brute_links([(k, [x * 1e20 if x < 1 else x / 1e20 for x in v], l) for k, v, l in rows])
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in pq.near_duplicates(embeddings(spark, rows)).collect())
    assert got == expected
    assert pq.near_duplicates(embeddings(spark, rows).limit(0)).count() == 0
