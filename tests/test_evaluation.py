"""Splits, metrics, neighbours, similarity balls, drawn categories."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenc.functions import similarity as S
from tenc.operators import allpairs, blocks, editballs, metrics, neighbours, similarity, synth
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION
from tenc.operators.scaling import fit_scaling
from tenc.operators.splits import class_sizes, shuffle_split, stratified_split
from tenc.operators.weights import add_class_weights


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("most").alias("y"),
    ).cache()


def test_shuffle_split_sizes_and_stability(rows):
    split = shuffle_split(rows, "k", 4, 1 / 3)
    per_fold = split.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert all((r.n, r.t) == (1000, 334) for r in per_fold) and len(per_fold) == 4
    marks = lambda s: {(r.fold, r.k): r.is_test for r in s.collect()}
    assert marks(split) == marks(shuffle_split(rows.repartition(7, "y"), "k", 4, 1 / 3))
    tests = {f: {k for (g, k), t in marks(split).items() if g == f and t} for f in range(4)}
    assert tests[0] != tests[1]


def test_stratified_split_keeps_class_shares(rows):
    sizes = {r["class"]: (r.n, r.take) for r in class_sizes(rows, "y", 1 / 3).collect()}
    assert sum(t for _, t in sizes.values()) == 334
    assert all(abs(t - n / 3) <= 1 for n, t in sizes.values())
    split = stratified_split(rows, "k", "y", 3, 1 / 3)
    found = split.where("is_test").groupBy("fold", "y").count().collect()
    assert all(r["count"] == sizes[r.y][1] for r in found) and len(found) == 9


def average_precision(points):
    hits = seen = 0
    score, total = 0.0, sum(y for _, y in points)
    for s in sorted({s for s, _ in points}, reverse=True):
        here = [y for t, y in points if t == s]
        hits, seen = hits + sum(here), seen + len(here)
        score += sum(here) / total * hits / seen
    return score


def test_average_precision_worked_value(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(df, "y", "s").first().score == pytest.approx(5 / 6)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_average_precision_with_ties_and_groups(spark, ranges):
    draw = random.Random(ranges)
    points = [(g, round(draw.random(), 2), int(draw.random() < 0.3)) for g in (0, 1) for _ in range(400)]
    df = spark.createDataFrame(points, "g int, s double, y int")
    found = {r.g: r.score for r in metrics.average_precision(df, "y", "s", ["g"], ranges).collect()}
    for g in (0, 1):
        assert found[g] == pytest.approx(average_precision([(s, y) for h, s, y in points if h == g]))


def test_r2_and_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 2, 3])
    expected = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert metrics.r2_score(df, "y", "p").first().score == pytest.approx(expected)
    missing = df.union(spark.createDataFrame([(90.0, None), (None, 3.0)], df.schema))
    assert metrics.r2_score(missing, "y", "p").first().score == pytest.approx(expected)
    assert metrics.r2_score(missing.where("p is null"), "y", "p").first().score is None
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.r2_score(constant, "y", "p").first().score == 1.0
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None)], "y string, p string")
    assert metrics.accuracy_score(labels, "y", "p").first().score == pytest.approx(1 / 3)


def test_class_weights(rows):
    out = {r.y: r.weight for r in add_class_weights(rows, "y").select("y", "weight").distinct().collect()}
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert out == pytest.approx({y: 1000 / (3 * n) for y, n in counts.items()})


def test_scaling_leaves_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert fit_scaling(df, ["a", "b"]).deviations == {"a": 1.0, "b": 1.0}


@pytest.mark.parametrize(("n_pivots", "block_rows", "copies"), [(1, 4096, 1), (7, 16, 1), (5, 8, 60)])
def test_nearest_equals_brute_force(spark, n_pivots, block_rows, copies):
    draw = np.random.default_rng(copies)
    train = draw.normal(size=(180, 6))
    train[:copies] = train[0]
    test = draw.normal(size=(40, 6))
    test[:10] = train[0]
    frame = lambda x, first: spark.createDataFrame(
        [(first + i, v.tolist(), float(i % 3)) for i, v in enumerate(x)],
        "id long, v array<double>, label double",
    )
    found = neighbours.nearest(
        frame(train, 0), frame(test, 1000), "id", "v", "label", 5, n_pivots, block_rows
    ).collect()
    dist = np.sqrt(((test[:, None, :] - train[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(test)):
        best = sorted(range(len(train)), key=lambda j: (dist[i, j], j))[:5]
        mine = sorted((r.place, r.neighbour) for r in found if r["query"] == 1000 + i)
        assert [n for _, n in mine] == best


def test_votes(spark):
    rows = [(1, 2.0), (1, 2.0), (1, 0.0), (1, 0.0), (1, 5.0), (2, 1.0)]
    df = spark.createDataFrame(rows, "query long, label double")
    assert {r["query"]: r.prediction for r in neighbours.vote(df, MULTICLASS).collect()} == {1: 0.0, 2: 1.0}
    assert {r["query"]: r.prediction for r in neighbours.vote(df, REGRESSION).collect()} == pytest.approx({1: 1.8, 2: 1.0})


def test_string_similarities(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("", ""), ("ab", "ab"), ("kitten", "sitting")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(S.gram_similarity(a, b), S.jaccard_similarity(a, b), S.sorensen_similarity(a, b), S.levenshtein_similarity(a, b)).collect()
    assert list(rows[0]) == pytest.approx([1 / 3, 3 / 5, 6 / 8, 3 / 4])
    assert list(rows[1]) == [1.0] * 4 and list(rows[2]) == [1.0] * 4
    assert rows[3][3] == pytest.approx(1 - 3 / 7)


def grams(text):
    return {text[i : i + 3] for i in range(max(len(text) - 2, 1))}


@pytest.fixture(scope="module")
def words(spark):
    draw = random.Random(11)
    parts = ["north", "south", "wind", "ow", "shore", "line", "a", "road"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(160)]
    return texts, spark.createDataFrame([(t,) for t in texts], "w string")


def brute_similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_ball_counts_equal_all_pairs(words):
    texts, df = words
    bins = [0.0, 0.1, 0.35, 0.5, 0.9, 1.0]
    found = {r.bin: (r.n_pairs, r.per_row) for r in similarity.ball_counts(df, "w", bins).collect()}
    distinct = set(texts)
    for b in bins:
        n = sum(brute_similarity(t, d) >= b - 1e-9 for t in texts for d in distinct)
        assert found[b] == (n, pytest.approx(n / len(texts)))


def test_balls_by_value_equal_all_pairs(words):
    texts, df = words
    radii = [0.6, 0.0, 0.25, 1.0]
    found = {(r.value, r.radius): r.n for r in similarity.ball_by_value(df, "w", radii).collect()}
    distinct = set(texts)
    for t in distinct:
        for radius in radii:
            n = sum(1 - brute_similarity(t, d) <= radius + 1e-9 for d in distinct)
            assert found[t, radius] == n


def test_similar_pairs_need_a_positive_threshold(words):
    with pytest.raises(ValueError):
        similarity.similar_pairs(words[1].select(F.col("w").alias("value")), 0.0)


def brute_edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b), 1)


def edited_texts():
    """Names with none to several edits, short and long ones, wide characters, and one common beginning."""
    rng, texts = random.Random(5), {"", "a", "ab", "ba", "日本語", "日本", "e\u0301tude"}
    for n in (1, 2, 3, 5, 8, 13, 21):
        for _ in range(6):
            name = [rng.choice("abc") for _ in range(n)]
            texts.add("".join(name))
            for _ in range(4):
                where, what = rng.randrange(len(name)), rng.randrange(3)
                name[where:where + (what != 0)] = [rng.choice("abcd")] if what != 1 else []
                name = name or ["a"]
                texts.add("".join(name))
    return sorted(texts | {f"https://x.example/{i % 7}/{i}" for i in range(60)})


@pytest.mark.parametrize("threshold", [0.51, 0.6, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("block_rows", [3, 2000])
def test_edit_pairs_equal_all_pairs(spark, threshold, block_rows):
    texts = edited_texts()
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = similarity.similar_pairs(df, threshold, "levenshtein", block_rows).collect()
    expected = {
        (a, b): s for a in texts for b in texts
        if a != b and (s := brute_edit_similarity(a, b)) >= threshold - 1e-9
    }
    assert len(rows) == len(expected)
    assert {(r.left, r.right): r.sim for r in rows} == pytest.approx(expected)


def test_gram_pairs_in_blocks_come_out_once(spark):
    texts = [f"https://shared.example/{i % 5}/{i}" for i in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    for block_rows in (4, 2000):
        rows = similarity.similar_pairs(df, 0.5, block_rows=block_rows).collect()
        assert len(rows) == len({(r.left, r.right) for r in rows})
        assert {(r.left, r.right) for r in rows} == {
            (a, b) for a in texts for b in texts if a != b and brute_similarity(a, b) >= 0.5 - 1e-9
        }


def test_blocks_bound_the_rows_of_a_hot_key(spark):
    """One key in every row: no group of the join is larger than a few blocks."""
    left = spark.range(300).select(F.lit("k").alias("key"), F.col("id").alias("a"))
    right = spark.range(300).select(F.lit("k").alias("key"), F.col("id").alias("b"))
    joined = blocks.join_in_blocks(left, right, "key", "a", "b", 20)
    assert joined.count() == 90_000 and joined.distinct().count() == 90_000
    dealt = left.groupBy(F.pmod(F.xxhash64("a"), F.lit(15))).count().agg(F.max("count")).first()[0]
    assert dealt < 60


def test_edit_similarity_needs_more_than_a_half(words):
    with pytest.raises(ValueError):
        similarity.similar_pairs(words[1].select(F.col("w").alias("value")), 0.5, "levenshtein")


def test_zipf_law(spark):
    rows = synth.zipf_pmf(spark, 50, 1.5).orderBy("category").collect()
    total = sum(i**-1.5 for i in range(1, 51))
    assert [r.p for r in rows] == pytest.approx([i**-1.5 / total for i in range(1, 51)])


def test_drawn_categories_follow_the_class(spark, rows):
    classes = ["most", "rare", "some"]
    weights = spark.createDataFrame(
        [(i, c, 1.0 if (i % 3) == j else 0.0) for i in range(1, 31) for j, c in enumerate(classes)],
        "category long, class string, weight double",
    )
    drawn = synth.category_given_target(rows, "k", "y", 30, 0.2, weights, "cat").collect()
    assert len(drawn) == 1000
    assert all(classes[r.cat % 3] == r.y for r in drawn)
    again = synth.category_given_target(rows.repartition(5), "k", "y", 30, 0.2, weights, "cat").collect()
    assert {(r.k, r.cat) for r in drawn} == {(r.k, r.cat) for r in again}


def test_preset_of_drawn_columns(rows):
    out = synth.categories_given_target(rows, "k", "y", ["most", "rare", "some"], **synth.RANDOM_PRESET)
    row = out.agg(F.max("cat1"), F.max("cat2"), F.max("cat3"), F.count("cat1")).first()
    assert row[0] <= 100 and row[1] <= 10 and row[2] <= 3 and row[3] == 1000
    assert not math.isnan(row[0])


def test_bootstrap_intervals(spark):
    from tenc.plans.reports import POISSON_CUTS, score_interval

    rng = np.random.default_rng(5)
    rows = [(f"r{i}", i % 2, float(rng.normal(i % 2, 1)), i) for i in range(400)] + [("r0", 0, None, 999)]
    df = spark.createDataFrame(rows, "name string, threshold int, score double, fold int").withColumn("encoder", F.lit("e"))
    found = {r["threshold"]: r for r in score_interval(df, "encoder", ["name", "fold"]).collect()}
    again = score_interval(df.repartition(7), "encoder", ["name", "fold"]).collect()
    for r in again:
        assert (r["low"], r["high"]) == pytest.approx((found[r["threshold"]]["low"], found[r["threshold"]]["high"]))
    for t in (0, 1):
        values = np.array([s for _, g, s, _ in rows if g == t and s is not None])
        means = [rng.choice(values, len(values)).mean() for _ in range(4000)]
        assert found[t]["n"] == len(values) and found[t]["mean"] == pytest.approx(values.mean())
        assert [found[t]["low"], found[t]["high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.03)
    one = spark.createDataFrame([("a", 1, 0.5, 1)], "name string, threshold int, score double, fold int").withColumn("encoder", F.lit("e"))
    only = score_interval(one, "encoder", ["name", "fold"]).first()
    assert (only["low"], only["mean"], only["high"]) == (0.5, 0.5, 0.5)
    assert POISSON_CUTS[0] == pytest.approx(math.exp(-1)) and 1 - POISSON_CUTS[-1] < 1e-8


def _addresses(n: int) -> list[str]:
    return [f"http{'s' * (i % 2)}://h{i % 3}.example.com/{'é' if i % 5 else '😀'}/{i * 37}{'#top' * (i % 4)}" for i in range(n)]


@pytest.mark.parametrize("similarity_name, levels", [("3-gram", [0.6, 0.8, 1.0]), ("levenshtein", [0.7, 0.9, 1.0])])
def test_crowded_balls_are_counted_without_a_list_of_pairs(spark, monkeypatch, similarity_name, levels):
    """Nearly every address is near many others: listing the pairs is the square of the rows on disk."""
    texts = [*_addresses(330), "", "a", "ab", "x" * 70, "x" * 64 + "y", "x" * 130]
    df = spark.createDataFrame([(t,) for t in texts], "w string").withColumn("id", F.monotonically_increasing_id())
    values = df.select("id", F.col("w").alias("value"))
    listed = similarity._both_ways(similarity._PAIRS[similarity_name](values, levels[0]))
    expected = {
        r["l_id"]: [r[f"n{k}"] for k in range(3)]
        for r in listed.groupBy("l_id").agg(
            *[F.sum((F.col("sim") >= t - 1e-9).cast("long")).alias(f"n{k}") for k, t in enumerate(levels)]
        ).collect()
    }
    for block_texts in (16_384, 50):
        found = allpairs.count_partners(values, len(texts), levels, similarity_name, block_texts).collect()
        assert len(found) == len(texts)
        assert {r["id"]: [r["_0"], r["_1"], r["_2"]] for r in found if r["_0"]} == expected
    monkeypatch.setattr(similarity, "_PAIRS", {})
    monkeypatch.setattr(similarity, "FEW_VALUES", 0)
    rows = similarity.ball_counts(df, "w", levels, similarity_name).collect()
    assert {r.bin: r.n_pairs for r in rows} == {
        t: sum(e[k] for e in expected.values()) + len(texts) for k, t in enumerate(levels)
    }


def test_edit_distances_of_shared_beginnings_and_long_texts():
    texts = ["", "kitten", "sitting", *["ab" * 40 + c for c in "abcdefghij"], *["ab" * 32 + c for c in "xyz"], "ba" * 70]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    table = allpairs.EditTable(allpairs.Texts(texts), allpairs.Texts(texts))
    assert table.depth.max() >= 64
    assert table.distances(i, j).tolist() == [plain(texts[a], texts[b]) for a, b in zip(i, j)]


def test_nearest_of_a_block_by_products_and_by_differences():
    """Far from the origin products of vectors round away what the differences still tell."""
    rng = np.random.default_rng(11)
    for shift in (0.0, 1e7):
        rows = np.round(rng.normal(size=(300, 6)), 2) + shift
        rows[100:120] = rows[7]
        queries = np.concatenate([rows[:40], np.round(rng.normal(size=(20, 6)), 2) + shift])
        dist = np.sqrt(((queries[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
        expected = np.argsort(dist, axis=1, kind="stable")[:, :5]
        places, found = neighbours._closest(queries, rows, 5)
        assert (places == expected).all() and np.array_equal(found, np.take_along_axis(dist, expected, axis=1))
    assert neighbours._closest(queries[:2], rows[:3], 5)[0].shape == (2, 3)


def test_a_query_travels_once_to_a_block_and_not_to_each_ring(spark):
    """Vectors without structure leave out no ring; each side is still dealt to the other's few blocks only."""
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3), rng.normal(size=8).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, label double, v array<double>")
    nearest = neighbours.nearest(df.where("id >= 300"), df.where("id < 300"), "id", "v", "label", 5, 16, 300)
    assert "explode(rings" not in nearest._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in nearest.collect():
        found.setdefault(r["query"], []).append((r["place"], r["neighbour"]))
    v = np.array([r[2] for r in rows])
    for q in range(300):
        dist = np.sqrt(((v[300:] - v[q]) ** 2).sum(axis=1))
        assert [n for _, n in sorted(found[q])] == (300 + np.argsort(dist, kind="stable")[:5]).tolist()


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("longest, few, levels", [(12, 1, [0.55, 0.8]), (40, 1, [0.55, 0.7, 1.0]), (90, 1, [0.7, 0.9]), (40, 999, [0.7, 0.9])])
def test_hits_by_edit_distance_of_lanes_of_any_length(monkeypatch, longest, few, levels):
    """Lanes of mixed lengths against texts of any, with shared beginnings and endings; few lanes go pair by pair."""
    monkeypatch.setattr(editballs, "_FEW_LANES", few)
    monkeypatch.setattr(editballs, "_ENDING_BYTES", 4000)
    if few == 1:
        monkeypatch.setattr(editballs, "_by_pairs", None)
    rng = np.random.default_rng(longest)
    texts = sorted({
        "".join(rng.choice(list("ab"), rng.integers(0, longest + 1))) + rng.choice(["", "#top", "/é😀"]) for _ in range(110)
    })
    rights, both = texts[::2] + ["", "b" * 3 * longest], np.arange(len(texts[::2]) + 2) % 3 > 0
    sim = np.array([[1 - _edit_distance(a, b) / max(len(a), len(b), 1) for b in rights] for a in texts])
    left_hits, right_hits = editballs.count_hits(texts, rights, both, levels)
    for k, level in enumerate(levels):
        near = sim >= level - 1e-9
        assert left_hits[k].tolist() == near.sum(axis=1).tolist()
        assert right_hits[k].tolist() == (near.sum(axis=0) * both).tolist()


def test_blocks_of_one_length_meet_only_blocks_that_are_near_in_length():
    lengths = {10: 3000, 11: 3000, 30: 3000, 31: 3000}
    blocks, dealing, parts = allpairs._edit_meetings(lengths, editballs.most_edits(31, 0.8), 1500, 8)
    assert blocks == 8 and len(parts) == 8
    first = {size: block for size, _, _, block in dealing}
    # Texts of 30 characters meet none of the four blocks of texts of 10 and 11.
    assert first == {10: 0, 11: 0, 30: 4, 31: 4}
    assert sum(n for _, _, n, _ in dealing) == 12000 and min(parts) >= 1
