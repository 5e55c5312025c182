import random
import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tenc.llm import licenses, mixing, multiset, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if count[run] > 1:
            covered.update(range(i, i + 5))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, duplicates, len(covered)


def test_quality_measures_equal_brute_force(spark, edges, nothing):
    texts = ["a b c d e f a b c d e", "a a a a a a", "x " * 4, "l1 x\nl1 x\n\n \nl2\nl1 x", "a b c d #|<>"]
    docs = edges.select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality.measured(docs.withColumn("whole", F.col("text"))).collect()
    for r in rows:
        expected = brute_measures(r["whole"])
        assert tuple(r[n] for n in names) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])
    kept = quality.passing(edges)
    assert kept.columns == edges.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5} - ({5} if brute_measures(edges.where("doc_id = 5").first()["text"])[4] else set())
    assert quality.measured(nothing).count() == 0


def test_rules_are_data(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of a house in a town is here")], "doc_id long, text string")
    strict = (quality.Rule("few_words", "n_words", None, 100, None),)
    assert quality.measured(docs, strict).first()["failed_rules"] == ["few_words"]
    assert quality.measured(docs).first()["kept"]


def prints(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r["p"] for r in rows.select("i", multiset.fingerprint(F.col("text")).alias("p")).orderBy("i").collect()]


def test_fingerprints_add_and_ignore_order(spark):
    a, b, both, swapped, none, missing, twice = prints(
        spark, ["one\ntwo", "three", "one\ntwo\nthree", "three\n\none\ntwo", "", None, "three\nthree"]
    )
    frame = spark.createDataFrame([(a, b, both)], "a array<long>, b array<long>, both array<long>")
    row = frame.select(
        multiset.plus(F.col("a"), F.col("b")).alias("sum"), multiset.minus(F.col("both"), F.col("b")).alias("left"),
        multiset.minus(F.col("both"), F.col("both")).alias("zero"),
    ).first()
    assert row["sum"] == both == swapped and row["left"] == a
    assert row["zero"] == none == missing == [0] * 43
    assert twice != b


def test_counts_wrap_without_overflow(spark):
    (huge,) = prints(spark, ["line\n" * ((1 << 20) + 3)])
    (few,) = prints(spark, ["line\n" * 3])
    assert huge == few


def test_edited_texts_and_likeness(spark, edges, nothing):
    docs = edges.select("doc_id", "text")
    rows = multiset.edited_fingerprints(docs).collect()
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    texts = [r["text"] or "" for r in order]
    expected = Counter()
    for i, (r, text) in enumerate(zip(order, texts)):
        cut = len(text) // 2
        changed = text[: len(text) - cut] + texts[(i + 1) % len(texts)][:cut]
        expected[(r["doc_id"], len(text), hashlib.sha256(changed.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert multiset.edited_fingerprints(nothing).count() == 0


def test_next_rows_over_many_blocks(spark):
    keys = [*range(0, 300, 3), 10**12, 10**12 + 7, -5]
    docs = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    rows = multiset.with_next(docs, ["text"], block_docs=8).collect()
    down = sorted(keys, reverse=True)
    assert {r["doc_id"]: r["next_text"] for r in rows} == {
        k: f"t{down[(i + 1) % len(down)]}" for i, k in enumerate(down)
    } and len(rows) == len(keys)


def test_likeness_estimates_the_share_of_paragraphs(spark):
    a = "\n".join(f"paragraph number {i}" for i in range(200))
    b = "\n".join(f"paragraph number {i}" for i in range(100, 300))
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(
        multiset.fingerprint(F.col("a")).alias("a"), multiset.fingerprint(F.col("b")).alias("b")
    )
    assert frame.select(multiset.likeness("a", "b")).first()[0] == pytest.approx(0.5, abs=0.27)


def test_one_period_runs_each_block_between_release_and_deadline(spark):
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("d", 0.0001)], "source string, weight double")
    rows = mixing.schedule(mixing.slots_of(weights, 100)).collect()
    period = rows[0]["period"]
    assert sorted(r["slot"] for r in rows) == list(range(period))
    for source, slots in {(r["source"], r["slots"]) for r in rows}:
        had = 0
        taken = {r["slot"] for r in rows if r["source"] == source}
        for t in range(period):
            had += t in taken
            assert abs(had - slots * (t + 1) / period) < 1
    for r in rows:
        assert r["turn"] * period // r["slots"] <= r["slot"] < -(-(r["turn"] + 1) * period // r["slots"])


def test_mixture_follows_weights_until_a_source_ends(spark, edges, nothing):
    rows = [(i, "x" * (5 + i % 7), "abc"[min(i % 5, 2)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "source string, weight double")
    placed = mixing.positions(docs, weights, block_chars=50, period=64).collect()
    assert len(placed) == 3000
    for source in "abc":
        own = sorted((r for r in placed if r["source"] == source), key=lambda r: r["before"])
        at = 0
        for r in own:
            assert r["before"] == at and r["block"] == at // 50 and r["release"] <= r["slot"] < r["deadline"]
            at += r["size"]
    taken = {}
    for r in placed:
        assert taken.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    end = max(r["slot"] for r in placed if r["balanced"]) + 1
    had = Counter()
    for t in range(end):
        had[taken[t][0]] += 1
        assert all(abs(had[s] - w * (t + 1) / 4) < 1 for s, w in (("a", 1), ("b", 2), ("c", 1)))
    mixed = mixing.mixed(edges)
    assert mixed.columns == edges.columns
    assert Counter(map(str, mixed.collect())) == Counter(map(str, edges.collect()))
    assert mixing.mixed(nothing).count() == 0 and mixing.positions(nothing).count() == 0


def test_licences_are_found_and_inherited(spark):
    files = [
        (1, "a/LICENSE", "intro\nReleased under the MIT License.\nend"), (2, "a/b/x.txt", "plain text of the file"),
        (3, "a/b/c/y.txt", None), (4, "d/z.txt", "by the way"), (5, "a/b/own.txt", "Licensed under CC BY-NC 4.0."),
        (6, None, "released under the mit license"), (7, "top.txt", ""), (2, "a/b/x.txt", "plain text of the file"),
        (None, "a/q", "x"), (8, "d/w.txt", "This work is licensed under the GNU General Public License, version 3."),
    ]
    rows = licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()
    found = Counter((r["file_id"], r["license"], r["found"], r["inherited_from"]) for r in rows)
    assert found == Counter({
        (1, "MIT", "own", None): 1, (2, "CC-BY-NC-4.0", "inherited", "a/b"): 2, (3, "CC-BY-NC-4.0", "inherited", "a/b"): 1,
        (4, "GPL-3.0", "inherited", "d"): 1, (5, "CC-BY-NC-4.0", "own", None): 1, (6, "MIT", "own", None): 1,
        (7, None, "none", None): 1, (None, "MIT", "inherited", "a"): 1, (8, "GPL-3.0", "own", None): 1,
    })
    empty = spark.createDataFrame([], "file_id long, path string, text string")
    assert licenses.scan(empty).count() == 0


def test_lines_without_an_anchor_cannot_be_notices():
    rows, idf, unseen, anchors = licenses.template_weights()
    for number in range(len(licenses.TEMPLATES)):
        rest = sum(w * w for n, _, word, w in rows if n == number and word not in anchors)
        assert rest**0.5 < licenses.THRESHOLD


def assert_under_one_block(weights, blocks):
    source, number = mixing.exact_order(weights, blocks)
    assert len(source) == sum(blocks) == len(set(zip(source.tolist(), number.tolist())))
    total = sum(map(Fraction, weights))
    shares = [Fraction(w) / total for w in weights]
    end = min(n / w for n, w in zip(blocks, shares) if w)
    for at, (i, k) in enumerate(zip(source.tolist(), number.tolist())):
        if shares[i] and at < end:
            assert k // shares[i] <= at < -(-(k + 1) // shares[i])
    return source


def test_exact_weights_stay_under_one_block_off():
    rng = random.Random(8)
    few = [1 / 3] + [2 / 90] * 30
    assert_under_one_block(few, [int(w * 60_000) + 2 for w in few])
    many = [1 / 3] + [2 / 15_000] * 5_000
    source = assert_under_one_block(many, [5_001] + [2] * 5_000)
    assert abs((source[:12_000] == 0).sum() - 4_000) <= 1
    odd = [rng.random() ** 4 for _ in range(50)] + [0.0]
    source = assert_under_one_block(odd, [int(w * 3_000) + 1 for w in odd[:-1]] + [7])
    assert (source[-7:] == 50).all()


def test_mixed_follows_unrounded_weights(spark):
    rows = [(i, "hot" if i < 400 else f"s{i % 400}", "x" * 10) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("hot", 1 / 3)] + [(f"s{i}", 2 / 1200) for i in range(400)], "source string, weight double")
    order = [r["source"] for r in mixing.mixed(docs, weights, block_chars=10).collect()]
    assert all(abs(order[:t].count("hot") - t / 3) < 1.000001 for t in range(1201))


def test_weights_given_twice_or_not_finite(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x" * 50) for i in range(20)], "doc_id long, source string, text string")
    weights = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", float("nan")), ("b", float("inf")), ("b", None), ("b", -1.0), (None, 4.0)], "source string, weight double"
    )
    assert sorted(r["doc_id"] for r in mixing.positions(docs, weights, block_chars=100).collect()) == list(range(20))
    order = [r["source"] for r in mixing.mixed(docs, weights, block_chars=100).collect()]
    # Only the first source has a weight, so the other comes last.
    assert order == ["a"] * 10 + ["b"] * 10
