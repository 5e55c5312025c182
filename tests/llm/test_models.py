import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tenc.llm import langid, lm, toxicity
from tenc.llm.common import words_of

ROOT = Path(__file__).resolve().parents[2]


def corpus(spark, n=200, seed=8):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=None))) for i in range(n)]
    return rows


def brute_scores(rows, strength):
    """Base score and bigram score with exact counts, learned from keys whose remainder is not 2."""
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    tokens = [(k, words_of(t) + [b" "]) for k, t in rows]
    single, pairs, texts = Counter(), Counter(), 0
    for k, w in tokens:
        if not held[k]:
            single.update(w)
            pairs.update(zip([None, *w], w))
            texts += 1
    n, v = sum(single.values()), len(single)
    out = []
    for k, w in tokens:
        base = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip([None, *w], w):
            before = texts if h is None else single[h]
            score += math.log10((pairs[h, x] + strength * (single[x] + 1) / (n + v + 1)) / (before + strength))
        out.append((k, held[k], len(w), sum(single[x] > 0 for x in w), n, base, score))
    return out


def test_scores_against_exact_counts(spark, edges, nothing, monkeypatch):
    rows = corpus(spark) + [(r["doc_id"], r["text"]) for r in edges.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (str(r[0]), r[2], r[5])
    expected = sorted(brute_scores(rows, 100.0), key=key)
    found = sorted((tuple(r) for r in lm.held_out_scores(docs, head_words=20).collect()), key=key)
    for e, f in zip(expected, found, strict=True):
        assert e[:5] == f[:5] and f[5] == pytest.approx(e[5], abs=1e-6)
        assert f[6] == pytest.approx(e[6], rel=0.05, abs=0.5)
    monkeypatch.setattr(lm, "SHARD_NGRAMS", 2000)
    one = sorted((tuple(r) for r in lm.held_out_scores(docs).collect()), key=key)
    many = sorted((tuple(r) for r in lm.held_out_scores(docs, slice_bytes=3000).collect()), key=key)
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert lm.held_out_scores(nothing).count() == 0


def test_trigrams(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(1, 30)], "doc_id long, text string")
    two, three = (
        {r["doc_id"]: r["score"] for r in lm.held_out_scores(docs, order=order, strength=1.0).collect()} for order in (2, 3)
    )
    assert all(two[k] <= three[k] <= 0 for k in two)


def test_filter_levels_are_never_too_low():
    counts = np.array([1, 1, 2, 3, 5, 40, 1000])
    hashes = lm._mix(np.arange(1, 8, dtype=np.uint64))
    levels = lm.levels_of(counts)
    bits = np.zeros(64 * 64, bool)
    for level in range(1, levels.max() + 1):
        for at in lm._positions(hashes[levels >= level], level, np.uint64(len(bits))):
            bits[at] = True
    slice_ = lm.Slice({0: len(bits)}, 0, 1, 0)
    slice_.put(0, np.packbits(bits, bitorder="little").tobytes())
    assert (slice_.levels(hashes) >= levels).all()
    assert (np.abs(lm.count_of()[levels] / counts - 1) < 0.25).all()


def test_toxic_words_are_learned_with_their_misspellings(spark, edges, nothing):
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ru") for b in ("na", "to", "si") for c in ("", "r", "st", "ne")]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 3 == 0:
            for stem in ("grumpfel", "zwacken"):
                words[int(rng.integers(40))] = stem + str(rng.choice(["", "er", "ig", "los", "haft", "x"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.held_out_scores(docs, marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] == (i in set(held)) for i in found)
    right = sum(found[i]["predicted"] == int(i % 3 == 0) for i in held)
    assert right / len(held) > 0.97
    model = toxicity.train(docs, marks, marks.doc_id >= 0)
    odd = [(1, "ba na to " * 9 + "grumpfelung zwackend"), (2, "bana " * 20), (3, None), (4, "")]
    scored = {
        r["doc_id"]: r["score"]
        for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    }
    assert scored[1] > 0.3 > scored[2] and scored[3] == scored[4] < 0.3
    kept = toxicity.score(edges, model, column="odds")
    assert kept.columns == [*edges.columns, "odds"] and kept.count() == edges.count()
    assert toxicity.held_out_scores(nothing, marks).count() == 0
    unlabelled = toxicity.held_out_scores(docs, marks.limit(0)).collect()
    assert len(unlabelled) == 600 and all(r["score"] == 0 for r in unlabelled)


def dense_fit(texts, labels):
    """The same training with plain matrices: texts by words, words by buckets."""
    counted = [Counter(toxicity.words_of(t)) for t in texts]
    total = sum(counted, Counter())
    words = sorted(w for w, n in total.items() if n >= toxicity.MIN_COUNT)
    shares = np.array([[c[w] / (c.total() + toxicity.PADDING) for w in words] for c in counted])
    grams = [toxicity.grams_of(w) for w in words]
    used = sorted({g for own in grams for g in own})
    parts = np.array([[own.count(g) / len(own) for g in used] for own in grams])
    bags = shares @ parts
    seen = shares.any(axis=1)
    size = toxicity.DIMENSIONS
    random = np.random.default_rng(toxicity.SEED)
    e, o = random.uniform(-1 / size, 1 / size, (len(used), size)), random.uniform(-1 / size, 1 / size, (size, 2))
    b, speeds = np.zeros(2), [0, 0, 0]
    target = np.eye(2)[np.array(labels)] * seen[:, None]
    balance = target @ (np.array([1 - toxicity.PRIOR, toxicity.PRIOR]) / np.maximum(target.sum(axis=0), 1))
    presence = balance @ bags
    for _ in range(toxicity.EPOCHS):
        means = bags @ e
        p = np.exp(means @ o + b)
        error = (p / p.sum(axis=1, keepdims=True) - target) * balance[:, None]
        slopes = (
            bags.T @ (error @ o.T) / (presence[:, None] + toxicity.SHRINKAGE),
            means.T @ error / ((balance[:, None] * means * means).sum() + 1), error.sum(axis=0),
        )
        speeds = [toxicity.MOMENTUM * v - s for v, s in zip(speeds, slopes)]
        e, o, b = (x + toxicity.RATE * v for x, v in zip((e, o, b), speeds))
    table = np.zeros(1 << toxicity.BITS)
    table[used] = e @ (o[:, 1] - o[:, 0])
    return table, b[1] - b[0]


def test_toxicity_training_equals_plain_matrices():
    rng = np.random.default_rng(12)
    words = ["bana", "loto", "misi", "grump", "zwack", "rare"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=[0.3, 0.3, 0.29, 0.05, 0.05, 0.01])) for _ in range(80)]
    labels = [int("grump" in t or "zwack" in t) for t in texts]
    table, bias = toxicity.fit([*texts, None], [*labels, 0])
    expected, expected_bias = dense_fit([*texts, None], [*labels, 0])
    assert np.allclose(table, expected, rtol=1e-2, atol=1e-3) and bias == pytest.approx(expected_bias, abs=1e-3)
    assert np.abs(expected).max() > 0.1


def test_toxicity_sample_is_bounded_by_characters(spark):
    rows = [(i, f"{'sharp' if i % 2 else 'soft'} word {i} " * 200, i % 2) for i in range(200)] + [(777, "sharp " * 50_000, 1)]
    rows += [(4, "soft word of a second text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = docs.select("doc_id", "toxic").distinct()
    seen = []
    for chars in (30_000, toxicity.SAMPLE_CHARS):
        models = [toxicity.train(d, marks, marks.doc_id >= 0, chars=chars) for d in (docs, docs.repartition(5))]
        # Neither the cut of the table nor the order of two texts under one key changes the model.
        assert (models[0][0] == models[1][0]).all() and models[0][1] == models[1][1]
        seen.append(np.count_nonzero(models[0][0]))
    assert 0 < seen[0] < seen[1]


def test_toxicity_training_takes_bounded_memory():
    """As many characters as a sample can have, mostly rare words, in a process of its own."""
    code = (
        "import resource, random\n"
        "import sys; sys.path.insert(0, '.')\n"
        "from tenc.llm import toxicity\n"
        "rng = random.Random(1)\n"
        "texts = [' '.join(f'w{rng.randrange(10**6)}' if rng.random() < .5 else f'v{rng.randrange(3000)}' for _ in range(14_000)) for _ in range(160)]\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "toxicity.EPOCHS = 3\n"
        "toxicity.fit(texts, [i % 2 for i in range(160)])\n"
        "print(sum(map(len, texts)), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    chars, grown = map(int, done.stdout.split())
    assert chars > 13_000_000 and grown < 400


@pytest.mark.parametrize("text", ["½ ²", "① Ⅷ ³", "123 ٣ ५", "\u0301\u0308", "_ _", "😀"])
def test_numbers_and_marks_are_no_letters(spark, text):
    rows = [(i, "das haus und der hund", "de") for i in range(10)] + [(100, text, "de"), (101, text + " ª", "de")]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.held_out_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (found[100], found[101]) == ("und", "de") and not any(c.isalpha() for c in text)


def test_languages_against_brute_force(spark, edges, nothing):
    samples = {
        "en": "the house and the dog of this morning with that river", "de": "das haus und der hund an diesem morgen mit dem fluss",
        "fr": "la maison et le chien de ce matin avec cette rivière", "es": "la casa y el perro de esta mañana con aquel río",
    }
    rng = np.random.default_rng(10)
    rows = []
    for i in range(400):
        lang = sorted(samples)[i % 4]
        rows.append((i, " ".join(rng.choice(samples[lang].split(), 25)), lang))
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", "en"), (902, "hello", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.held_out_languages(docs).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert (found[900]["lang_pred"], found[900]["score"]) == ("und", 0.0) == (found[901]["lang_pred"], found[901]["score"])
    counts = {lang: np.full(1 << langid.BITS, langid.SMOOTHING) for lang in samples}
    texts = Counter()
    for i, text, lang in [*rows, (901, "123 !!", "en")]:
        if zlib.crc32(str(i).encode()) % 5:
            texts[lang] += 1
            for part in langid._pieces(langid._points(text)):
                np.add.at(counts[lang], part, 1)
    for i, text, _ in rows[:20]:
        odds = {}
        for lang in samples:
            logs = np.log(counts[lang] / counts[lang].sum())
            odds[lang] = math.log(texts[lang] / texts.total()) + sum(logs[p].sum() for p in langid._pieces(langid._points(text)))
        top = max(odds.values())
        assert found[i]["score"] == pytest.approx(1 / sum(math.exp(o - top) for o in odds.values()), abs=1e-3)
    assert langid.held_out_languages(edges).count() == edges.count()
    assert langid.held_out_languages(nothing).count() == 0
    nobody = langid.held_out_languages(docs.where("lang is null")).collect()
    assert [r["lang_pred"] for r in nobody] == ["und"]


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    points = langid._points("abc def " * 100)
    whole = np.bincount(np.concatenate(list(langid._pieces(points))), minlength=1 << langid.BITS)
    monkeypatch.setattr(langid, "_PIECE", 37)
    parts = np.bincount(np.concatenate(list(langid._pieces(points))), minlength=1 << langid.BITS)
    assert (whole == parts).all()
