import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from tenc.llm import phrases


def brute(rows, max_words=3, min_count=10, subsumed_at=50, top=2000):
    """Every phrase counted; ``rows`` are pairs of a language and a text."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    found = {}
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, p), a in frequent.items():
        inside = [
            b for (other, q), b in frequent.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        ]
        if any(100 * b >= subsumed_at * a for b in inside):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((Fraction(1000000 * a * a, l * r).__floor__(), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -score)
        for lang, all_ in found.items() for i, (score, a, p, l, r) in enumerate(sorted(all_)[:top])
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["new", "York", "city", "of", "the", "Énd", "a\x1fb", "x-y", "<b>", "é", "\x00"]
    made = []
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choices(words, [9, 9, 6, 20, 20, 3, 1, 1, 1, 2, 1])[0])
            parts.append(rng.choices([" ", "  ", "\t", ", ", ".\n", "\r", " "], [40, 2, 2, 3, 2, 1, 1])[0])
        made.append((rng.choice(["en", "de", None, "und"]), "".join(parts)))
    return made + [("en", None), (None, ""), ("en", "New York City " * 40), ("en", "New York City " * 40), ("fr", "..,;")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_equal_to_brute_force(spark, rows, monkeypatch, max_words):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = phrases.collocations(docs, max_words=max_words, top=25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in found.dtypes} == {"string", "bigint"}
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, max_words=max_words, top=25)


def test_bounded_pieces_and_a_small_map_change_nothing(spark, rows, monkeypatch):
    """Texts cut at every few characters, tasks that give away often, rows of few entries."""
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    plain = [t.encode() for _, t in rows if t]
    whole = [list(phrases.tokens(t)) for t in plain]
    monkeypatch.setattr(phrases, "PIECE_BYTES", 7)
    for t, w in zip(plain, whole):
        assert [x for part in phrases.tokens(t) for x in part] == [x for part in w for x in part]
    words = phrases._Words()
    for t in plain[:50]:
        words.add(t)
    monkeypatch.setattr(phrases, "ROW_ENTRIES", 2)
    batches = list(phrases._stripe_rows("en", list(words.numbers), *words.stripes("en", 0, None, None)))
    total = {None: 0}
    for b in batches:
        assert max(b.column("word").value_lengths().to_pylist()) <= 2
        for ws, ns in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            total.update(zip(ws, ns))
    assert total[None] == sum(v for k, v in total.items() if k is not None) == words.size - sum(
        x == b"\xff" for t in plain[:50] for part in phrases.tokens(t) for x in part
    )
    # With every prefix hot, or all places of the map taken nothing is left out early.
    full = b"\xff" * (phrases.FREQUENT_BITS // 8)
    monkeypatch.setattr(phrases, "HOT_SHARE", 10**9)
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=25).collect()) == brute(rows, top=25)
    monkeypatch.setattr(phrases, "_frequent_map", lambda _: full)
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=25).collect()) == brute(rows, top=25)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000)], "a long, l long, r long")
    whole = "cast({} as decimal(15, 0))".format
    score = counts.selectExpr(f"(1000000BD * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')}) as s").first()["s"]
    assert score == 1000000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_000)


def test_odd_rows_and_empty_table(spark, edges, nothing):
    given = [(r["lang"], r["text"]) for r in edges.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(edges).collect()) == brute(given)
    assert phrases.collocations(nothing).count() == 0
