import zlib
from collections import Counter

import numpy as np
import pytest

from tenc.llm import packing, tokens
from tenc.llm.suite import tokenizer_path
LONG = " ".join(f"w{i % 977} the of" for i in range(30_000))

ODD = [
    "", None, "don't it's we'LL they're I'm he'd you've 's 'S x's", "<|endoftext|>", "a <|startoftext|> b", "<|ENDOFTEXT|>",
    "² ½ ª º ß İ ſ ŉ Ǆ À̀ é", "\x1c\x1d\x85\xa0 ​", "中文 日本語 한국어 ελληνικάς Σ", "😀👍🏽",
    "snake_case 12,345.67 --- ... !!! ''' \"quoted\"", "tabs\tand\r\nlines\x0b\x0c", LONG, "x" * 3000,
    "— “quotes” … €5 ‐‧ ÿ ɏ ɐ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def odd_docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")


def test_counts_are_the_library_s(spark, edges, nothing, library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 5000)
    docs = odd_docs(spark).union(edges.select("doc_id", "text"))
    expected = Counter(
        (r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    for frequent in (0, 50, tokens.FREQUENT):
        rows = tokens.count_tokens(docs, tokenizer_path(), limit=100, frequent=frequent).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert tokens.count_tokens(nothing, tokenizer_path()).count() == 0


def test_long_texts_are_cut_at_white_space(library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 64)
    with open(tokenizer_path(), encoding="utf-8") as file:
        tool = tokens.Encoder(file.read())
    for text in [t for t in ODD if t]:
        parts = tool.cut(text)
        found = tool.whole(text) if parts is None else [
            i for part in parts for piece in part for i in np.frombuffer(tool.id_bytes(piece), "<u4").tolist()
        ]
        assert found == library.encode(text, add_special_tokens=False).ids


def test_table_of_lengths_tells_hits_from_misses_by_text():
    table = tokens.LengthTable(["the", " of", "é", "", "long"], [1, 2, 3, 4, 70_000])
    assert table.find([" of", "the", "x", "é", "", "long", "of"]).tolist() == [2, 1, -1, 3, 4, -1, -1]
    # A text of the same hash is no hit.
    table.texts = b"?" * len(table.texts)
    assert table.find([" of", "the"]).tolist() == [-1, -1]
    assert tokens.LengthTable([], []).find(["a"]).tolist() == [-1]


def test_cache_stays_within_its_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    cache = tokens._Cache(len, {"kept": 4})
    for i in range(1000):
        assert cache[f"piece {i}"] == len(f"piece {i}") and cache["kept"] == 4 and len(cache) < 20


def test_any_type_of_key_is_packed(spark):
    docs = spark.sql("select cast(7 as smallint) as doc_id, 'some text' as text union all select null, 'more'")
    assert {r["doc_id"] for r in packing.pack(docs, tokenizer_path()).collect()} == {7, None}


def test_other_tokenizers_go_to_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for row in tokens.count_tokens(odd_docs(spark), path).collect():
        assert row["n_tokens"] == len(library.encode(ODD[row["doc_id"]] or "", add_special_tokens=False).ids)
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for row in tokens.count_tokens(odd_docs(spark), path).collect():
        assert row["n_tokens"] == len(model.encode(ODD[row["doc_id"]] or ""))


def cheapest(n, documents, sentences, window):
    """All cuts by plain dynamic programming over every earlier candidate."""
    places, costs = packing._candidates(n, np.array(sorted(documents)), np.array(sorted(sentences), dtype=int), window)
    best = {0: 0}
    for p, c in zip(places.tolist()[1:], costs.tolist()[1:]):
        options = [
            best[q] + (0 if (p - q) & (p - q - 1) == 0 else window - (p - q))
            for q in best if p - q <= window
        ]
        best[p] = min(options) + c + packing.WINDOW_COST
    return best[n]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 900))
        documents = {n, *rng.integers(1, n + 1, 4).tolist()}
        sentences = set(rng.integers(1, n + 1, int(rng.integers(0, 40))).tolist())
        args = n, np.array(sorted(documents)), np.array(sorted(sentences), dtype=int)
        window = 64 if n < 300 else 256
        cuts = packing.cut_points(*args, window)
        places, costs = packing._candidates(*args, window)
        price = dict(zip(places.tolist(), costs.tolist()))
        total = 0
        for a, b in zip([0, *cuts], cuts):
            assert 0 < b - a <= window
            total += price[b] + packing.WINDOW_COST + (0 if (b - a) & (b - a - 1) == 0 else window - (b - a))
        assert cuts[-1] == n and total == cheapest(*args, window)


def test_every_id_lies_in_one_piece(spark, edges, nothing, library):
    docs = odd_docs(spark).withColumnRenamed("doc_id", "d").selectExpr("d + 100 doc_id", "text").union(
        edges.select("doc_id", "text")
    ).repartition(3)
    rows = packing.pack(docs, tokenizer_path(), window=512, block=4096).collect()
    given = Counter(
        (r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in docs.collect()
    )
    by_sequence = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    parts = Counter()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    for r in rows:
        parts[(r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"])] += 1
    found = Counter()
    starts = {}
    for (doc_id, start, ids, total), n in parts.items():
        starts.setdefault((doc_id, total), {}).setdefault(start, []).append((ids, n))
    for (doc_id, total), pieces in starts.items():
        copies = sum(n for ids, n in pieces[0])
        lengths = sum(len(ids) // 4 * n for p in pieces.values() for ids, n in p)
        assert lengths == total * copies
        found[(doc_id, total)] += copies
    expected = Counter()
    for (doc_id, ids), n in given.items():
        expected[(doc_id, len(ids))] += n
    assert found == expected
    assert packing.pack(nothing, tokenizer_path()).count() == 0
