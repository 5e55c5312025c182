"""Token counts and ids of whole texts by a map-side, two-tier lookup of pre-tokens.

Tier one is made once and broadcast; its size is a parameter. For counts it is a compact hash table of frequent
pre-tokens with their lengths in tokens: sorted hashes, two bytes for each length, and the texts themselves,
against which a hit is checked. For ids it holds the encodings. Tier two is each task's own cache: a pre-token
outside the table is encoded once and kept; the cache is emptied when it is full and when the task
ends. Pre-tokens are never shuffled.

The result is always the tokenizer's own. The lookup serves texts whose characters are printable
ASCII, Latin letters, common punctuation and ordinary white space, with the tokenizers that cut
lower-cased text by a pattern into byte-level pieces; any other text or tokenizer goes to the
library whole. Missing texts count as empty and have no tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import map_texts

# Entries of the broadcast table, and documents it is chosen from. Both affect speed only.
FREQUENT = 65_536
SAMPLE_DOCS = 4_000
# Bytes of pre-tokens and encodings that a task keeps before it starts its cache afresh.
CACHE_BYTES = 64 << 20
# Characters that a long text is cut to, at white space, before it is split.
PIECE_CHARS = 1 << 20

# Outside of these, Unicode versions or control characters could tell two libraries apart.
_UNUSUAL = regex.compile("[^\t-\r -~\u00a0-\u024f\u2010-\u2027\u20ac]")
_BREAK = regex.compile(r"\s")

_loaded: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _lookup_pattern(spec: dict) -> str | None:
    """The pattern that cuts texts, if a text's ids are those of its lower-cased pieces."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    fits = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and [s["type"] for s in cut] == ["Split", "ByteLevel"]
        and cut[0]["invert"] and cut[0]["behavior"] == "Removed"
        and not cut[1]["use_regex"] and not cut[1]["add_prefix_space"]
        and spec["model"]["type"] == "BPE"
    )
    return cut[0]["pattern"]["Regex"] if fits else None


class _Cache(dict):
    """Encodings by pre-token; misses are encoded on the way. Holds a bounded number of bytes."""

    def __init__(self, encode, primed: dict | None = None):
        self.encode, self.primed, self.held = encode, primed or {}, 0
        super().__init__(self.primed)

    def __missing__(self, piece: str):
        # A dictionary entry and its two objects take some 150 bytes beside their contents.
        value = self.encode(piece)
        self.held += 150 + len(piece) + (len(value) if isinstance(value, bytes) else 0)
        if self.held > CACHE_BYTES:
            self.clear()
            self.update(self.primed)
            self.held = 0
        self[piece] = value
        return value


class LengthTable:
    """Tier one for counts: lengths of frequent pre-tokens by hash, a few arrays."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        raw = [p.encode() for p in pieces]
        kept = [i for i, n in enumerate(lengths) if n < 1 << 16]
        hashes = np.array([xxhash.xxh64_intdigest(raw[i]) for i in kept], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.lengths = np.array([lengths[i] for i in kept], np.uint16)[order]
        texts = [raw[kept[i]] for i in order]
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.uint32)
        self.texts = b"".join(texts)

    def find(self, pieces: list[str]) -> np.ndarray:
        """Lengths of ``pieces``, -1 for those that are not in the table."""
        found = np.full(len(pieces), -1, np.int64)
        if not len(self.hashes):
            return found
        raw = [p.encode() for p in pieces]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        for i in np.flatnonzero(self.hashes[at] == hashes).tolist():
            end, size = int(self.ends[at[i]]), len(raw[i])
            if self.texts[max(end - size, 0) : end] == raw[i] and end - size == (int(self.ends[at[i] - 1]) if at[i] else 0):
                found[i] = self.lengths[at[i]]
        return found


class Encoder:
    """A tokenizer of the ``tokenizers`` library, read from its JSON text."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(text)
        spec["truncation"] = spec["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(spec))
        pattern = _lookup_pattern(spec)
        self.pattern = regex.compile(pattern) if pattern else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenize = self.library.model.tokenize
        self.letters = _byte_letters()

    def _pieces(self, piece: str):
        return self.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    def length(self, piece: str) -> int:
        return len(self._pieces(piece))

    def id_bytes(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian unsigned 32-bit numbers."""
        return b"".join(t.id.to_bytes(4, "little") for t in self._pieces(piece))

    def cut(self, text: str):
        """Lists of pre-tokens of ``text``, or None if the library has to take it whole."""
        if self.pattern is None or _UNUSUAL.search(text) or any(s in text for s in self.special):
            return None
        if len(text) <= PIECE_CHARS:
            return [self.pattern.findall(text.lower())]
        parts, start = [], 0
        while start < len(text):
            at = _BREAK.search(text, min(start + PIECE_CHARS, len(text)))
            stop = at.start() if at else len(text)
            parts.append(self.pattern.findall(text[start:stop].lower()))
            start = stop + 1 if at else stop
        return parts

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def encoder(text: str) -> Encoder:
    """The encoder of this worker; it is built once in each process."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Encoder(text)
    return _loaded[name]


def frequent_pieces(
    docs: DataFrame, text: str, size: int = FREQUENT, sample: int = SAMPLE_DOCS
) -> list[tuple[str, bytes]]:
    """At most ``size`` frequent pre-tokens of about ``sample`` documents, with their ids.

    The sample goes to two tasks, each of which sends no more than ``size`` candidates, so what
    reaches the driver is bounded.
    """
    n = docs.count()
    if not n or not size:
        return []
    drawn = docs.select("text").sample(fraction=min(1.0, sample / n), seed=1).repartition(2)

    def run(batches):
        tool, found = encoder(text), Counter()
        for _, texts in batches:
            for value in texts:
                for part in tool.cut(value or "") or []:
                    found.update(part)
        top = found.most_common(size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64()),
                pa.array([tool.id_bytes(p) for p, _ in top], pa.binary()),
            ],
            ["piece", "n", "ids"],
        )

    total, ids = Counter(), {}
    for row in map_texts(drawn, [], "piece string, n long, ids binary", run).collect():
        total[row["piece"]] += row["n"]
        ids[row["piece"]] = bytes(row["ids"])
    return [(p, ids[p]) for p, c in total.most_common(size) if c > 1]


class Lookup:
    """What workers need: the tokenizer's JSON and the frequent pre-tokens, broadcast."""

    def __init__(self, docs: DataFrame, path: str, frequent: int = FREQUENT, ids: bool = False):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        context = docs.sparkSession.sparkContext
        found = frequent_pieces(docs, text, frequent)
        known = dict(found) if ids else LengthTable([p for p, _ in found], [len(i) // 4 for _, i in found])
        self._shared = context.broadcast((text, known))

    def ids(self):
        """In a task: a function from a text to its ids as bytes. Its cache ends with the task."""
        text, known = self._shared.value
        tool = encoder(text)
        cache = _Cache(tool.id_bytes, known)

        def of(value: str) -> bytes:
            parts = tool.cut(value)
            if parts is None:
                return np.array(tool.whole(value), "<u4").tobytes()
            return b"".join(b"".join(map(cache.__getitem__, part)) for part in parts)

        return of

    def counter(self):
        """In a task: a function from some texts to their numbers of tokens."""
        text, known = self._shared.value
        tool = encoder(text)
        cache = _Cache(tool.length)

        def of(values: list[str]) -> np.ndarray:
            numbers = defaultdict(count().__next__)
            places: list[list[np.ndarray] | int] = []
            for value in values:
                parts = tool.cut(value)
                places.append(
                    len(tool.whole(value)) if parts is None
                    else [np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)) for part in parts]
                )
            pieces = list(numbers)
            lengths = known.find(pieces)
            for i in np.flatnonzero(lengths < 0).tolist():
                lengths[i] = cache[pieces[i]]
            return np.array(
                [p if isinstance(p, int) else sum(int(lengths[part].sum()) for part in p) for p in places], np.int64
            )

        return of


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; only a map over the rows."""
    if path.endswith(".model"):
        return _count_sentencepiece(docs, path, limit)
    lookup = Lookup(docs, path, frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counted = lookup.counter()
        for batch, texts in batches:
            values = [t or "" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(v.encode()) for v in values], pa.int64()),
                    pa.array(counted(values), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = map_texts(docs, ["doc_id"], f"doc_id {kind}, n_bytes long, n_tokens long", run)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _count_sentencepiece(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """The same columns with a SentencePiece model, whose pieces depend on their context."""
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch, texts in batches:
            values = [t or "" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(v.encode()) for v in values], pa.int64()),
                    pa.array([len(tool.encode(v, num_threads=1)) for v in values], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = map_texts(docs, ["doc_id"], f"doc_id {kind}, n_bytes long, n_tokens long", run)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
