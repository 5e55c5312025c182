"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, hashed to buckets with an embedding each; a
text is the mean of its words. Embeddings and softmax are trained jointly in numpy, in one task,
on a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` of each label and ``SAMPLE_CHARS`` characters of
whole texts, the first in the order of a hash of their keys (a text that no longer fits is passed over, so
memory has a bound however long texts are). All texts are scored. The softmax is linear, so a word's part in
the score is a number, which workers compute once and keep.

Missing texts count as empty; texts without words get the score of the bias. Without labels of
both kinds every score is 0. Rows are scored each by itself.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import crc_of_id, map_texts

SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 8_000_000
BITS, DIMENSIONS = 18, 4
SHORTEST, LONGEST = 3, 6
# The share of label 1 that texts are taken to have, whatever its share of the sample.
PRIOR = 0.15
# Neutral words that every text is lengthened by, so that a few words do not decide.
PADDING = 30
# Words of the sample that come less often give no features while learning.
MIN_COUNT = 5
EPOCHS, RATE, MOMENTUM, SHRINKAGE, SEED = 100, 1.0, 0.9, 2e-5, 42
_CACHE_WORDS = 400_000
_COUNT_BITS = 22

_PLAIN = bytes(
    ord(" ") if chr(b) in string.punctuation or chr(b) in string.whitespace else (b + 32 if 65 <= b <= 90 else b)
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space and ASCII punctuation, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def grams_of(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams, with its borders marked."""
    whole = f"<{word.decode('utf-8', 'replace')}>"
    n = len(whole)
    parts = {whole}
    for size in range(SHORTEST, min(LONGEST, n - 1) + 1):
        parts.update(whole[i : i + size] for i in range(n - size + 1))
    return sorted(zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts)


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """A number for each bucket and a bias; a text's log-odds are the bias plus the padded mean over its words."""
    y = np.array(labels)
    # A table of hash counts first tells which words can be frequent enough, so that rare ones are never held.
    seen_hashes = np.zeros(1 << _COUNT_BITS, np.int64)
    for t in texts:
        hashes = np.fromiter(map(zlib.crc32, words_of(t)), np.uint32)
        seen_hashes += np.bincount(hashes >> np.uint32(32 - _COUNT_BITS), minlength=len(seen_hashes))
    total: Counter = Counter()
    for t in texts:
        total.update(w for w in words_of(t) if seen_hashes[zlib.crc32(w) >> 32 - _COUNT_BITS] >= MIN_COUNT)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in total.items() if n >= MIN_COUNT))}
    del total, seen_hashes
    grams = [grams_of(w) for w in vocabulary]
    # Twelve bytes for each distinct word of each text.
    doc, word, share = [], [], []
    for i, t in enumerate(texts):
        found = words_of(t)
        n = len(found) + PADDING
        known = np.fromiter((vocabulary[w] for w in found if w in vocabulary), np.int32)
        kinds, times = np.unique(known, return_counts=True)
        doc.append(np.full(len(kinds), i, np.int32))
        word.append(kinds)
        share.append((times / n).astype(np.float32))
    doc, word, share = (np.concatenate(x) if x else np.empty(0) for x in (doc, word, share))
    if not len(doc) or len(set(labels)) < 2:
        return np.zeros(1 << BITS, np.float32), -math.inf
    share = share[:, None]
    lengths = np.array([len(g) for g in grams])
    gram = np.concatenate([np.array(g) for g in grams])
    used, gram = np.unique(gram, return_inverse=True)
    owner = np.repeat(np.arange(len(grams)), lengths)
    weight = (1 / lengths[owner]).astype(np.float32)[:, None]
    by_word, by_gram = np.argsort(word, kind="stable"), np.argsort(gram, kind="stable")

    def starts(keys):
        return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))

    docs_at, words_at = starts(doc), starts(word[by_word])
    grams_at, owners_at = starts(gram[by_gram]), starts(owner)
    seen = np.unique(doc)
    random = np.random.default_rng(SEED)
    size = DIMENSIONS
    values = [
        random.uniform(-1 / size, 1 / size, (len(used), size)).astype(np.float32),
        random.uniform(-1 / size, 1 / size, (size, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    speeds = [np.zeros_like(v) for v in values]
    target = np.eye(2, dtype=np.float32)[y[seen]]
    balance = (target @ (np.array([1 - PRIOR, PRIOR]) / np.maximum(target.sum(axis=0), 1)))[:, None].astype(np.float32)
    # How much of the sample each gram makes up: a bound on its curvature, as shares sum to one.
    of_word = np.zeros((len(grams), 1), np.float32)
    weights = np.zeros(len(texts), np.float32)
    weights[seen] = balance[:, 0]
    of_word[word[by_word][words_at]] = np.add.reduceat((weights[doc][:, None] * share)[by_word], words_at)
    presence = np.add.reduceat((of_word[owner] * weight)[by_gram], grams_at)
    for _ in range(EPOCHS):
        embedding, out, bias = values
        words = np.add.reduceat(embedding[gram] * weight, owners_at)
        means = np.add.reduceat(words[word] * share, docs_at)
        logits = means @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * balance
        back = np.zeros((len(texts), size), np.float32)
        back[seen] = error @ out.T
        to_words = np.zeros((len(grams), size), np.float32)
        to_words[word[by_word][words_at]] = np.add.reduceat((back[doc] * share)[by_word], words_at)
        to_grams = np.add.reduceat((to_words[owner] * weight)[by_gram], grams_at)
        slopes = (
            to_grams / (presence + SHRINKAGE),
            means.T @ error / (float((balance * means * means).sum()) + 1.0),
            error.sum(axis=0),
        )
        for value, slope, speed in zip(values, slopes, speeds):
            speed *= MOMENTUM
            speed -= slope
            value += RATE * speed
    embedding, out, bias = values
    table = np.zeros(1 << BITS, np.float32)
    table[used] = embedding @ (out[:, 1] - out[:, 0])
    return table, float(bias[1] - bias[0])


class _WordScores(dict):
    """A word's part in the log-odds, found once in each task."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tolist()

    def __missing__(self, word: bytes) -> float:
        found = grams_of(word)
        value = self[word] = sum(map(self.table.__getitem__, found)) / len(found)
        return value


def log_odds(text: str | None, scores: _WordScores, bias: float) -> float:
    found = words_of(text)
    if len(scores) > _CACHE_WORDS:
        scores.clear()
    return bias + sum(map(scores.__getitem__, found)) / (len(found) + PADDING)


def train(
    docs: DataFrame, labels: DataFrame, learned: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled rows and ``chars`` characters of each kind.

    A key with several labels counts as its largest; of several texts under one key the smallest is learned.
    """
    marks = (
        labels.where(learned & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    present = (
        docs.where("text is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("size"))
        .join(marks, "doc_id")
    )
    drawn = present.where("toxic = 0").orderBy(order, "doc_id").limit(rows).union(
        present.where("toxic = 1").orderBy(order, "doc_id").limit(rows)
    )
    chosen, used = [], Counter()
    for r in drawn.orderBy("toxic", order, "doc_id").collect():
        if used[r["toxic"]] + r["size"] <= chars:
            used[r["toxic"]] += r["size"]
            chosen.append((r["doc_id"], r["toxic"]))
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, drawn.select("doc_id", "toxic").schema)
    sample = (
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    )

    def run(batches):
        found = [
            row for batch, texts in batches
            for row in zip(batch.column("doc_id").to_pylist(), texts, batch.column("toxic").to_pylist())
        ]
        found.sort(key=lambda row: row[0])
        table, bias = fit([t for _, t, _ in found], [int(y > 0) for _, _, y in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["table", "bias"]
        )

    model = map_texts(sample.repartition(1), ["doc_id", "toxic"], "table binary, bias double", run).collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), -math.inf
    return np.frombuffer(bytes(model[0]["table"]), np.float32), model[0]["bias"]


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None, column: str = "score"
) -> DataFrame:
    """``keep`` (all columns) of every row of ``docs`` and its ``column``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns if keep is None else keep
    kinds = [f"`c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    # Columns travel under neutral names, so that none clashes with the text or the score.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "text")

    def run(batches):
        table, bias = shared.value
        scores = _WordScores(table)
        for batch, texts in batches:
            odds = [log_odds(t, scores, bias) for t in texts]
            found = [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in odds]
            columns = [batch.column(f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.float64())], [*[f"c{i}" for i in range(len(names))], "score"]
            )

    scored = map_texts(plain, [f"c{i}" for i in range(len(names))], ", ".join([*kinds, "score double"]), run)
    return scored.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != column], F.col("score").alias(column)
    )


def held_out_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2, threshold: float = 0.3
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``; rows of one remainder of the key's CRC-32 teach nothing."""
    held_out = F.pmod(crc_of_id(), F.lit(folds)) == left_out
    found = score(docs, train(docs, labels, ~held_out), keep=["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
