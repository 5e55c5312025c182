"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams come from all learning rows; they are summed by language and bucket before
and after one shuffle. The matrix of log-probabilities has languages times buckets entries and
is broadcast; batches are scored in numpy by looking up and summing its rows.

Missing texts and texts without a letter are ``und`` with score 0, as are all texts if nothing
was learned. Ties go to the name that comes first. Rows are judged each by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import crc_of_id, map_texts

BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
# More values than this in the language column are taken for a mistake.
MAX_LANGUAGES = 1000
_HELD_LANGUAGES = 64
_PIECE = 1_000_000

_LETTER = regex.compile(r"\p{L}")
_SPACES = re.compile(r"\s+")
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    plain = " " + _SPACES.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        mixed = (mixed ^ points[i : i + n]) * _FACTORS[i]
        mixed ^= mixed >> np.uint32(15)
    return (mixed * _FACTORS[0] >> np.uint32(32 - BITS)).astype(np.int64)


def _pieces(points: np.ndarray):
    """Overlapping pieces of a long text, each n-gram in one of them, with the order it serves."""
    for order in ORDERS:
        for at in range(0, max(1, len(points)), _PIECE):
            yield _buckets(points[at : at + _PIECE + order - 1], order)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``bucket`` and ``n`` over all rows whose text and language are known."""

    def emitted(held):
        names, buckets, counts = [], [], []
        for name, row in held.items():
            full = np.flatnonzero(row)
            names += [name] * len(full)
            buckets.append(full)
            counts.append(row[full])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()), pa.array(np.concatenate(buckets).astype(np.int32)),
                pa.array(np.concatenate(counts)),
            ],
            ["lang", "bucket", "n"],
        )

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch, texts in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                row = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for part in _pieces(_points(text)):
                    row += np.bincount(part, minlength=1 << BITS)
            if len(held) > _HELD_LANGUAGES:
                yield emitted(held)
                held = {}
        if held:
            yield emitted(held)

    known = docs.where("text is not null and lang is not null")
    return map_texts(known, ["lang"], "lang string, bucket int, n long", run).groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")
    )


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probabilities (bucket by language) and log priors."""
    known = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((1 << BITS, len(names)))
    for row in gram_counts(docs).toLocalIterator():
        counts[row["bucket"], at[row["lang"]]] = row["n"]
    counts += SMOOTHING
    prior = np.array([sizes[n] for n in names], float)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def predict(docs: DataFrame, learned: Column) -> DataFrame:
    """``doc_id``, ``learned``, ``lang_pred`` and ``score`` (the posterior) of every row of ``docs``."""
    names, matrix, prior = train(docs.where(learned))
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix, prior))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judged(text: str | None) -> tuple[str, float]:
        names, matrix, prior = shared.value
        if not names or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total = prior.copy()
        for part in _pieces(_points(text)):
            used = np.bincount(part, minlength=1 << BITS) if len(part) > 1 << BITS else None
            total += used @ matrix if used is not None else matrix[part].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return names[best], float(1 / np.exp(total - total[best]).sum())

    def run(batches):
        for batch, texts in batches:
            found = [judged(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("learned"),
                    pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "learned", "lang_pred", "score"],
            )

    marked = docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("learned"))
    return map_texts(
        marked, ["doc_id", "learned"], f"doc_id {kind}, learned boolean, lang_pred string, score double", run
    )


def held_out_languages(docs: DataFrame, folds: int = 5, left_out: int = 0) -> DataFrame:
    """``predict`` with the rows whose key's CRC-32 has remainder ``left_out`` kept from learning."""
    found = predict(docs, F.pmod(crc_of_id(), F.lit(folds)) != left_out)
    return found.withColumn("learned", ~F.col("learned")).withColumnRenamed("learned", "held_out")
