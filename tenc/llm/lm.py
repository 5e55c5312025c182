"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

An n-gram whose count falls in the L-th of geometrically growing ranges is in the filter with
the levels 1 to L. Probing level after level until one is missing gives the range, and so the
count but for its rounding; a false positive lifts a count to the next range only. The filter
is cut into shards by n-gram hash. A shard is built in one task from the counts of its n-grams;
hashes spread evenly and every map task sends an n-gram once, so shards are alike in size.

Workers get the filter by broadcast, in slices of bounded size. With more than one slice, each
pass notes the levels its slice knows, and the passes are put together for each text.

Probabilities are smoothed from order to order: ``p(w | h) = (c(h w) + strength * p(w | h'))
/ (c(h) + strength)``, at the end ``(c(w) + 1) / (N + V + 1)``.

Missing texts count as empty: one end token. Without training texts all counts are zero.
Repeated rows are scored each by itself, and learned from as often as they come.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.llm.common import attach, crc_of_id, map_texts, saved, words_of

# No word holds a space, so these two stand for the end of a text and for what comes before it.
END = b" "
_BEGIN = np.uint64(0x9D5C0F1B2A7E4633)
SEED = 7
# Ranges of counts grow by this factor.
LOG_BASE = 1.5
BITS_PER_LEVEL, PROBES = 8, 4
# N-grams of a shard before equal ones are put together, and bytes of a broadcast slice.
SHARD_NGRAMS = 2_000_000
SLICE_BYTES = 160_000_000
# Words whose exact counts are broadcast for the base score; rarer ones are joined.
HEAD_WORDS = 100_000
_CACHE_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Numbers for the words of a task, with their hashes and what ``logs`` says of them."""

    def __init__(self, logs: dict[bytes, float]):
        super().__init__()
        self.logs, self.hashes, self.values = logs, array("Q"), array("d")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, SEED))
        self.values.append(self.logs.get(word, math.nan))
        return number

    def look_up(self, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and log counts (NaN if not known here) of words in a row."""
        if len(self) > _CACHE_WORDS:
            self.clear()
            self.hashes, self.values = array("Q"), array("d")
        at = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        return np.array(self.hashes)[at], np.array(self.values)[at]


def _ngrams(hashes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For the orders 1, 2, ...: the hash of the n-gram that ends at each token of each text."""
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff([*starts, len(hashes)]))
    grams = [_mix(hashes)]
    for n in range(2, order + 1):
        before = np.empty_like(hashes)
        before[n - 1 :] = hashes[: 1 - n]
        before[place < n - 1] = _BEGIN
        grams.append(_mix(grams[-1] * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(n)))
    return grams


def _contexts(grams: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """For the orders 2, 3, ...: the hash of the n-gram before each token; unused at starts."""
    shifted = []
    for gram in grams[:-1]:
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        before[starts] = 0
        shifted.append(before)
    return shifted


def _flat(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, each text closed by the end token, and where texts start."""
    flat: list[bytes] = []
    starts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        starts[i] = len(flat)
        flat += words_of(text)
        flat.append(END)
    return flat, starts


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``: exact counts of all words and of the end token (a space)."""

    def run(batches):
        held: Counter = Counter()
        for _, texts in batches:
            for text in texts:
                held.update(words_of(text))
            held[END] += len(texts)
            if len(held) > _CACHE_WORDS:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    return map_texts(docs, [], "word binary, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
    )


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes put together, in order."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The range of each count above zero, from 1."""
    return 1 + np.floor(np.log(counts) / math.log(LOG_BASE) + 1e-12).astype(np.int64)


def count_of(top: int = 256) -> np.ndarray:
    """The middle count of each range; zero for range zero."""
    edges = np.ceil(LOG_BASE ** np.arange(top + 1) - 1e-9)
    return np.concatenate([[0.0], np.maximum((edges[:-1] + edges[1:] - 1) / 2, 1.0)])


def _positions(hashes: np.ndarray, level: int, n_bits: np.ndarray):
    """Where the probes of one level lie, one array after the other."""
    x = _mix(hashes + np.uint64((level * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    step = (x >> np.uint64(17)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((x >> np.uint64(32)) * n_bits) >> np.uint64(32)
        x = x * np.uint64(0x9E3779B97F4A7C15) + step


def build_filter(docs: DataFrame, order: int, n_tokens: int) -> tuple[DataFrame, int]:
    """``shard``, ``n_bits`` and ``bits`` of the filter of all n-grams up to ``order``; bits of a shard number."""
    power = max(0, math.ceil(math.log2(max(1, n_tokens * order / SHARD_NGRAMS))))
    shift = np.uint64(63 - power), np.uint64(1)

    def shard_of(hashes):
        return (hashes >> shift[0]) >> shift[1]

    def sent(parts):
        hashes, counts = _merged(*(np.concatenate(x) for x in zip(*parts)))
        shards = shard_of(hashes)
        names = np.unique(shards)
        cuts = np.searchsorted(shards, names).tolist() + [len(hashes)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names.astype(np.int32)),
                pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ],
            ["shard", "hashes", "counts"],
        )

    def run(batches):
        words, held, size = _Words({}), [], 0
        for _, texts in batches:
            flat, starts = _flat(texts)
            hashes, _ = words.look_up(flat)
            for gram in _ngrams(hashes, starts, order):
                held.append(_merged(gram, np.ones(len(gram), np.int64)))
                size += len(held[-1][0])
            if size > 2_000_000:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    def build(group: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in group["hashes"].to_pylist()])
        counts = np.concatenate([np.frombuffer(b, np.int64) for b in group["counts"].to_pylist()])
        hashes, counts = _merged(hashes, counts)
        levels = levels_of(counts)
        n_bits = 64 * max(1, math.ceil(BITS_PER_LEVEL * int(levels.sum()) / 64))
        bits = np.zeros(n_bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in _positions(hashes[levels >= level], level, np.uint64(n_bits)):
                bits[at] = True
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
            "n_bits": pa.array([n_bits], pa.int64()),
            "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
        })

    parts = map_texts(docs, [], "shard int, hashes binary, counts binary", run)
    shards = parts.groupBy("shard").applyInArrow(build, "shard int, n_bits long, bits binary")
    return saved(shards, "ngram-filter"), power


class Slice:
    """The shards from ``first`` on, side by side in one array of bytes."""

    def __init__(self, sizes: dict[int, int], first: int, last: int, power: int):
        self.first, self.last, self.power = first, last, power
        self.n_bits = np.zeros(last - first, np.int64)
        for shard, n_bits in sizes.items():
            self.n_bits[shard - first] = n_bits
        self.begin = np.cumsum(self.n_bits // 8) - self.n_bits // 8
        self.data = bytearray(int(self.n_bits.sum() // 8))

    def put(self, shard: int, bits: bytes) -> None:
        start = int(self.begin[shard - self.first])
        self.data[start : start + len(bits)] = bits

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level up to which each n-gram is in the slice; zero for n-grams of other slices."""
        data = np.frombuffer(self.data, np.uint8)
        shard = ((hashes >> np.uint64(63 - self.power)) >> np.uint64(1)).astype(np.int64) - self.first
        found = np.zeros(len(hashes), np.uint8)
        inside = (shard >= 0) & (shard < self.last - self.first)
        live = np.flatnonzero(inside)
        live = live[self.n_bits[shard[live]] > 0]
        level = 1
        while len(live) and level < 256:
            x, s = hashes[live], shard[live]
            keep = np.ones(len(live), bool)
            n_bits, begin = self.n_bits[s].astype(np.uint64), self.begin[s]
            for at in _positions(x, level, n_bits):
                keep &= (data[begin + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[keep]
            found[live] = level
            level += 1
        return found


def slices(filter_: DataFrame, power: int, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Runs of shard numbers whose bytes stay within ``limit`` (a single shard always fits)."""
    found, first, size = [], 0, 0
    for row in filter_.select("shard", "n_bits").orderBy("shard").toLocalIterator():
        if size and size + row["n_bits"] // 8 > limit:
            found.append((first, row["shard"]))
            first, size = row["shard"], 0
        size += row["n_bits"] // 8
    return [*found, (first, 1 << power)]


def _log_probabilities(
    levels: list[np.ndarray], contexts: list[np.ndarray], starts: np.ndarray, n: int, v: int, texts: int,
    strength: float,
) -> np.ndarray:
    """log10 of every token's smoothed probability from levels of its n-grams and their contexts."""
    counts = count_of()
    p = (counts[levels[0]] + 1) / (n + v + 1)
    for gram, context in zip(levels[1:], contexts):
        whole = counts[context]
        whole[starts] = texts
        together = counts[gram]
        p = (together + strength * p) / (np.maximum(whole, together) + strength)
    return np.log10(p)


def scores(
    docs: DataFrame, training: Column, order: int = 2, strength: float = 100.0,
    slice_bytes: int = SLICE_BYTES, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Per row ``doc_id``, ``trained`` (whether ``training`` holds), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``."""
    spark = docs.sparkSession
    learned = docs.where(training)
    words = saved(vocabulary(learned), "vocabulary")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.col("word") == F.lit(END)).first()
    n_texts = ends["n"] if ends else 0
    head = words.orderBy(F.desc("n"), "word").limit(head_words)
    logs = spark.sparkContext.broadcast(
        {bytes(r["word"]): math.log10(r["n"] + 1) for r in head.toLocalIterator()}
    )
    filter_, power = build_filter(learned, order, n)
    runs = slices(filter_, power, slice_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_columns = f"row long, doc_id {kind}, trained boolean, n_tokens long, head_known long, head_sum double"

    def sliced(first, last):
        wanted = filter_.where((F.col("shard") >= first) & (F.col("shard") < last))
        sizes = {r["shard"]: r["n_bits"] for r in wanted.select("shard", "n_bits").collect()}
        slice_ = Slice(sizes, first, last, power)
        for row in wanted.select("shard", "bits").toLocalIterator():
            slice_.put(row["shard"], row["bits"])
        return spark.sparkContext.broadcast(slice_)

    def passed(slice_, only: bool):
        """One pass: with ``only`` the score itself, else the levels, to be put together later."""

        def run(batches):
            known, cached, row = slice_.value, _Words(logs.value), TaskContext.get().partitionId() << 33
            for batch, texts in batches:
                flat, starts = _flat(texts)
                hashes, values = cached.look_up(flat)
                grams = _ngrams(hashes, starts, order)
                levels = []
                for gram in grams:
                    unique, back = np.unique(gram, return_inverse=True)
                    levels.append(known.levels(unique)[back])
                contexts = _contexts(levels, starts)
                missing = np.isnan(values)
                sizes = np.diff([*starts, len(flat)])
                head_sum = np.add.reduceat(np.where(missing, 0.0, values), starts)
                head_known = np.add.reduceat((~missing).astype(np.int64), starts)
                tails = []
                for start, size in zip(starts.tolist(), sizes.tolist()):
                    at = np.flatnonzero(missing[start : start + size]) + start
                    tails.append([flat[i] for i in at.tolist()])
                columns = [
                    pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), batch.column("trained"),
                    pa.array(sizes.astype(np.int64)), pa.array(head_known), pa.array(head_sum),
                    pa.array(tails, pa.list_(pa.binary())),
                ]
                names = ["row", "doc_id", "trained", "n_tokens", "head_known", "head_sum", "tail"]
                row += len(texts)
                if only:
                    logp = _log_probabilities(levels, contexts, starts, n, v, n_texts, strength)
                    columns.append(pa.array(np.add.reduceat(logp, starts)))
                    names.append("score")
                else:
                    stacked = np.stack(levels)
                    columns.append(pa.array(
                        [stacked[:, a : a + b].tobytes() for a, b in zip(starts.tolist(), sizes.tolist())], pa.binary()
                    ))
                    ids = batch.column("doc_id").to_pylist()
                    keys = [xxhash.xxh128_digest(f"{i} {t or ''}".encode()) for i, t in zip(ids, texts)]
                    columns.append(pa.array(keys, pa.binary()))
                    names += ["levels", "key"]
                yield pa.RecordBatch.from_arrays(columns, names)

        last = "score double" if only else "levels binary, key binary"
        marked = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("trained"))
        return saved(map_texts(marked, ["doc_id", "trained"], f"{base_columns}, tail array<binary>, {last}", run), "scored")

    if len(runs) == 1:
        whole = passed(sliced(*runs[0]), True)
    else:
        passes = []
        for first, last in runs:
            slice_ = sliced(first, last)
            passes.append(passed(slice_, False))
            slice_.unpersist()
        whole = _put_together(passes, order, n, v, n_texts, strength)
    tail = whole.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    joined = tail.join(words, "word", "inner")
    rest = saved(
        joined.groupBy("row").agg(
            F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("tail_sum")
        ),
        "tails",
    )
    zero = F.lit(0)
    return attach(whole.drop("tail"), rest, ["row"]).select(
        "doc_id", "trained", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
    )


def _put_together(passes: list[DataFrame], order: int, n: int, v: int, n_texts: int, strength: float) -> DataFrame:
    """The passes' levels of each row, joined by its content; an n-gram has its level in one pass only."""
    levels = passes[0].select("key", "levels")
    for other in passes[1:]:
        levels = levels.union(other.select("key", "levels"))

    def run(batches):
        for batch in batches:
            found = []
            for lists in batch.column("all").to_pylist():
                stacked = np.max([np.frombuffer(x, np.uint8).reshape(order, -1) for x in lists], axis=0)
                starts = np.zeros(1, np.int64)
                rows = list(stacked)
                logp = _log_probabilities(rows, _contexts(rows, starts), starts, n, v, n_texts, strength)
                found.append(float(logp.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.float64())], ["key", "score"])

    together = levels.groupBy("key").agg(F.collect_set("levels").alias("all"))
    found = together.mapInArrow(run, "key binary, score double")
    return saved(passes[0].drop("levels").join(found, "key").drop("key"), "scored")


def held_out_scores(docs: DataFrame, folds: int = 7, left_out: int = 2, **options) -> DataFrame:
    """``scores`` with the rows whose key's CRC-32 has remainder ``left_out`` kept from learning."""
    training = F.pmod(crc_of_id(), F.lit(folds)) != left_out
    return scores(docs, training, **options).withColumn("trained", ~F.col("trained")).withColumnRenamed(
        "trained", "held_out"
    )
