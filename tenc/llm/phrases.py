"""Phrase collocations by stripes: every prefix keys a counter of the words that follow it.

A stripe is a prefix of words with a counter of next words. Stripes are merged elementwise. All that follows is
read from this one structure: an entry is the count of an extended phrase and, one level down, the total of
that phrase as a prefix; the largest entry of a stripe says whether a longer phrase subsumes its prefix. The stripe of no
word also holds the number of all words, under a missing word.

Stripes travel whole, by prefix. A prefix before many of all words (there cannot be many such) has its stripes cut
into segments by the hash of the next word, in every task alike, so that its merging is spread.

Stripes are made level by level, for prefixes of no word, one word, two words. A phrase cannot be
more frequent than its parts, so a level leaves out prefixes and next words whose parts are rare;
all counts that are needed stay exact. What is frequent travels as a bitmap of hashes of a fixed
size: where two hashes fall together a rare prefix is counted in vain, nothing else.

Texts are cut into pieces at sentence marks and line ends; no phrase crosses a cut. Missing texts count
as empty, a missing language as ``und``. Repeated rows count as often as they come. Every text is read
whole; a long one is cut into words bit by bit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenc.llm.common import saved

UNKNOWN_LANGUAGE = "und"
# Bits of the map of frequent phrases, a power of two: 16 MB. It affects work only.
FREQUENT_BITS = 1 << 27
# Words a task gathers before it gives its stripes away, and distinct ones.
WORDS_HELD, VOCABULARY_HELD = 2_500_000, 500_000
# Characters that are cut into words at a time; entries of one row of a stripe.
PIECE_BYTES, ROW_ENTRIES = 1 << 20, 4096
# A prefix is hot if it has one in so many of all words, so no more prefixes than this are. Its stripes have
# so many segments; the stripe of all words has more.
HOT_SHARE, SEGMENTS, WORD_SEGMENTS = 256, 32, 1024
# Stands for a cut between pieces; no valid text holds this byte.
_CUT = b"\xff"
_SEED = 42

_PLAIN = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else (0x20 if b == 9 else (b + 32 if 65 <= b <= 90 else b)) for b in range(256)
)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with A-Z in lower case and a mark at each cut, as lists of bounded length."""
    plain = text.translate(_PLAIN)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + PIECE_BYTES)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].replace(_CUT, b" \xff ").split()
        start = stop


class _Words:
    """The words of one language that a task has read, as numbers; zero is a cut."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[_CUT]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for words in tokens(text):
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def stripes(self, lang: str, level: int, frequent: np.ndarray | None, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Prefixes (a row of numbers each), and for every entry its prefix, segment, next word (zero: all) and count."""
        ids = np.concatenate(self.parts)
        self.parts.clear()
        width = len(self.numbers)
        seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.numbers), np.uint64, width)
        if level == 0:
            n = np.bincount(ids, minlength=width)
            n[0] = n.sum() - n[0]
            segment = (hashes % np.uint64(WORD_SEGMENTS)).astype(np.int64)
            segment[0] = 0
            order = np.argsort(segment, kind="stable")
            return np.empty((1, 0), np.int64), np.zeros(width, np.int64), segment[order], order, n[order]
        places = max(len(ids) - level + 1, 0)
        whole = np.ones(places, bool)
        mixed = np.zeros(places, np.uint64)
        for j in range(level):
            part = ids[j : j + places]
            whole &= part != 0
            mixed = (mixed << np.uint64(1)) ^ hashes[part]
        mixed &= np.uint64(FREQUENT_BITS - 1)
        known = (frequent[(mixed >> np.uint64(3)).astype(np.int64)] >> (mixed & np.uint64(7)).astype(np.uint8)) & 1
        good = whole & (known == 1)
        del mixed, known, whole
        # Extended by one word where the part without the first word is frequent as well.
        at = np.flatnonzero(good[:-1] & good[1:])
        prefixes, prefix = np.zeros((1, 0), np.int64), np.zeros(len(at), np.int64)
        for j in range(level):
            found, prefix = np.unique(prefix * width + ids[at + j], return_inverse=True)
            prefixes = np.column_stack([prefixes[found // width], found % width])
        following = ids[at + level]
        keys, n = np.unique(prefix * width + following, return_counts=True)
        owner, word = keys // width, keys % width
        whole_prefix = np.zeros(len(prefixes), np.uint64)
        for j in range(level):
            whole_prefix = (whole_prefix << np.uint64(1)) ^ hashes[prefixes[:, j]]
        cut = np.isin(whole_prefix, hot)[owner]
        segment = np.where(cut, (hashes[word] % np.uint64(SEGMENTS)).astype(np.int64), 0)
        if cut.any():
            order = np.argsort(owner * SEGMENTS + segment, kind="stable")
            owner, segment, word, n = owner[order], segment[order], word[order], n[order]
        return prefixes, owner, segment, word, n


def _stripe_rows(lang: str, words: list[bytes], prefixes, owner, segment, following, n):
    """Arrow batches of stripes; long ones are cut into several rows."""
    if not len(owner):
        return
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(segment) != 0))
    fresh = np.flatnonzero(new)
    lengths = np.diff(np.append(fresh, len(owner)))
    rows = [
        np.arange(a, a + size, ROW_ENTRIES)
        for a, size in zip(fresh[lengths > ROW_ENTRIES].tolist(), lengths[lengths > ROW_ENTRIES].tolist())
    ]
    starts = np.unique(np.concatenate([fresh, *rows])) if rows else fresh
    ends = np.append(starts[1:], len(owner))
    names = pa.array([None, *words[1:]], pa.binary()).cast(pa.string())
    for a in range(0, len(starts), 20_000):
        first, last = starts[a : a + 20_000], ends[a : a + 20_000]
        low, high = int(first[0]), int(last[-1])
        offsets = pa.array(np.append(first, high) - low, pa.int32())
        parts = [names.take(pa.array(prefixes[owner[first], j])) for j in range(prefixes.shape[1])]
        prefix = pc.binary_join_element_wise(*parts, " ") if parts else pa.array([""] * len(first), pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(first), pa.string()), prefix, pa.array(segment[first].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(following[low:high]))),
                pa.ListArray.from_arrays(offsets, pa.array(n[low:high].astype(np.int32))),
            ],
            ["lang", "prefix", "segment", "word", "n"],
        )


def _level_stripes(batches, level: int, shared) -> Iterator[pa.RecordBatch]:
    """Stripes of all texts of a task; words are held in bounded number."""
    frequent, hot = (None, None) if shared is None else shared.value
    frequent = None if shared is None else np.frombuffer(frequent, np.uint8)
    held: dict[str, _Words] = {}
    n_words = n_distinct = 0

    def given():
        for lang, words in held.items():
            yield from _stripe_rows(lang, list(words.numbers), *words.stripes(lang, level, frequent, hot))
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for at, lang in enumerate(langs):
            words = held.setdefault(lang, _Words())
            before = words.size, len(words.numbers)
            words.add(texts[at].as_py())
            n_words += words.size - before[0]
            n_distinct += len(words.numbers) - before[1]
            if n_words > WORDS_HELD or n_distinct > VOCABULARY_HELD:
                yield from given()
                n_words = n_distinct = 0
    yield from given()


def _mixed(lang: Column, phrase: Column) -> Column:
    """A hash of a phrase from those of its words; ``_Words.stripes`` computes the same."""
    return F.aggregate(
        F.split(phrase, " "), F.lit(0).cast("long"),
        lambda acc, w: F.shiftleft(acc, 1).bitwiseXOR(F.xxhash64(lang, w)),
    )


def _frequent_map(phrases: DataFrame) -> bytes:
    """The places of all ``phrases`` as a bitmap of fixed size, put together from a row per 4 KB."""
    place = _mixed(F.col("lang"), F.col("phrase")).bitwiseAND(F.lit(FREQUENT_BITS - 1).cast("long")) + 1
    rows = (
        phrases.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    whole = np.zeros(FREQUENT_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["bucket"] - 1) * part.size
        whole[start : start + part.size] = part
    return whole.tobytes()


def _hot_phrases(phrases: DataFrame, n_words: int) -> np.ndarray:
    """Hashes of the phrases with one in ``HOT_SHARE`` of all words, of which there are no more than that."""
    hot = phrases.where(F.col("a") * HOT_SHARE >= n_words).select(_mixed(F.col("lang"), F.col("phrase")).alias("h"))
    return np.array([r["h"] for r in hot.collect()], np.int64).view(np.uint64)


def merged_stripes(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> list[DataFrame]:
    """Merged stripes ``lang``, ``prefix``, ``word``, ``n`` of prefixes of 0 to ``max_words - 1`` words.

    A missing ``word`` stands for all words. Extensions that come less than ``min_count`` times are left out.
    """
    # Bytes are lower-cased and cut in the tasks; only two columns are read.
    plain = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    levels: list[DataFrame] = []
    shared, n_words = None, 0
    for level in range(max_words):
        made = plain.mapInArrow(
            partial(_level_stripes, level=level, shared=shared),
            "lang string, prefix string, segment int, word array<string>, n array<int>",
        )
        # Partitioned by a part of what is grouped by: stripes are unfolded and added where they arrive.
        entries = made.repartition("lang", "prefix", "segment").select(
            "lang", "prefix", "segment", F.inline(F.arrays_zip("word", "n"))
        )
        added = entries.groupBy("lang", "prefix", "segment", "word").agg(F.sum("n").alias("n"))
        kept = added.where(F.col("word").isNull() | (F.col("n") >= min_count)).drop("segment")
        levels.append(saved(kept, f"stripes-{level}"))
        if level == 0:
            n_words = levels[0].where("word is null").agg(F.sum("n")).first()[0] or 0
        if level + 1 < max_words:
            phrases = _extensions(levels[-1], level)
            shared = docs.sparkSession.sparkContext.broadcast((_frequent_map(phrases), _hot_phrases(phrases, n_words)))
    return levels


def _extensions(stripes: DataFrame, level: int) -> DataFrame:
    """``lang``, ``phrase``, ``prefix`` and count ``a`` of every extension of a level."""
    phrase = F.col("word") if level == 0 else F.concat_ws(" ", "prefix", "word")
    return stripes.where("word is not null").select("lang", phrase.alias("phrase"), "prefix", F.col("n").alias("a"))


def _words(phrase: str, start: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, subsumed_at: int = 50, top: int = 2000
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases of two to ``max_words`` words that come ``min_count`` times are scored by their weakest cut,
    ``floor(10^6 a^2 / (l r))`` (the first of equal cuts). A phrase goes if a longer one that holds it has at
    least ``subsumed_at`` hundredths of its count; it suffices to look at those with one word more, which
    are at least as frequent. Products are decimals of 38 digits. No documents give no rows.
    """
    levels = merged_stripes(docs, max_words, min_count)
    totals = reduce(
        DataFrame.unionAll,
        [_extensions(s, level).select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")) for level, s in enumerate(levels[:-1])],
    )
    n_words = levels[0].where("word is null").select("lang", "n")
    ranked = []
    for level in range(1, max_words):
        phrases = _extensions(levels[level], level)
        if level + 1 < max_words:
            longer = _extensions(levels[level + 1], level + 1)
            heads = longer.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("most"))
            tails = longer.groupBy("lang", _words("phrase", 2, level + 1).alias("phrase")).agg(F.max("a").alias("most"))
            most = heads.union(tails).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
            phrases = phrases.join(most, ["lang", "phrase"], "left").where(
                F.col("most").isNull() | (100 * F.col("most") < subsumed_at * F.col("a"))
            )
        cuts = F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"), _words("phrase", 1, k).alias("left"),
                    _words("phrase", k + 1, level + 1 - k).alias("right"),
                )
                for k in range(1, level + 1)
            ]
        )
        ranked.append(phrases.select("lang", "phrase", "a", F.inline(cuts)))
    cuts = reduce(DataFrame.unionAll, ranked)
    whole = "cast({} as decimal(15, 0))".format
    score = F.expr(f"(1000000BD * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    scored = (
        cuts.join(totals.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(totals.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(n_words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
