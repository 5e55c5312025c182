"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint is cut into segments and each segment is decoded to nearby codewords of the Golay
code. Fingerprints that share a key are compared bit by bit. Where a bucket of fingerprints
is large it is cut into blocks, every pair of blocks is a group of its own, and a group gives
back a spanning forest of its links, never all pairs.

Missing texts count as empty. Texts without words have fingerprint zero and are copies of each
other. Repeated rows keep their number; a class is named by its smallest ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.llm import golay
from tenc.llm.common import attach, map_texts, saved, unused, words_of
from tenc.llm.graph import components

SEED = 42
# Fingerprints a block of a large bucket holds on average.
BLOCK = 1024
_LANES = np.uint64(0x0001000100010001)
# No more shingles than a lane of 16 bits can count.
_PIECE = 65535


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; a shorter text is one shingle, none has none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The ``word``-th independent hash derived from each hash; the zeroth is the hash itself."""
    if word == 0:
        return hashes
    x = hashes + np.uint64((word * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: list[np.ndarray], word: int = 0) -> np.ndarray:
    """One fingerprint a text: the bits that more than half of its hashes have."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    result = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    joined = _mixed(np.concatenate([hashes[i] for i in full]), word)
    ends = np.cumsum(sizes[full])
    begins = ends - sizes[full]
    pieces = [np.arange(b, e, _PIECE) for b, e in zip(begins, ends)]
    first = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    starts = np.concatenate(pieces)
    half = sizes[full]
    bits = np.zeros(len(full), np.uint64)
    for shift in range(16):
        lanes = np.add.reduceat((joined >> np.uint64(shift)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint16).reshape(-1, 4).astype(np.int64), first, axis=0)
        for lane in range(4):
            over = (2 * counts[:, lane] > half).astype(np.uint64)
            bits |= over << np.uint64(16 * lane + shift)
    result[full] = bits
    return result


def fingerprints(
    docs: DataFrame, width: int = 4, words: int = 1, distinct: bool = False,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, the number of shingles and ``words`` fingerprint words ``f0, f1, ...`` (long)."""
    names = [f"f{i}" for i in range(words)]

    def run(batches):
        for batch, texts in batches:
            hashes = [shingle_hashes(words_of(t), width) for t in texts]
            if distinct:
                hashes = [np.unique(h) for h in hashes]
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array([len(h) for h in hashes], pa.int64()))
            columns += [pa.array(majority(hashes, i).view(np.int64)) for i in range(words)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_shingles", *names])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, "n_shingles long", *(f"{n} long" for n in names)])
    return map_texts(docs, list(keep), schema, run)


def _emitted(
    prints: DataFrame, columns: list[str],
    make: Callable[[dict[str, np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]],
) -> DataFrame:
    """A row for each key of each row of ``prints``; ``make`` gives keys and the rows they belong to."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                if not batch.num_rows:
                    continue
                values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
                for key, row in make(values):
                    out = [pa.array(key)] + [pa.array(values[c][row]) for c in columns]
                    yield pa.RecordBatch.from_arrays(out, ["key", *columns])

    schema = "key long, " + ", ".join(f"{c} long" for c in columns)
    return prints.select(*columns).mapInArrow(run, schema)


def _keys_within_four(values: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of 64-bit fingerprints of which one is shared if at most four bits differ.

    Segments have 21, 21 and 22 bits. Either one has no error, and then one of the other two
    has at most two: the key joins the exact segment to a Golay key of the other. Or all have
    errors, and then two have exactly one each: the key joins the Golay keys of both, where one
    side is always the segment's own decoding.
    """
    bits = values["f0"].view(np.uint64)
    segments = [
        ((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)
        for s, n in ((0, 21), (21, 21), (42, 22))
    ]
    near = [golay.keys(s) for s in segments]
    rows = np.arange(len(bits))

    def kept(tag, high, slots, used):
        key = (np.int64(tag) << 40) | high | slots
        return key[used], np.broadcast_to(rows[:, None], used.shape)[used]

    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        yield kept(tag, segments[i][:, None] << 12, *near[j])
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), start=6):
        (a, a_used), (b, b_used) = near[i], near[j]
        yield kept(tag, a[:, :1] << 12, b, b_used)
        yield kept(tag, a[:, 1:] << 12, b[:, :1], a_used[:, 1:])


def _forest(distance: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """A shortest spanning forest of the links up to ``limit``: ends and distance."""
    n = len(distance)
    distance = distance.astype(np.int64)
    todo, best, link = np.ones(n, bool), np.full(n, limit + 1), np.full(n, -1)
    found = []
    for _ in range(n):
        i = int(np.argmin(np.where(todo, best, limit + 2)))
        if best[i] <= limit:
            found.append((int(link[i]), i, int(best[i])))
        todo[i] = False
        closer = todo & (distance[i] < best)
        best[closer], link[closer] = distance[i][closer], i
    return found


def _sorted_groups(batches, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows that come sorted by ``key`` and ``pair``, one group at a time."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in columns}
        change = (np.diff(held["key"]) != 0) | (np.diff(held["pair"]) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {c: v[a:b] for c, v in held.items()}
        held = {c: v[cuts[-1]:] for c, v in held.items()}
    if held is not None and len(held["key"]):
        yield held


def _block_pairs(buckets: DataFrame, names: list[str], node: str, block: int) -> DataFrame:
    """The rows of ``buckets`` in every pair of blocks of their ``key`` that they belong to."""
    columns = list(dict.fromkeys([node, *names])) + [
        c for c in buckets.columns if c not in {"key", "n", node, *names}
    ]
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("long")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.shiftleft(F.least(own, j.cast("long")), 32) + F.greatest(own, j.cast("long")),
    )
    return buckets.select("key", F.explode(pairs).alias("pair"), *columns)


def _by_group(spread: DataFrame) -> DataFrame:
    return spread.repartition("key", "pair").sortWithinPartitions("key", "pair")


def _distances(
    group: dict[str, np.ndarray], names: list[str], limit: int,
    agree: Callable[[dict[str, np.ndarray]], np.ndarray] | None,
) -> np.ndarray:
    """Differing bits of each two of a group; more than ``limit`` on the diagonal and where they do not agree."""
    distance = np.zeros((len(group["key"]),) * 2, np.uint16)
    for name in names:
        x = group[name].view(np.uint64)
        distance += np.bitwise_count(x[:, None] ^ x[None, :])
    if agree is not None:
        distance[~agree(group)] = limit + 1
    np.fill_diagonal(distance, limit + 1)
    return distance


def _bucket_links(
    spread: DataFrame, names: list[str], limit: int, node: str,
    agree: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """A shortest forest of links ``u``, ``v``, ``bits`` of each group ``key``, ``pair`` of ``spread``.

    ``spread`` also has ``node`` and fingerprint words ``names``.
    """
    columns = [c for c in spread.columns if c not in {"key", "pair"}]

    def run(batches):
        for group in _sorted_groups(batches, ["key", "pair", *columns]):
            if len(group["key"]) < 2:
                continue
            distance = _distances(group, names, limit, agree)
            live = np.flatnonzero((distance <= limit).any(axis=1))
            if not len(live):
                continue
            found = _forest(distance[np.ix_(live, live)], limit)
            ids = group[node][live]
            u, v, bits = (np.array(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group["key"][: len(u)]), pa.array(group["pair"][: len(u)]),
                    pa.array(ids[u]), pa.array(ids[v]), pa.array(bits.astype(np.int32)),
                ],
                ["key", "pair", "u", "v", "bits"],
            )

    return _by_group(spread).mapInArrow(run, "key long, pair long, u long, v long, bits int")


def links_within_four(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``u``, ``v`` that connect distinct 64-bit fingerprints (``f0``) as all pairs within four bits do.

    Buckets of two are compared in the aggregate itself. Of larger buckets with the same
    members only one is looked at.
    """
    limit = 4
    keyed = _emitted(prints, ["f0"], _keys_within_four)
    stats = saved(
        keyed.groupBy("key").agg(
            F.count("*").alias("n"), F.min("f0").alias("u"), F.max("f0").alias("v"),
            F.bit_xor(F.xxhash64("f0")).alias("members"),
        ).where("n > 1"),
        "buckets",
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= limit
    two = stats.where((F.col("n") == 2) & near).select("u", "v")
    large = saved(
        stats.where("n > 2").groupBy("n", "u", "v", "members").agg(F.min("key").alias("key"))
        .select("key", "n"),
        "large-buckets",
    )
    members = attach(keyed, large, ["key"], "inner")
    more = _bucket_links(_block_pairs(members, ["f0"], "f0", block), ["f0"], limit, "f0")
    return two.union(more.select("u", "v")).distinct()


def fingerprint_classes(docs: DataFrame, width: int = 4, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Classes are the connected components of fingerprints that differ in at most four bits.
    A class whose keys are all missing has a missing ``component_id``.
    """
    prints = saved(fingerprints(docs, width), "fingerprints")
    groups = saved(
        prints.groupBy("f0").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")),
        "groups",
    )
    roots = components(links_within_four(groups.select("f0"), block))
    named = groups.join(roots.withColumnRenamed("node", "f0"), "f0", "left").withColumn(
        "root", F.coalesce("root", "f0")
    )
    smallest = named.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("copies").alias("size")
    ).where("size > 1")
    shared = saved(named.join(smallest, "root").select("f0", "component_id"), "classes")
    return attach(prints, shared.withColumn("_in", F.lit(True)), ["f0"]).select(
        "doc_id",
        F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"),
        F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "n_shingles",
    )


# A key where it is missing, so that every row has one.
_NO_KEY = -(1 << 63)


def without_near_duplicates(docs: DataFrame, width: int = 4, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` but for all but one of each class of ``fingerprint_classes``.

    The row with the smallest key stays (a missing key is the smallest), of equal rows one.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_KEY))
    k, h = unused(docs, "key", "hash")
    hashed = docs.withColumn(k, key).withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = saved(fingerprints(hashed, width, keep=(k, h)), "fingerprints")
    groups = saved(
        prints.groupBy("f0").agg(F.min(F.struct(k, h)).alias("first"), F.count("*").alias("copies")), "groups"
    )
    roots = components(links_within_four(groups.select("f0"), block))
    named = groups.join(roots.withColumnRenamed("node", "f0"), "f0", "left").withColumn("root", F.coalesce("root", "f0"))
    best = named.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("size"))
    shared = saved(
        named.join(best.where("size > 1"), "root").select("f0", f"best.{k}", f"best.{h}")
        .toDF("f0", "_best_key", "_best_hash"),
        "classes",
    )
    dropped = saved(
        attach(prints.select("f0", k, h), shared, ["f0"], "inner")
        .where((F.col(k) != F.col("_best_key")) | (F.col(h) != F.col("_best_hash")))
        .select(k, h).distinct(),
        "dropped",
    )
    kept = attach(hashed, dropped, [k, h], "left_anti")
    repeated = saved(
        prints.groupBy(k, h).agg(F.count("*").alias("n")).where("n > 1").select(k, h),
        "repeated",
    )
    if repeated.count():
        once = attach(kept, repeated, [k, h], "left_semi").dropDuplicates([k, h])
        kept = attach(kept, repeated, [k, h], "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
