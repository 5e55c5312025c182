import random

import numpy as np
import xxhash

from tenc.llm import golay, simhash
from tenc.llm.graph import components


def brute_print(text, width=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [words] if len(words) <= width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest key reachable over at most four differing bits, by (key, fingerprint)."""
    label = {i: k for i, (k, _) in enumerate(prints)}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and (label[j] is None or (label[i] is not None and label[i] < label[j])):
                    if label[i] is not None and label[i] != label[j]:
                        label[j], changed = label[i], True
    return label


def test_golay_keys_of_words_two_bits_apart_meet():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(23) for _ in range(300)])
    keys, used = golay.keys(words)
    assert set(used.sum(axis=1)) == {1, 6}
    for flips in ((0,), (5,), (3, 17), (22, 1)):
        other = words ^ sum(1 << f for f in flips)
        theirs, theirs_used = golay.keys(other)
        for a, au, b, bu in zip(keys, used, theirs, theirs_used):
            assert set(a[au]) & set(b[bu])
            if len(flips) == 1:
                assert a[0] in b[bu] and b[0] in a[au]


def test_keys_cover_all_pairs_within_four_bits():
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        pairs.append((a, b))
    flat = np.array([x for p in pairs for x in p], np.uint64).view(np.int64)
    found = {}
    for key, row in simhash._keys_within_four({"f0": flat}):
        for k, r in zip(key.tolist(), row.tolist()):
            found.setdefault(r, set()).add(k)
    assert all(found[2 * i] & found[2 * i + 1] for i in range(len(pairs)))


def test_majority_counts_past_a_lane():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 70_001, dtype=np.uint64)
    hashes[:40_000] = hashes[0]
    assert simhash.majority([hashes, hashes[:0], hashes[1:2]]).tolist() == [int(hashes[0]), 0, int(hashes[1])]


def test_fingerprint_classes_equal_brute_force(spark, edges):
    rng = random.Random(4)
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    texts = []
    for i in range(120):
        words = list(base) if i % 3 else [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(8))]
        for _ in range(i % 4):
            words[rng.randrange(len(words)) if words else 0 :][:1] = []
            if words:
                words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts.append((1000 + i, " ".join(words)))
    more = spark.createDataFrame(texts, "doc_id long, text string")
    docs = edges.select("doc_id", "text").union(more)
    for block in (simhash.BLOCK, 4):
        rows = simhash.fingerprint_classes(docs, block=block).collect()
        given = [(r["doc_id"], r["text"]) for r in docs.collect()]
        expected_prints = [(k, brute_print(t)) for k, t in given]
        label = brute_classes(expected_prints)
        expected = sorted((str(k), f"{f:016x}", str(label[i])) for i, (k, f) in enumerate(expected_prints))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == expected


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_one_of_each_class_stays(spark, edges):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        for copy in range(3):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(400)] = f"x{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = brute_classes([(k, brute_print(t)) for k, t in rows])
    expected = sorted(k for (k, _), least in zip(rows, label.values()) if k == least)
    assert 60 <= len(expected) < 180
    for block in (simhash.BLOCK, 8):
        kept = simhash.without_near_duplicates(docs, block=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == expected
    left = simhash.without_near_duplicates(edges)
    assert left.columns == edges.columns
    # Missing, empty and blank texts are copies of each other; of equal rows one stays.
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "3", "5", "None", "7", "8", "9"])


def test_empty_table(nothing):
    assert simhash.fingerprint_classes(nothing).count() == 0
    assert simhash.without_near_duplicates(nothing).count() == 0
