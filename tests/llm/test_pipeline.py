import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions
from tokenizers import Tokenizer

import corpus_pipeline
from tenc.llm import mixing, quality, suite, toxicity
from test_simhash import brute_print

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").persist()
    left, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in left.select("doc_id").collect()}
        found = stage(spark, left, FOLDER)
        assert found.columns == columns and found.schema == docs.schema, name
        left = found.persist()
        after = Counter(r["doc_id"] for r in left.select("doc_id").collect())
        assert set(after) <= before and max(after.values()) == 1
        if name == "mixing":
            assert set(after) == before
    packed = corpus_pipeline.run(spark, FOLDER)
    pieces = packed.select("doc_id", "start", "length", "doc_tokens").collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in left.select("doc_id").collect()}
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert all(total[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_stages_take_odd_rows_and_empty_tables(spark, edges, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name
        assert stage(spark, edges, FOLDER).count() > 0, name


def test_sequences_follow_the_mixture_over_files_of_different_sizes(spark, tmp_path):
    rows = [(i, f"s{i % 7}", f"word{i} " * (1 + i % 9 * i // 4)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    path = str(tmp_path / "mixed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [r["doc_id"] for r in mixing.mixed(docs, block_chars=512).select("doc_id").collect()]
        mixing.mixed(docs, block_chars=512).write.parquet(path)
        files = sorted(p.stat().st_size for p in (tmp_path / "mixed").glob("part-*.parquet"))
        assert len(files) > 4 and files[0] < files[-1]
        packed = corpus_pipeline.packed(spark, spark.read.parquet(path), FOLDER)
        found = packed.select("doc_id", "sequence_id", "offset", "start").orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p["doc_id"] for p in found if p["start"] == 0] == order


def test_queries_are_the_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in suite.QUERIES) == list(range(1, 14))
    names = ["toxicity", "quality", "simhash_near_dedup", "mixing", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    assert toxicity.SAMPLE_ROWS == 2000


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    """Which documents leave and in which order the rest is packed, worked out in plain Python from each stage's input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    learned = functions.pmod(functions.crc32(functions.col("doc_id").cast("string").cast("binary")), functions.lit(4)) != 2
    model = toxicity.train(docs, labels, learned)
    kept = {}
    for k, t in rows.items():
        words = toxicity.words_of(t)
        odds = model[1] + sum(
            sum(float(model[0][g]) for g in toxicity.grams_of(w)) / len(toxicity.grams_of(w)) for w in words
        ) / (len(words) + toxicity.PADDING)
        if 1 / (1 + math.exp(-odds)) < 0.3:
            kept[k] = t
    left = docs.where(functions.col("doc_id").isin(list(kept)))
    good = {r["doc_id"] for r in quality.measured(left, keep=["doc_id"]).where("kept").collect()}
    kept = {k: t for k, t in kept.items() if k in good}
    prints = {k: brute_print(t) for k, t in kept.items()}
    least = {k: k for k in kept}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(kept), 2):
            if least[a] != least[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    kept = {k for k in kept if least[k] == k}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == kept
    library = Tokenizer.from_file(suite.tokenizer_path())
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for k, found in pieces.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(found)), "<u4").tolist()
        assert ids == [*library.encode(rows[k] or "", add_special_tokens=False).ids, 2]
    mixed = [r["doc_id"] for r in mixing.mixed(docs.where(functions.col("doc_id").isin(list(kept)))).select("doc_id").collect()]
    firsts = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in packed if r["start"] == 0)
    assert [k for *_, k in firsts] == mixed
