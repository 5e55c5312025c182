"""The corpus pipeline: stages that each apply one operator of ``tenc.llm`` to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.llm import mixing, packing, quality, simhash, toxicity
from tenc.llm.common import crc_of_id, table
from tenc.llm.suite import tokenizer_path
from tenc.session import scratch_path

TOXIC_FROM = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; a quarter of the labels is not learned from."""
    learned = F.pmod(crc_of_id(), F.lit(4)) != 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learned)
    scored = toxicity.score(docs, model, column="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC_FROM).drop("_toxicity")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.passing(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints of four-word shingles that differ in four bits or fewer."""
    return simhash.without_near_duplicates(docs, width=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mixture that flattens the sources' sizes."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences, with their token ids, in the order of the mixture."""
    return packing.pack(docs, tokenizer_path(), ordered=True)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("simhash_near_dedup", without_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Fingerprints, trained models and tokenizers are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
