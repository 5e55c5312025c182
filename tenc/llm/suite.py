"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.llm import (
    langid, licenses, lm, mixing, multiset, negatives, oracles, packing, phrases, pq, quality, simhash, tokens, toxicity,
)
from tenc.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint classes of all documents."""
    return simhash.fingerprint_classes(table(spark, folder, "documents"))


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a bigram model of those whose key's CRC-32 modulo 7 is not 2."""
    return lm.held_out_scores(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    return tokens.count_tokens(table(spark, folder, "documents"), tokenizer_path(), limit=2048)


def op4_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return multiset.edited_fingerprints(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens; the ids themselves are left out."""
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path(), window=4096, end_id=2)
    return packed.drop("ids")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality measures and verdicts of all documents."""
    return quality.measured(table(spark, folder, "documents"), keep=["doc_id"]).withColumn(
        "failed_rules", F.array_join("failed_rules", ",")
    )


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents in a mixture that flattens the sources' sizes."""
    return mixing.positions(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of rows whose key's CRC-32 modulo 4 is not 2."""
    return toxicity.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all pages: own notices, or those of the nearest directory of the address."""
    address = F.regexp_extract("url", r"^[a-zA-Z]+://([^?#]+)", 1)
    files = table(spark, folder, "pages").select(
        F.col("page_id").alias("file_id"),
        F.when(address != "", F.regexp_replace(address, "/+$", "")).alias("path"),
        F.regexp_replace("html", "<[^>]*>", "\n").alias("text"),
    )
    return licenses.scan(files).withColumnRenamed("file_id", "page_id")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from rows whose key's CRC-32 modulo 5 is not 0."""
    return langid.held_out_languages(table(spark, folder, "documents"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language of all documents."""
    return phrases.collocations(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten negatives for each of the first five positives of every hundredth embedding, against all rows."""
    rows = negatives.from_embeddings(table(spark, folder, "embeddings"))
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and classes of all embeddings by cosine 0.95."""
    return pq.near_duplicates(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_lm_score, op3_token_counts, op4_multiset_hash, op5_packing, op6_quality, op7_mixing,
        op8_toxicity, op9_licenses, op10_language_id, op11_phrases, op12_hard_negatives, op13_embedding_dedup,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
