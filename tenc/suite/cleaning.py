"""Queries over cleaning expressions, row filters and role-driven preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions import cleaning as C
from tenc.functions.hashing import SAMPLE_SEED
from tenc.operators import prepare as P
from tenc.operators.rank import first_by_hash, hash_position
from tenc.suite.bases import digest_sql, rounded, table
from tenc.suite.registry import query


@query(
    "lenient_int",
    r"""
SELECT c_custkey,
       TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS from_digits,
       CASE WHEN regexp_matches(trim(c_name), '^[+-]?[0-9]+$')
            THEN TRY_CAST(trim(c_name) AS BIGINT) END AS from_text,
       trunc(c_acctbal)::BIGINT AS from_number
FROM customer""",
)
def lenient_int(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        C.lenient_int(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("from_digits"),
        C.lenient_int(F.col("c_name")).alias("from_text"),
        C.lenient_int(F.col("c_acctbal"), "double").alias("from_number"),
    )


@query(
    "replace_chars",
    r"""
SELECT doc_id, replace(replace(lang, 'e', ' '), 'f', '') AS lang,
       replace(replace(source, 'e', ' '), 'f', '') AS source, n_chars,
       md5(replace(replace(replace(replace(text, chr(13) || chr(10), ''), chr(10), ''),
                           'e', ' '), 'f', '')) AS digest
FROM documents""",
)
def replace_chars(spark: SparkSession, folder: str) -> DataFrame:
    changes = {"\r\n": "", "\n": "", "e": " ", "f": ""}
    cleaned = C.replace_in_text_columns(table(spark, folder, "documents"), changes)
    return cleaned.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query(
    "sentinel_to_null",
    """
SELECT o_orderkey,
       CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END
         AS priority
FROM orders""",
)
def sentinel_to_null(spark: SparkSession, folder: str) -> DataFrame:
    priority = C.sentinel_to_null(F.col("o_orderpriority"), ["4-NOT SPECIFIED", "5-LOW"])
    return table(spark, folder, "orders").select("o_orderkey", priority.alias("priority"))


@query(
    "sentinel_contains",
    """
SELECT o_orderkey,
       CASE WHEN NOT contains(o_orderpriority, 'NOT') THEN o_orderpriority END AS priority,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer
FROM orders""",
)
def sentinel_contains(spark: SparkSession, folder: str) -> DataFrame:
    hidden = F.when(F.col("o_orderstatus") == "P", "PrivacySuppressed").otherwise(
        F.col("o_custkey").cast("string")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        C.containing_to_null(F.col("o_orderpriority"), "NOT").alias("priority"),
        C.int_unless_containing(hidden, "PrivacySuppressed").alias("customer"),
    )


@query(
    "year_from_date",
    """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS order_year, NULL::INTEGER AS unreadable
FROM orders""",
)
def year_from_date(spark: SparkSession, folder: str) -> DataFrame:
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        C.year_of(text).alias("order_year"),
        C.year_of(F.col("o_orderpriority")).alias("unreadable"),
    )


@query(
    "log_abs_positive",
    """
SELECT c_custkey, round(ln(abs(c_acctbal)), 6) AS log_balance
FROM customer WHERE abs(c_acctbal) > 1""",
)
def log_abs_positive(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    kept = C.keep_positive_log(customers, "c_acctbal", "log_balance")
    return rounded(kept.select("c_custkey", "log_balance"), "log_balance")


@query("log_eps", "SELECT event_id, round(ln(value + 1e-10), 6) AS log_value FROM events")
def log_eps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", F.round(C.log_shifted(F.col("value")), 6).alias("log_value"))


@query(
    "parse_thousands",
    "SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price FROM orders",
)
def parse_thousands(spark: SparkSession, folder: str) -> DataFrame:
    text = F.format_number("o_totalprice", 2)
    return table(spark, folder, "orders").select(
        "o_orderkey", F.round(F.ln(C.number_with_separators(text)), 6).alias("log_price")
    )


@query(
    "strip_suffix",
    "SELECT l_orderkey, l_linenumber, round(l_discount * 100)::DOUBLE AS percent FROM lineitem",
)
def strip_suffix(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", C.without_last_character(text).alias("percent")
    )


@query(
    "binarize_label",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS finished
FROM orders""",
)
def binarize_label(spark: SparkSession, folder: str) -> DataFrame:
    finished = C.equals_label(F.col("o_orderstatus"), "F").alias("finished")
    return table(spark, folder, "orders").select("o_orderkey", finished)


_LABELLED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


@query(
    "filter_not_equal",
    f"""
SELECT doc_id, quality - 1 AS quality FROM {_LABELLED} t
WHERE quality IS DISTINCT FROM 1 AND source IS DISTINCT FROM 'crawl'""",
)
def filter_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a missing value stay; the remaining codes are shifted by one."""
    kept = _labelled(spark, folder).where(
        C.differs_from(F.col("quality"), 1) & C.differs_from(F.col("source"), "crawl")
    )
    return kept.select("doc_id", (F.col("quality") - 1).alias("quality"))


@query("filter_isin", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def filter_isin(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query(
    "recode_map",
    """
SELECT p_partkey, CASE p_size WHEN 1 THEN 'tiny' WHEN 2 THEN 'small' WHEN 50 THEN 'huge'
                              ELSE p_size::VARCHAR END AS size_name
FROM part""",
)
def recode_map(spark: SparkSession, folder: str) -> DataFrame:
    names = {1: "tiny", 2: "small", 50: "huge"}
    return table(spark, folder, "part").select(
        "p_partkey", C.recode(F.col("p_size"), names).alias("size_name")
    )


@query("string_normalize", "SELECT c_custkey, ' ' || lower(c_name) || ' ' AS c_name FROM customer")
def string_normalize(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return P.normalise_columns(customers, ["c_name"])


@query("trim_column_names", "SELECT c_custkey, c_nationkey FROM customer")
def trim_column_names(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" c_custkey"), F.col("c_nationkey").alias("c_nationkey  ")
    )
    return C.trim_column_names(customers)


_ORDER_ROLES = {
    "o_orderkey": "Numerical",
    "o_custkey": "Special",
    "o_orderstatus": "Delete",
    "o_orderpriority": "OneHotEncoderDense",
    "o_orderdate": "Delete",
    "o_totalprice": "y",
}


@query("project_roles", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def project_roles(spark: SparkSession, folder: str) -> DataFrame:
    return P.project_roles(table(spark, folder, "orders"), _ORDER_ROLES)


@query(
    "null_fraction",
    f"""
WITH t AS (SELECT * FROM {_LABELLED} t), f AS (
  SELECT 'lang' AS "column", avg((lang IS NULL)::INTEGER) AS fraction FROM t
  UNION ALL SELECT 'quality', avg((quality IS NULL)::INTEGER) FROM t
  UNION ALL SELECT 'toxic', avg((toxic IS NULL)::INTEGER) FROM t)
SELECT "column", round(fraction, 6) AS fraction, fraction > 0.15 AS exceeds FROM f""",
)
def null_fraction(spark: SparkSession, folder: str) -> DataFrame:
    shares = P.missing_fractions(_labelled(spark, folder), ["lang", "quality", "toxic"])
    return rounded(shares, "fraction")


_DOCUMENT_ROLES = {
    "lang": "OneHotEncoderDense",
    "source": "Special",
    "toxic": "OneHotEncoderDense",
    "n_chars": "Numerical",
    "quality": "y",
}


@query(
    "fill_na_by_role",
    f"""
SELECT doc_id, coalesce(lang, 'na') AS lang, coalesce(source, 'na') AS source,
       coalesce(toxic::VARCHAR, 'na') AS toxic, n_chars, quality
FROM {_LABELLED} t""",
)
def fill_na_by_role(spark: SparkSession, folder: str) -> DataFrame:
    df = P.project_roles(_labelled(spark, folder), _DOCUMENT_ROLES, "doc_id")
    return P.fill_missing_by_role(df, _DOCUMENT_ROLES)


@query(
    "drop_null_rows",
    f"""
SELECT doc_id, coalesce(lang, 'na') AS lang, ' ' || lower(coalesce(source, 'na')) || ' ' AS source,
       coalesce(toxic::VARCHAR, 'na') AS toxic, n_chars, quality
FROM {_LABELLED} t WHERE quality IS NOT NULL AND n_chars IS NOT NULL""",
)
def drop_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation: fill, drop incomplete rows, normalise the special column."""
    return P.prepare(_labelled(spark, folder), _DOCUMENT_ROLES, "doc_id", check_missing=False)


@query("drop_null_subset", f"SELECT doc_id, quality FROM {_LABELLED} t WHERE quality IS NOT NULL")
def drop_null_subset(spark: SparkSession, folder: str) -> DataFrame:
    return P.drop_missing(_labelled(spark, folder), ["quality"]).select("doc_id", "quality")


@query(
    "sample_exact",
    f"""
SELECT event_id, user_id, value FROM (
  SELECT *, row_number() OVER (ORDER BY {digest_sql("event_id", SAMPLE_SEED)}) AS p FROM events)
WHERE p <= 2500""",
)
def sample_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 2,500 events without replacement."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return first_by_hash(events, "event_id", 2500)


@query(
    "shuffle_rank",
    f"""
SELECT event_id, row_number() OVER (ORDER BY {digest_sql("event_id", SAMPLE_SEED)}) AS row_pos
FROM events""",
)
def shuffle_rank(spark: SparkSession, folder: str) -> DataFrame:
    return hash_position(table(spark, folder, "events").select("event_id"), "event_id")


@query(
    "head_rows",
    f"""
SELECT o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (ORDER BY {digest_sql("o_orderkey", SAMPLE_SEED)}) AS p FROM orders)
WHERE p <= 10000""",
)
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first 10,000 rows in a fixed order (a table has none of its own)."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return first_by_hash(orders, "o_orderkey", 10_000)
