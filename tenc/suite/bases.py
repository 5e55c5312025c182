"""The joined tables the queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Binary target: was the item returned?
RETURNS_SQL = """
returns AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_linestatus, p_type, p_brand,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def returns(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_linestatus", "p_type", "p_brand",
        (F.col("l_returnflag") == "R").cast("double").alias("y"),
    )


# Regression target: the price of an order.
PRICES_SQL = """
prices AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, c_acctbal,
         o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment",
        "c_acctbal", "o_totalprice",
    )


def encoding_sql(source: str, category: str, y: str, name: str = "stats") -> str:
    """CTEs with the counts and means by category, and the totals."""
    return f"""
{name} AS (SELECT {category} AS category, count(*) AS n, avg({y}) AS mean
           FROM {source} GROUP BY 1),
{name}_all AS (SELECT count(*) AS n_rows, avg({y}) AS prior, count(DISTINCT {category}) AS k
               FROM {source})"""


def digest_sql(key: str, seed: int, *extra: str) -> str:
    """The SQL form of the row-key hash."""
    parts = " || '|' || ".join([f"{key}::VARCHAR", f"'{seed}'", *[f"{e}::VARCHAR" for e in extra]])
    return f"md5({parts})"


def uniform_sql(digest: str, word: int = 0) -> str:
    return f"(('0x' || substr({digest}, {1 + 8 * word}, 8))::BIGINT / 4294967296.0::DOUBLE)"
