"""Queries over joins, unions, duplicate removal and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.operators import profile, relate
from tenc.suite.bases import PRICES_SQL, prices, rounded, table
from tenc.suite.registry import query


@query(
    "composite_key_join",
    """
WITH pairs AS (SELECT l_partkey, l_suppkey, count(*) AS n_items, sum(l_quantity) AS quantity
               FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR || l_suppkey::VARCHAR AS pair_key,
       n_items, quantity
FROM lineitem LEFT JOIN pairs USING (l_partkey, l_suppkey)""",
)
def composite_key_join(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    pairs = items.groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("quantity")
    )
    joined = items.join(pairs, ["l_partkey", "l_suppkey"], "left")
    key = relate.composite_key("l_partkey", "l_suppkey").alias("pair_key")
    return joined.select("l_orderkey", "l_linenumber", key, "n_items", "quantity")


@query(
    "left_join_suffix",
    """
SELECT c_nationkey AS nationkey, c_custkey AS custkey, c_name AS name_customer,
       n_name AS name_nation
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey
WHERE n_name IS NOT NULL""",
)
def left_join_suffix(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("custkey"),
        F.col("c_name").alias("name"),
    )
    nations = table(spark, folder, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name")
    )
    return relate.left_join_suffixed(
        customers, nations, ["nationkey"], "_customer", "_nation", ["name_nation"]
    )


@query(
    "unknown_categories",
    """
SELECT DISTINCT c_custkey AS value FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def unknown_categories(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    return relate.unseen_values(table(spark, folder, "customer"), known, "c_custkey")


@query(
    "union_tagged",
    """
SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS status
FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier""",
)
def union_tagged(spark: SparkSession, folder: str) -> DataFrame:
    def party(name: str, letter: str) -> DataFrame:
        columns = ["name", "nationkey", "acctbal"]
        return table(spark, folder, name).select(
            *[F.col(f"{letter}_{c}").alias(c) for c in columns]
        )

    parts = {"customer": party("customer", "c"), "supplier": party("supplier", "s")}
    return relate.union_tagged(parts, ["name", "nationkey", "acctbal"], "status")


@query(
    "dedup_rows",
    "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem",
)
def dedup_rows(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    return relate.distinct_rows(items)


@query(
    "dedup_subset",
    """
SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1""",
)
def dedup_subset(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"
    )
    return relate.first_per_key(orders, ["o_custkey", "o_orderstatus"], "o_orderkey")


_COUNTS_SQL = """
counts AS (
  SELECT 'user_id' AS "column", user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2
  UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY 2)"""
_COUNTED = ["user_id", "event_type", "props"]


@query("value_counts", f'WITH {_COUNTS_SQL} SELECT "column", value, n FROM counts')
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(table(spark, folder, "events"), _COUNTED)


@query("distinct_values", f'WITH {_COUNTS_SQL} SELECT "column", value FROM counts')
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_values(table(spark, folder, "events"), _COUNTED)


@query(
    "category_profile",
    f"""
WITH {_COUNTS_SQL},
means AS (SELECT "column", avg(n) AS mean FROM counts GROUP BY 1)
SELECT "column", sum(n)::BIGINT AS n_rows, count(*) AS n_categories, max(n) AS n_most_frequent,
       median(n)::DOUBLE AS n_median, count(*) FILTER (n < mean / 5) AS n_under_mean5
FROM counts JOIN means USING ("column") GROUP BY 1""",
)
def category_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.category_profile(table(spark, folder, "events"), _COUNTED)


_RANKED_SQL = f"""
WITH {_COUNTS_SQL},
ranked AS (SELECT "column", n, count(*) OVER (PARTITION BY "column") AS k,
           row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM counts)"""


@query("rank_frequency", f'{_RANKED_SQL} SELECT "column", rank, n FROM ranked')
def rank_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rank_frequency(table(spark, folder, "events"), _COUNTED)


@query(
    "rank_frequency_resampled",
    f"""{_RANKED_SQL},
grid AS (SELECT DISTINCT "column", k, unnest(range(1000)) AS point FROM ranked),
spots AS (SELECT "column", point, point * (k - 1) // 999 AS lower,
                 (point * (k - 1) % 999) / 999.0::DOUBLE AS share,
                 (point * (k - 1) + 998) // 999 AS upper FROM grid)
SELECT s."column", s.point, round(s.point / 999.0::DOUBLE, 6) AS x,
       round(a.n + (b.n - a.n) * share, 6) AS frequency
FROM spots s JOIN ranked a ON a."column" = s."column" AND a.rank = s.lower + 1
JOIN ranked b ON b."column" = s."column" AND b.rank = s.upper + 1""",
)
def rank_frequency_resampled(spark: SparkSession, folder: str) -> DataFrame:
    curve = profile.rank_frequency_resampled(table(spark, folder, "events"), _COUNTED)
    return rounded(curve, "x", "frequency")


@query(
    "onehot_guard",
    """
SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) AS n_categories,
       count(DISTINCT l_orderkey) > 5000 AS skip_one_hot FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey) > 5000
FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag),
                 count(DISTINCT l_returnflag) > 5000 FROM lineitem""",
)
def onehot_guard(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    return profile.one_hot_guard(items, ["l_orderkey", "l_partkey", "l_returnflag"])


@query(
    "class_balance",
    """
WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1)
SELECT class, n, round(n / (SELECT sum(n) FROM c)::DOUBLE, 6) AS fraction,
       n = (SELECT max(n) FROM c) AS most_frequent FROM c""",
)
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.class_balance(table(spark, folder, "orders"), "o_orderstatus"), "fraction")


@query(
    "target_kind",
    f"""
WITH {PRICES_SQL}
SELECT 'o_totalprice' AS target, count(DISTINCT o_totalprice) AS n_values,
       CASE WHEN max((o_totalprice <> floor(o_totalprice))::INTEGER) = 1 THEN 'continuous'
            WHEN count(DISTINCT o_totalprice) <= 2 THEN 'binary' ELSE 'multiclass' END AS kind
FROM prices
UNION ALL
SELECT 'o_orderstatus', count(DISTINCT o_orderstatus),
       CASE WHEN count(DISTINCT o_orderstatus) <= 2 THEN 'binary' ELSE 'multiclass' END
FROM prices
UNION ALL
SELECT 'quality', count(DISTINCT quality),
       CASE WHEN count(DISTINCT quality) <= 2 THEN 'binary' ELSE 'multiclass' END
FROM labels""",
)
def target_kind(spark: SparkSession, folder: str) -> DataFrame:
    df = prices(spark, folder)
    sources = {"o_totalprice": df, "o_orderstatus": df, "quality": table(spark, folder, "labels")}
    parts = [
        profile.target_kind(source, name).select(F.lit(name).alias("target"), "n_values", "kind")
        for name, source in sources.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
