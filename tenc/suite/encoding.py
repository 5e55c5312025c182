"""Queries over the encoders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions.hashing import SPLIT_SEED
from tenc.operators.encoders import heldout
from tenc.operators.encoders.bayes import fit_empirical_bayes
from tenc.operators.encoders.plain import fit_counts, fit_one_hot
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION, fit_stats
from tenc.operators.encoders.target import fit
from tenc.operators.scaling import fit_scaling
from tenc.operators.splits import shuffle_split
from tenc.suite.bases import (
    PRICES_SQL,
    RETURNS_SQL,
    digest_sql,
    encoding_sql,
    prices,
    returns,
    rounded,
    table,
    uniform_sql,
)
from tenc.suite.registry import query

_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_ITEM_SQL = ", ".join(_ITEM)


def _encoded_items(encoding, df: DataFrame, column: str) -> DataFrame:
    out = encoding.apply(df).select(*_ITEM, "y", F.col(column + "_enc").alias("enc"))
    return rounded(out, "enc")


def _single(name: str) -> Column:
    """Single precision, for means of cents that would often lie halfway between decimals."""
    return F.col(name).cast("float").alias("enc")


def _narrow(value: Column | str, name: str = "enc") -> Column:
    """A double with single precision: sums in another order do not change it."""
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("float").cast("double").alias(name)


def _items_sql(category: str, weight: str) -> str:
    return f"""
WITH {RETURNS_SQL}, {encoding_sql("returns", category, "y")}
SELECT {_ITEM_SQL}, y, round(w * mean + (1 - w) * prior, 6) AS enc
FROM (SELECT r.*, s.mean, a.prior, {weight} AS w
      FROM returns r JOIN stats s ON r.{category} = s.category CROSS JOIN stats_all a)"""


@query(
    "te_fit_stats",
    f"""
WITH {RETURNS_SQL},
long AS (
  SELECT 'p_type' AS feature, p_type AS category, y FROM returns
  UNION ALL SELECT 'p_brand', p_brand, y FROM returns
  UNION ALL SELECT 'l_partkey', l_partkey::VARCHAR, y FROM returns),
stats AS (SELECT feature, category, count(*) AS n, avg(y) AS mean FROM long GROUP BY 1, 2),
totals AS (SELECT feature, count(*) AS n_rows, count(DISTINCT category) AS k, avg(y) AS prior
           FROM long GROUP BY 1)
SELECT feature, category, n, round(mean, 6) AS mean, n_rows, k, round(prior, 6) AS prior
FROM stats JOIN totals USING (feature)""",
)
def te_fit_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = fit_stats(returns(spark, folder), ["p_type", "p_brand", "l_partkey"], "y")
    totals = spark.createDataFrame(
        [(f.name, f.n_rows, f.k, stats.priors[0]) for f in stats.features],
        "feature string, n_rows long, k long, prior double",
    )
    parts = [
        stats.table(f.name).select(
            F.lit(f.name).alias("feature"), "category", "n",
            (F.col("sums")[0] / F.col("n")).alias("mean"),
        )
        for f in stats.features
    ]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(long.join(F.broadcast(totals), "feature"), "mean", "prior")


@query("te_bayes_1", _items_sql("p_brand", "s.n / (s.n + 1.0::DOUBLE)"))
def te_bayes_1(spark: SparkSession, folder: str) -> DataFrame:
    df = returns(spark, folder)
    return _encoded_items(fit(df, ["p_brand"], "y", m=1, unknown="ignore"), df, "p_brand")


@query("te_bayes_navg", _items_sql("p_type", "s.n / (s.n + a.n_rows / a.k::DOUBLE)"))
def te_bayes_navg(spark: SparkSession, folder: str) -> DataFrame:
    df = returns(spark, folder)
    return _encoded_items(fit(df, ["p_type"], "y", m="n_avg", unknown="ignore"), df, "p_type")


_EXP = "CASE WHEN s.n <= 1 THEN 0 ELSE 1 / (1 + exp(-(s.n - {k}) / 1.0::DOUBLE)) END"


@query(
    "te_exp_1_1",
    f"""
WITH {PRICES_SQL}, {encoding_sql("prices", "o_custkey", "o_totalprice")}
SELECT o_orderkey, (w * mean + (1 - w) * prior)::FLOAT::DOUBLE AS enc
FROM (SELECT p.o_orderkey, s.mean, a.prior, {_EXP.format(k=1)} AS w
      FROM prices p JOIN stats s ON p.o_custkey = s.category CROSS JOIN stats_all a)""",
)
def te_exp_1_1(spark: SparkSession, folder: str) -> DataFrame:
    df = prices(spark, folder)
    encoding = fit(
        df, ["o_custkey"], "o_totalprice", REGRESSION, "exponential", k=1, f=1.0, unknown="ignore"
    )
    out = encoding.apply(df).select("o_orderkey", _narrow("o_custkey_enc"))
    return out


@query("te_exp_5_1", _items_sql("l_partkey", _EXP.format(k=5)))
def te_exp_5_1(spark: SparkSession, folder: str) -> DataFrame:
    df = returns(spark, folder)
    encoding = fit(df, ["l_partkey"], "y", shrinkage="exponential", k=5, f=1.0, unknown="ignore")
    return _encoded_items(encoding, df, "l_partkey")


@query(
    "te_multiclass",
    f"""
WITH {encoding_sql("orders", "o_custkey", "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END", "f")},
{encoding_sql("orders", "o_custkey", "CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END", "o")},
{encoding_sql("orders", "o_custkey", "CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END", "p")}
SELECT o_orderkey,
       round(w * f.mean + (1 - w) * f_all.prior, 6) AS "enc_F",
       round(w * o.mean + (1 - w) * o_all.prior, 6) AS "enc_O",
       round(w * p.mean + (1 - w) * p_all.prior, 6) AS "enc_P"
FROM (SELECT o_orderkey, o_custkey, f.n / (f.n + a.n_rows / a.k::DOUBLE) AS w
      FROM orders JOIN f ON o_custkey = category CROSS JOIN f_all a) r
JOIN f ON r.o_custkey = f.category JOIN o ON r.o_custkey = o.category
JOIN p ON r.o_custkey = p.category CROSS JOIN f_all CROSS JOIN o_all CROSS JOIN p_all""",
)
def te_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    encoding = fit(df, ["o_custkey"], "o_orderstatus", MULTICLASS, m="n_avg", unknown="ignore")
    out = encoding.apply(df)
    return out.select(
        "o_orderkey",
        *[F.round(f"o_custkey_enc_{c}", 6).alias(f"enc_{c}") for c in encoding.stats.classes],
    )


_COLUMNS = ["o_custkey", "c_mktsegment", "o_orderpriority"]


@query(
    "te_multi_column",
    f"""
WITH {PRICES_SQL}, {", ".join(encoding_sql("prices", c, "o_totalprice", c + "_s") for c in _COLUMNS)}
SELECT o_orderkey, {", ".join(
    f"(({c}_s.n * {c}_s.mean + {c}_s_all.prior) / ({c}_s.n + 1))::FLOAT::DOUBLE AS {c}_enc"
    for c in _COLUMNS)}
FROM prices {" ".join(f"JOIN {c}_s ON prices.{c} = {c}_s.category CROSS JOIN {c}_s_all"
    for c in _COLUMNS)}""",
)
def te_multi_column(spark: SparkSession, folder: str) -> DataFrame:
    df = prices(spark, folder)
    encoding = fit(df, _COLUMNS, "o_totalprice", REGRESSION, m=1, unknown="ignore")
    names = [c + "_enc" for c in _COLUMNS]
    return encoding.apply(df).select("o_orderkey", *[_narrow(c, c) for c in names])


_PENDING = "(SELECT * FROM orders WHERE o_orderstatus = 'P')"


@query(
    "te_unknown_ignore",
    f"""
WITH {encoding_sql(_PENDING, "o_custkey", "o_totalprice")}
SELECT o_orderkey, n IS NULL AS unseen,
       (coalesce((n * mean + prior * n_rows / k::DOUBLE) / (n + n_rows / k::DOUBLE), prior))::FLOAT::DOUBLE
         AS enc
FROM orders LEFT JOIN stats ON o_custkey = category CROSS JOIN stats_all""",
)
def te_unknown_ignore(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    pending = df.where("o_orderstatus = 'P'")
    encoding = fit(pending, ["o_custkey"], "o_totalprice", REGRESSION, m="n_avg", unknown="ignore")
    unseen = encoding.unknown_values(df, "o_custkey").withColumn("unseen", F.lit(True))
    marked = encoding.apply(df).join(
        unseen, F.col("o_custkey").cast("string") == unseen["value"], "left"
    )
    return marked.select(
        "o_orderkey",
        F.coalesce("unseen", F.lit(False)).alias("unseen"),
        _narrow("o_custkey_enc"),
    )


_LISTED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(
    "te_fixed_categories",
    f"""
WITH {encoding_sql("orders", "o_orderpriority", "o_totalprice")}
SELECT o_orderkey,
       (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                  THEN (n * mean + prior * n_rows / k::DOUBLE) / (n + n_rows / k::DOUBLE)
                  ELSE prior END)::FLOAT::DOUBLE AS enc
FROM orders JOIN stats ON o_orderpriority = category CROSS JOIN stats_all""",
)
def te_fixed_categories(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    encoding = fit(
        df, ["o_orderpriority"], "o_totalprice", REGRESSION, m="n_avg", unknown="ignore",
        categories={"o_orderpriority": _LISTED},
    )
    out = encoding.apply(df).select("o_orderkey", _narrow("o_orderpriority_enc"))
    return out


def split_sql(source: str, key: str, fold: int) -> str:
    """Marks of one fold of the repeated split with a third of the rows for testing."""
    return f"""
SELECT *, row_number() OVER (ORDER BY {digest_sql(key, SPLIT_SEED, str(fold))})
            <= ceil(count(*) OVER () / 3.0::DOUBLE - 1e-9) AS is_test FROM {source}"""


@query(
    "te_train_test",
    f"""
WITH marked AS ({split_sql("orders", "o_orderkey", 0)}),
train AS (SELECT * FROM marked WHERE NOT is_test),
{encoding_sql("train", "o_custkey", "o_totalprice")}
SELECT o_orderkey, o_totalprice,
       (coalesce((n * mean + prior * n_rows / k::DOUBLE) / (n + n_rows / k::DOUBLE), prior))::FLOAT::DOUBLE
         AS enc
FROM (SELECT * FROM marked WHERE is_test) LEFT JOIN stats ON o_custkey = category
CROSS JOIN stats_all""",
)
def te_train_test(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    split = shuffle_split(df, "o_orderkey", n_splits=1)
    encoding = fit(
        split.where("not is_test"), ["o_custkey"], "o_totalprice", REGRESSION, m="n_avg",
        unknown="ignore",
    )
    test = encoding.apply(split.where("is_test"))
    return test.select(
        "o_orderkey", "o_totalprice", _narrow("o_custkey_enc")
    )


@query(
    "hcc_bayes",
    f"""
WITH {encoding_sql(_PENDING, "o_custkey", "o_totalprice")},
matched AS (
  SELECT o_orderkey, w * mean + (1 - w) * prior AS enc
  FROM (SELECT o_orderkey, mean, prior, 1 / (1 + exp(-(n - 5) / 1.0::DOUBLE)) AS w
        FROM orders LEFT JOIN stats ON o_custkey = category CROSS JOIN stats_all))
SELECT o_orderkey, (coalesce(enc, (SELECT avg(enc) FROM matched)))::FLOAT::DOUBLE AS enc FROM matched""",
)
def hcc_bayes(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    encoding = fit_empirical_bayes(
        df.where("o_orderstatus = 'P'"), ["o_custkey"], "o_totalprice", REGRESSION, noise=0.0,
        fill="batch_mean",
    )
    out = encoding.apply(df).select("o_orderkey", _narrow("o_custkey_enc"))
    return out


@query(
    "loo_train",
    f"""
WITH {encoding_sql("events", "user_id", "value")}
SELECT event_id,
       (CASE WHEN n > 1 THEN (n * mean - value) / (n - 1) ELSE prior END)::FLOAT AS enc
FROM events JOIN stats ON user_id = category CROSS JOIN stats_all""",
)
def loo_train(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "value")
    encoding = heldout.fit_leave_one_out(df, ["user_id"], "value", REGRESSION)
    return encoding.apply_training(df).select("event_id", _single("user_id_enc"))


@query(
    "loo_apply",
    f"""
WITH {encoding_sql("(SELECT * FROM events WHERE event_type = 'purchase')", "user_id", "value")}
SELECT event_id, coalesce(mean, prior)::FLOAT AS enc
FROM events LEFT JOIN stats ON user_id = category CROSS JOIN stats_all""",
)
def loo_apply(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    encoding = heldout.fit_leave_one_out(
        df.where("event_type = 'purchase'"), ["user_id"], "value", REGRESSION
    )
    return encoding.apply(df).select("event_id", _single("user_id_enc"))


_NOISE_DIGEST = digest_sql("o_orderkey", SPLIT_SEED)
_NOISE_U1 = f"((('0x' || substr({_NOISE_DIGEST}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(
    "noise_encoding",
    f"""
WITH {encoding_sql("orders", "o_orderpriority", "o_totalprice")}
SELECT o_orderkey,
       ((n * mean + prior) / (n + 1) * (1 + 0.01::DOUBLE
             * sqrt(-2 * ln({_NOISE_U1})) * cos({2 * math.pi!r} * {uniform_sql(_NOISE_DIGEST, 1)})))::FLOAT::DOUBLE AS enc
FROM orders JOIN stats ON o_orderpriority = category CROSS JOIN stats_all""",
)
def noise_encoding(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    encoding = fit(df, ["o_orderpriority"], "o_totalprice", REGRESSION, m=1, unknown="ignore")
    noisy = heldout.add_noise(F.col("o_orderpriority_enc"), "o_orderkey", 0.01, SPLIT_SEED)
    return encoding.apply(df).select("o_orderkey", _narrow(noisy))


_FOLD = (
    f"(('0x' || substr({digest_sql('event_id', SPLIT_SEED)}, 1, 8))::BIGINT % 5)::INTEGER"
)


@query(
    "kfold_encoding",
    f"""
WITH folded AS (SELECT event_id, user_id, value, {_FOLD} AS fold FROM events),
others AS (
  SELECT f.event_id, f.fold,
         sum(value) OVER (PARTITION BY user_id) - sum(value) OVER (PARTITION BY user_id, fold) AS s,
         count(*) OVER (PARTITION BY user_id) - count(*) OVER (PARTITION BY user_id, fold) AS n,
         sum(value) OVER () - sum(value) OVER (PARTITION BY fold) AS ps,
         count(*) OVER () - count(*) OVER (PARTITION BY fold) AS pn
  FROM folded f)
SELECT event_id, fold, (CASE WHEN n > 0 THEN s / n ELSE ps / pn END)::FLOAT AS enc FROM others""",
)
def kfold_encoding(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "value")
    out = heldout.out_of_fold(df, "user_id", "value", "event_id", n_folds=5)
    return out.select("event_id", "fold", _single("user_id_enc"))


@query(
    "count_encoding",
    """
SELECT event_id, count(*) OVER (PARTITION BY user_id) AS user_id_count,
       count(*) OVER (PARTITION BY event_type) AS event_type_count
FROM events""",
)
def count_encoding(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    out = fit_counts(df, ["user_id", "event_type"]).apply(df)
    return out.select("event_id", "user_id_count", "event_type_count")


@query(
    "one_hot",
    """
SELECT event_id, (event_type = 'click')::INTEGER AS event_type_click,
       (event_type = 'error')::INTEGER AS event_type_error,
       (event_type = 'purchase')::INTEGER AS event_type_purchase,
       (event_type = 'signup')::INTEGER AS event_type_signup,
       (event_type = 'view')::INTEGER AS event_type_view
FROM events""",
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "event_type")
    return fit_one_hot(df, ["event_type"]).apply(df).drop("event_type")


@query(
    "scale_no_mean",
    f"""
WITH {PRICES_SQL}, s AS (
  SELECT stddev_pop(o_totalprice) AS a, stddev_pop(c_acctbal) AS b FROM prices)
SELECT o_orderkey, round(o_totalprice / a, 6) AS o_totalprice_scaled,
       round(c_acctbal / b, 6) AS c_acctbal_scaled
FROM prices CROSS JOIN s""",
)
def scale_no_mean(spark: SparkSession, folder: str) -> DataFrame:
    df = prices(spark, folder)
    out = fit_scaling(df, ["o_totalprice", "c_acctbal"]).apply(df)
    names = ["o_totalprice_scaled", "c_acctbal_scaled"]
    return rounded(out.select("o_orderkey", *names), *names)


@query(
    "te_null_target",
    """
WITH rated AS (SELECT d.doc_id, d.source, l.quality::DOUBLE AS y FROM documents d LEFT JOIN labels l USING (doc_id)),
stats AS (SELECT source, count(y) AS n, avg(y) AS mean FROM rated WHERE y IS NOT NULL GROUP BY source),
prior AS (SELECT avg(y) AS p FROM rated)
SELECT doc_id, round(coalesce((n * mean + p) / (n + 1), p), 6) AS enc
FROM rated LEFT JOIN stats USING (source) CROSS JOIN prior""",
)
def te_null_target(spark: SparkSession, folder: str) -> DataFrame:
    """Most documents have no label: they are encoded but not learned from."""
    df = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    out = fit(df, ["source"], "quality", m=1, unknown="ignore").apply(df)
    return rounded(out.select("doc_id", F.col("source_enc").alias("enc")), "enc")


@query(
    "te_multiclass_null",
    """
WITH rated AS (
  SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN d.lang END AS y
  FROM documents d LEFT JOIN labels l USING (doc_id)),
known AS (SELECT * FROM rated WHERE y IS NOT NULL),
stats AS (SELECT source, count(*) AS n, avg((y = 'de')::INT) AS de, avg((y = 'en')::INT) AS en FROM known GROUP BY source),
prior AS (SELECT avg((y = 'de')::INT) AS pde, avg((y = 'en')::INT) AS pen FROM known)
SELECT doc_id, round(coalesce((n * de + pde) / (n + 1), pde), 6) AS enc_de,
       round(coalesce((n * en + pen) / (n + 1), pen), 6) AS enc_en
FROM rated LEFT JOIN stats USING (source) CROSS JOIN prior""",
)
def te_multiclass_null(spark: SparkSession, folder: str) -> DataFrame:
    """A class target that most rows lack."""
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("_rated"))
    df = table(spark, folder, "documents").join(labels, "doc_id", "left").withColumn(
        "y", F.when(F.col("_rated"), F.col("lang"))
    )
    out = fit(df, ["source"], "y", MULTICLASS, m=1, unknown="ignore").apply(df)
    return rounded(
        out.select("doc_id", F.col("source_enc_de").alias("enc_de"), F.col("source_enc_en").alias("enc_en")),
        "enc_de", "enc_en",
    )
