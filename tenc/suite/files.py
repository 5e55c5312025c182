"""Queries that write a table as raw files and read it back, and queries over run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.operators.prepare import missing_fractions
from tenc.operators.relate import pending
from tenc.plans import reports
from tenc.session import scratch_path
from tenc.sources import runs as R
from tenc.sources.cache import cache_or_build
from tenc.sources.catalog import roles_table
from tenc.sources.delimited import names_from_dictionary, read_delimited
from tenc.suite.bases import rounded, table
from tenc.suite.registry import query


def _write(df: DataFrame, name: str, header: bool = True, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("header", header).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    )
    writer.options(**options).csv(path)
    return path


def _cast(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(
        *[quoted(c).try_cast(t).alias(c) for c, t in like.dtypes]
    )


@query(
    "src_csv_header",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def src_csv_header(spark: SparkSession, folder: str) -> DataFrame:
    """A header line and compressed files."""
    orders = table(spark, folder, "orders").drop("o_orderdate")
    return _cast(read_delimited(spark, _write(orders, "header", compression="gzip")), orders)


@query(
    "src_csv_sep",
    """
SELECT 'tab' AS sep, c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT 'semicolon', c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT 'pipe', c_custkey, c_name, c_acctbal FROM customer""",
)
def src_csv_sep(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = None
    for name, sep in (("tab", "\t"), ("semicolon", ";"), ("pipe", "|")):
        back = read_delimited(spark, _write(customers, name, sep=sep), sep=sep)
        part = _cast(back, customers).withColumn("sep", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_csv_latin1", "SELECT c_custkey, c_name || ' café é' AS c_name FROM customer")
def src_csv_latin1(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(" café é")).alias("c_name")
    )
    path = _write(customers, "latin1", encoding="ISO-8859-1")
    return _cast(read_delimited(spark, path, encoding="ISO-8859-1"), customers)


@query("src_csv_named", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def src_csv_named(spark: SparkSession, folder: str) -> DataFrame:
    """A file without header; its column names come from a data dictionary file."""
    parts = table(spark, folder, "part")
    dictionary = spark.createDataFrame([(c,) for c in parts.columns], "`Column Name` string")
    names_path = _write(dictionary.coalesce(1), "dictionary")
    names = names_from_dictionary(read_delimited(spark, names_path))
    path = _write(parts, "headerless", header=False, sep="|")
    return _cast(read_delimited(spark, path, sep="|", names=names), parts)


@query("src_csv_preamble", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_csv_preamble(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each start with three lines of remarks before the header."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").alias("part")
    )
    lines = customers.select(
        "part", F.lit(1).alias("line"),
        F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
        .alias("value"),
    )
    top = ["Staff report", "prepared for tests", "amounts, in dollars", "c_custkey,c_name,c_acctbal"]
    heads = customers.select("part").distinct().select(
        "part", F.posexplode(F.array(*[F.lit(t) for t in top])).alias("line", "value")
    ).withColumn("line", F.col("line") - 10)
    path = scratch_path(spark, "preamble")
    (
        heads.unionByName(lines)
        .repartition("part")
        .sortWithinPartitions("part", "line")
        .select("part", "value")
        .write.partitionBy("part")
        .text(path)
    )
    back = read_delimited(spark, path, preamble=3)
    return _cast(back, customers.drop("part"))


@query(
    "src_csv_multiline",
    "SELECT conv_id, turn, role, text AS reply_text FROM conversations",
)
def src_csv_multiline(spark: SparkSession, folder: str) -> DataFrame:
    """Line breaks inside quoted values and inside a column name."""
    turns = table(spark, folder, "conversations").withColumnRenamed("text", "Reply\nText")
    path = _write(turns, "multiline", quoteAll=True)
    back = _cast(read_delimited(spark, path, multiline=True, markers=None), turns)
    return back.withColumnRenamed("Reply\nText", "reply_text")


@query(
    "src_csv_multiline_split",
    "SELECT conv_id, turn, role, text AS reply_text FROM conversations",
)
def src_csv_multiline_split(spark: SparkSession, folder: str) -> DataFrame:
    """Line breaks inside quoted values, in files that are read by many tasks."""
    turns = table(spark, folder, "conversations").withColumnRenamed("text", "Reply\nText")
    path = _write(turns, "multiline_split", quoteAll=True)
    back = _cast(read_delimited(spark, path, multiline="split", markers=None), turns)
    return back.withColumnRenamed("Reply\nText", "reply_text")


@query("src_key_column", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_key_column(spark: SparkSession, folder: str) -> DataFrame:
    """The index column of a file stays an ordinary key column."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return _cast(read_delimited(spark, _write(suppliers, "keyed")), suppliers)


@query(
    "cache_or_build",
    "SELECT l_partkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
def cache_or_build_query(spark: SparkSession, folder: str) -> DataFrame:
    """The second call finds the table the first one wrote."""
    items = table(spark, folder, "lineitem")
    path = scratch_path(spark, "cached")

    def build() -> DataFrame:
        return items.groupBy("l_partkey").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
        )

    cache_or_build(spark, path, build)
    return cache_or_build(spark, path, lambda: build().limit(0))


_CATALOGUE = {
    "orders": {
        "clf_type": "regression",
        "col_action": {"o_orderkey": "Delete", "o_orderpriority": "Special", "o_totalprice": "y"},
    },
    "labelled": {
        "clf_type": "binary-clf",
        "col_action": {"lang": "OneHotEncoderDense", "source": "Special", "quality": "y"},
    },
}
_CATALOGUE_ROWS = ", ".join(
    f"('{d}', '{entry['clf_type']}', {i}, '{c}', '{r}')"
    for d, entry in _CATALOGUE.items()
    for i, (c, r) in enumerate(entry["col_action"].items())
)


@query(
    "role_catalog",
    f"""
WITH roles(dataset, task, position, "column", role) AS (VALUES {_CATALOGUE_ROWS}),
t AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
f(dataset, "column", fraction) AS (
  SELECT 'orders', 'o_orderkey', avg((o_orderkey IS NULL)::INTEGER) FROM orders
  UNION ALL SELECT 'orders', 'o_orderpriority', avg((o_orderpriority IS NULL)::INTEGER) FROM orders
  UNION ALL SELECT 'orders', 'o_totalprice', avg((o_totalprice IS NULL)::INTEGER) FROM orders
  UNION ALL SELECT 'labelled', 'lang', avg((lang IS NULL)::INTEGER) FROM t
  UNION ALL SELECT 'labelled', 'source', avg((source IS NULL)::INTEGER) FROM t
  UNION ALL SELECT 'labelled', 'quality', avg((quality IS NULL)::INTEGER) FROM t)
SELECT dataset, task, position, "column", role, round(fraction, 6) AS missing
FROM roles JOIN f USING (dataset, "column")""",
)
def role_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A role catalogue read from JSON, with the share of missing values of each column."""
    path = scratch_path(spark, "roles")
    text = spark.createDataFrame([(json.dumps(_CATALOGUE),)], "value string")
    text.coalesce(1).write.text(path)
    roles = roles_table(spark, path)
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    tables = {
        "orders": table(spark, folder, "orders"),
        "labelled": documents.join(labels, "doc_id", "left"),
    }
    shares = None
    for name, df in tables.items():
        part = missing_fractions(df, list(_CATALOGUE[name]["col_action"])).select(
            F.lit(name).alias("dataset"), "column", F.round("fraction", 6).alias("missing")
        )
        shares = part if shares is None else shares.unionByName(part)
    return roles.join(shares, ["dataset", "column"])


# Run records derived from the orders: one run per market segment, order priority and status,
# its folds are the order years.
_SCORES_SQL = """
scored AS (
  SELECT c_mktsegment AS dataset, o_orderpriority AS encoder, o_orderstatus AS clf,
         (year(o_orderdate) - 1990)::DOUBLE AS fold, count(*)::DOUBLE AS n_train_samples,
         round(avg(o_totalprice) / 1000000, 6) AS score,
         round(max(o_totalprice) / 1000000, 6) AS train_score
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy(
        F.col("c_mktsegment").alias("dataset"),
        F.col("o_orderpriority").alias("encoder"),
        F.col("o_orderstatus").alias("clf"),
        (F.year("o_orderdate") - 1990).cast("double").alias("fold"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n_train_samples"),
        F.round(F.avg("o_totalprice") / 1000000, 6).alias("score"),
        F.round(F.max("o_totalprice") / 1000000, 6).alias("train_score"),
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The scores as nested run records; a run has as many folds as there are years."""
    scores = _scores(spark, folder).withColumns(
        {"n_train_features": F.lit(1.0), "encoding_time": F.lit(0.5), "training_time": F.lit(2.0)}
    )
    per_run = scores.groupBy("dataset", "encoder", "clf").agg(
        F.sort_array(F.collect_list(F.struct(*R.RESULT_FIELDS))).alias("r")
    )
    no_params = F.create_map().cast("map<string,string>")
    return per_run.select(
        "dataset",
        F.size("r").alias("n_splits"),
        F.lit(1 / 3).alias("test_size"),
        F.lit(-1).cast("long").alias("n_rows"),
        "encoder",
        F.lit(True).alias("str_preprocess"),
        F.struct(
            F.col("clf").alias("label"), F.col("clf").alias("name"), no_params.alias("params")
        ).alias("clf"),
        F.array(F.lit("ShuffleSplit")).alias("ShuffleSplit"),
        F.struct(F.lit("StandardScaler").alias("name"), no_params.alias("params")).alias("scaler"),
        F.lit(5).alias("sample_seed"),
        F.lit(32).alias("shuffleseed"),
        F.create_map(F.lit("o_totalprice"), F.lit("y")).alias("col_action"),
        F.lit("regression").alias("clf_type"),
        F.struct(*[F.col(f"r.{f}").alias(f) for f in R.RESULT_FIELDS]).alias("results"),
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    R.write_runs(_records(spark, folder), path)
    return R.read_runs(spark, path)


@query(
    "results_long",
    f"""
WITH {_SCORES_SQL}
SELECT dataset, encoder, clf, 'r2 score' AS score_type,
       (count(*) OVER (PARTITION BY dataset, encoder, clf))::INTEGER AS n_splits,
       fold, n_train_samples, 1.0::DOUBLE AS n_train_features, score, train_score,
       0.5::DOUBLE AS encoding_time, 2.0::DOUBLE AS training_time
FROM scored""",
)
def results_long(spark: SparkSession, folder: str) -> DataFrame:
    return R.long_results(_stored(spark, folder)).drop("results_file")


@query(
    "results_sink_roundtrip",
    f"""
WITH {_SCORES_SQL}
SELECT dataset, count(*)::INTEGER AS n_splits, round(1 / 3.0::DOUBLE, 6) AS test_size, -1::BIGINT AS n_rows, encoder,
       true AS str_preprocess, clf AS clf_label, clf AS clf_name, 'ShuffleSplit' AS split,
       'StandardScaler' AS scaler, 5 AS sample_seed, 32 AS shuffleseed, 'o_totalprice=y' AS roles,
       'regression' AS clf_type, count(*)::INTEGER AS n_folds, sum(fold) AS folds,
       sum(n_train_samples) AS n_train_samples, count(*)::DOUBLE AS n_train_features,
       round(sum(score), 6) AS score, max(train_score) AS train_score,
       0.5::DOUBLE * count(*) AS encoding_time, 2.0::DOUBLE * count(*) AS training_time, true AS from_json
FROM scored GROUP BY dataset, encoder, clf""",
)
def results_sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of the nested records as they come back from the sink; folds are added up."""

    def total(name):
        return F.aggregate(f"results.{name}", F.lit(0.0), lambda acc, x: acc + x).alias(name)

    roles = F.transform(F.map_entries("col_action"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _stored(spark, folder).select(
        "dataset", "n_splits", F.round("test_size", 6).alias("test_size"), "n_rows", "encoder", "str_preprocess",
        F.col("clf.label").alias("clf_label"), F.col("clf.name").alias("clf_name"),
        F.array_join("ShuffleSplit", ",").alias("split"), F.col("scaler.name").alias("scaler"),
        "sample_seed", "shuffleseed", F.array_join(roles, ",").alias("roles"), "clf_type",
        F.size("results.fold").alias("n_folds"), total("fold").alias("folds"), total("n_train_samples"),
        total("n_train_features"), F.round(total("score"), 6).alias("score"),
        F.array_max("results.train_score").alias("train_score"), total("encoding_time"), total("training_time"),
        F.col("results_file").endswith(".json").alias("from_json"),
    )


@query(
    "pending_runs",
    f"""
WITH {_SCORES_SQL}, r AS (SELECT DISTINCT dataset, encoder, clf FROM scored)
SELECT dataset, encoder, clf FROM r WHERE NOT (encoder = '1-URGENT' OR clf = 'P')""",
)
def pending_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The grid without the runs that were stored with the same parameters."""
    grid = R.parameter_key(_records(spark, folder))
    path = scratch_path(spark, "finished")
    R.write_runs(
        _records(spark, folder).where("encoder = '1-URGENT' or clf.label = 'P'"), path
    )
    finished = R.parameter_key(R.read_runs(spark, path))
    left = pending(grid, finished, ["run_key"])
    return left.select("dataset", "encoder", F.col("clf.label").alias("clf"))


@query(
    "results_group_size",
    f"WITH {_SCORES_SQL} SELECT dataset, encoder, clf, count(*) AS n FROM scored GROUP BY 1, 2, 3",
)
def results_group_size(spark: SparkSession, folder: str) -> DataFrame:
    return reports.group_sizes(_scores(spark, folder))


@query(
    "results_box",
    f"""
WITH {_SCORES_SQL},
q AS (SELECT dataset, encoder, clf, quantile_cont(score, 0.25) AS q1,
             quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3
      FROM scored GROUP BY 1, 2, 3),
m AS (SELECT *, score >= q1 - 1.5::DOUBLE * (q3 - q1) AND score <= q3 + 1.5::DOUBLE * (q3 - q1)
        AS inside FROM scored JOIN q USING (dataset, encoder, clf))
SELECT dataset, encoder, clf, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
       min(score) FILTER (inside) AS whisker_low, max(score) FILTER (inside) AS whisker_high,
       (count(*) FILTER (NOT inside))::BIGINT AS n_outliers
FROM m GROUP BY dataset, encoder, clf, q1, median, q3""",
)
def results_box(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        reports.box_summary(_scores(spark, folder)), "q1", "median", "q3", digits=9
    )


_THRESHOLDS_SQL = f"""
{_SCORES_SQL},
curve AS (SELECT *, (fold % 11) / 10 AS threshold FROM scored)"""


def _thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).withColumn("threshold", (F.col("fold") % 11) / 10)


@query(
    "score_curve",
    f"""
WITH {_THRESHOLDS_SQL}
SELECT encoder, threshold, round(avg(score), 12) AS mean,
       round(avg(score) - 1.959963984540054::DOUBLE * stddev_samp(score) / sqrt(count(*)), 12) AS low,
       round(avg(score) + 1.959963984540054::DOUBLE * stddev_samp(score) / sqrt(count(*)), 12) AS high,
       count(*) AS n
FROM curve GROUP BY 1, 2""",
)
def score_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = reports.score_curve(_thresholds(spark, folder), "encoder")
    return rounded(curve, "mean", "low", "high", digits=12)


_INTERVAL_KEYS = ["dataset", "encoder", "clf", "fold"]
_INTERVAL_DIGEST = " || '|' || ".join(
    f"length({c}::VARCHAR) || ':' || {c}::VARCHAR" for c in _INTERVAL_KEYS
) + " || '|32|' || (b // 4)::VARCHAR"


@query(
    "score_interval",
    f"""
WITH {_THRESHOLDS_SQL},
drawn AS (
  SELECT encoder, threshold, score, b, ('0x' || substr(md5({_INTERVAL_DIGEST}), 1 + 8 * (b % 4)::INTEGER, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(1000)) AS b FROM curve)),
counted AS (SELECT *, {" + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in reports.POISSON_CUTS)} AS times FROM drawn),
means AS (
  SELECT encoder, threshold, b, sum(times * score) / nullif(sum(times), 0)::DOUBLE AS mean FROM counted GROUP BY ALL),
bounds AS (
  SELECT encoder, threshold, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY ALL),
plain AS (SELECT encoder, threshold, avg(score) AS mean, count(*) AS n FROM curve GROUP BY ALL)
SELECT encoder, threshold, round(mean + 3e-9::DOUBLE, 7) AS mean, round(low + 3e-9::DOUBLE, 7) AS low, round(high + 3e-9::DOUBLE, 7) AS high, n
FROM plain JOIN bounds USING (encoder, threshold)""",
)
def score_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The curve of scores with bootstrap intervals of one thousand replicates."""
    found = reports.score_interval(_thresholds(spark, folder), "encoder", _INTERVAL_KEYS)
    # Scores are short decimals, so a mean can lie just between two rounded values; a little more decides.
    moved = found.withColumns({c: F.col(c) + 3e-9 for c in ("mean", "low", "high")})
    return rounded(moved, "mean", "low", "high", digits=7)


@query(
    "score_range",
    f"""
WITH {_SCORES_SQL}
SELECT min(score) AS lowest, max(score) AS highest, round(avg(score), 12) AS mean
FROM scored WHERE clf = 'F'""",
)
def score_range(spark: SparkSession, folder: str) -> DataFrame:
    finished = _scores(spark, folder).where("clf = 'F'")
    return rounded(reports.score_range(finished), "mean", digits=12)


@query(
    "filter_runs",
    f"""
WITH {_SCORES_SQL}
SELECT * FROM scored WHERE (contains(clf, 'F') OR contains(clf, 'O'))
AND encoder IN ('1-URGENT', '2-HIGH') AND dataset = 'MACHINERY'""",
)
def filter_runs(spark: SparkSession, folder: str) -> DataFrame:
    conditions = {
        "clf": ["F", "O"], "encoder": ["1-URGENT", "2-HIGH"], "dataset": "MACHINERY",
    }
    return reports.filter_runs(_scores(spark, folder), conditions)


@query(
    "baseline_delta",
    f"""
WITH {_SCORES_SQL}
SELECT s.dataset, s.encoder, s.clf, s.fold, s.score, b.score AS score_baseline,
       round(s.score - b.score, 6) AS score_delta
FROM scored s LEFT JOIN (SELECT * FROM scored WHERE encoder = '5-LOW') b
  ON s.dataset = b.dataset AND s.clf = b.clf AND s.fold = b.fold""",
)
def baseline_delta(spark: SparkSession, folder: str) -> DataFrame:
    scores = _scores(spark, folder).select("dataset", "encoder", "clf", "fold", "score")
    delta = reports.baseline_delta(
        scores, ["dataset", "clf", "fold"], F.col("encoder") == "5-LOW"
    )
    return rounded(delta, "score_delta")


@query(
    "threshold_percentile",
    f"""
WITH {_THRESHOLDS_SQL}
SELECT dataset, encoder, clf, fold,
       CASE (threshold * 10)::INTEGER WHEN 10 THEN 100.0::DOUBLE
            ELSE 7.5::DOUBLE * (threshold * 10)::INTEGER END AS threshold
FROM curve""",
)
def threshold_percentile(spark: SparkSession, folder: str) -> DataFrame:
    listed = {i: 7.5 * i for i in range(10)}
    tenths = _thresholds(spark, folder).withColumn("threshold", F.round("threshold", 1))
    out = reports.threshold_percentile(tenths, listed)
    return out.select("dataset", "encoder", "clf", "fold", "threshold")


@query(
    "parse_run_name",
    f"""
WITH {_SCORES_SQL}, r AS (SELECT DISTINCT dataset, encoder, clf FROM scored)
SELECT dataset, encoder, clf FROM r""",
)
def parse_run_name(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes back out of ``dataset-..._encoder-..._clf-...`` (encoders hold dashes)."""
    runs = _scores(spark, folder).select("dataset", "encoder", "clf").distinct()
    name = F.concat(
        F.lit("/results/dataset-"), "dataset", F.lit("_encoder-"), "encoder", F.lit("_clf-"), "clf"
    )
    parsed = runs.select(reports.run_attributes(name).alias("a"))
    return parsed.select(*[F.col("a")[c].alias(c) for c in ("dataset", "encoder", "clf")])

