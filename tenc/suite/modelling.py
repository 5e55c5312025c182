"""Queries over feature building, models, folds and grids."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.plans import experiment as X
from tenc.plans.features import fit_features
from tenc.plans.models import train_model
from tenc.plans.registry import ENCODERS
from tenc.session import materialise, scratch_path
from tenc.sources.runs import long_results, read_runs
from tenc.suite.bases import PRICES_SQL, RETURNS_SQL, encoding_sql, prices, returns, rounded, table
from tenc.suite.registry import query

PRICE_ROLES = {
    "o_custkey": "Special",
    "o_orderpriority": "OneHotEncoderDense",
    "c_acctbal": "Numerical",
    "c_mktsegment": "Delete",
    "o_totalprice": "y",
}
RETURN_ROLES = {
    "l_partkey": "Special",
    "p_type": "OneHotEncoderDense",
    "l_quantity": "Numerical",
    "l_discount": "Numerical",
    "y": "y",
}
STATUS_ROLES = {
    "o_custkey": "Special",
    "o_orderpriority": "OneHotEncoderDense",
    "o_totalprice": "Numerical",
    "o_orderstatus": "y",
}
QUALITY_ROLES = {
    "source": "Special",
    "lang": "OneHotEncoderDense",
    "n_chars": "Numerical",
    "quality": "y",
}

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encoder_aliases",
    f"""
WITH {RETURNS_SQL}, {encoding_sql("returns", "p_brand", "y")},
w AS (SELECT *, n / (n + n_rows / k::DOUBLE) AS wb,
             CASE WHEN n <= 1 THEN 0 ELSE 1 / (1 + exp(-(n - 1) / 1.0::DOUBLE)) END AS we
      FROM stats CROSS JOIN stats_all)
SELECT l_orderkey, l_linenumber, l_extendedprice,
       round(wb * mean + (1 - wb) * prior, 6) AS plain,
       round(wb * mean + (1 - wb) * prior, 6) AS shrunk,
       round(we * mean + (1 - we) * prior, 6) AS exponential,
       round(mean, 6) AS left_out
FROM returns JOIN w ON p_brand = category""",
)
def encoder_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Encoders under their registered names."""
    df = returns(spark, folder).select("l_orderkey", "l_linenumber", "l_extendedprice", "p_brand", "y")
    names = {
        "plain": "TargetEncoder",
        "shrunk": "TargetEncoder-dirty_cat",
        "exponential": "TargetEncoder-category_encoders",
        "left_out": "LeaveOneOutEncoder-category_encoders",
    }
    out = df
    for column, name in names.items():
        encoding = ENCODERS[name].fit(df, "p_brand", "y", BINARY, None)
        out = encoding.apply(out, suffix="_new").withColumnRenamed("p_brand_new", column)
    return rounded(out.drop("p_brand", "y"), *names)


_HOT_SQL = ", ".join(
    f"(o_orderpriority = '{p}')::INTEGER::DOUBLE AS h{i}" for i, p in enumerate(_PRIORITIES)
)


@query(
    "column_transformer",
    f"""
WITH {PRICES_SQL}, {encoding_sql("prices", "o_custkey", "o_totalprice")},
x AS (SELECT o_orderkey, (n * mean + prior * n_rows / k::DOUBLE) / (n + n_rows / k::DOUBLE) AS f0,
             {_HOT_SQL}, c_acctbal
      FROM prices JOIN stats ON o_custkey = category CROSS JOIN stats_all),
s AS (SELECT stddev_pop(f0) AS sf, {", ".join(f"stddev_pop(h{i}) AS s{i}" for i in range(5))},
             stddev_pop(c_acctbal) AS sa FROM x)
SELECT o_orderkey, round(f0 / sf, 4) AS f0,
       {", ".join(f"round(h{i} / s{i}, 4) AS f{i + 1}" for i in range(5))},
       round(c_acctbal / sa, 4) AS f6
FROM x CROSS JOIN s""",
)
def column_transformer(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded, one-hot and numeric columns in schema order, scaled, as one vector."""
    df = prices(spark, folder)
    model = fit_features(
        df, PRICE_ROLES, "TargetEncoder-shrinkage=bayes", REGRESSION, "o_totalprice", "o_orderkey"
    )
    vector = vector_to_array("features")
    return model.transform(df).select(
        "o_orderkey", *[F.round(vector[i], 4).alias(f"f{i}") for i in range(model.size)]
    )


@query(
    "column_transformer_delete",
    f"""
WITH {PRICES_SQL}, x AS (SELECT o_orderkey, {_HOT_SQL}, c_acctbal FROM prices),
s AS (SELECT {", ".join(f"stddev_pop(h{i}) AS s{i}" for i in range(5))},
             stddev_pop(c_acctbal) AS sa FROM x)
SELECT o_orderkey, {", ".join(f"round(h{i} / s{i}, 4) AS f{i}" for i in range(5))},
       round(c_acctbal / sa, 4) AS f5
FROM x CROSS JOIN s""",
)
def column_transformer_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline that drops the special column."""
    df = prices(spark, folder)
    model = fit_features(df, PRICE_ROLES, "Delete", REGRESSION, "o_totalprice", "o_orderkey")
    vector = vector_to_array("features")
    return model.transform(df).select(
        "o_orderkey", *[F.round(vector[i], 4).alias(f"f{i}") for i in range(model.size)]
    )


_BAYES = "TargetEncoder-shrinkage=bayes"


def _fitted_features(df: DataFrame, roles, task: str, y: str, key: str) -> DataFrame:
    model = fit_features(df, roles, _BAYES, task, y, key)
    return materialise(model.transform(df).select(key, y, "features"))


@query("model_logistic")
def model_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Class-1 probabilities of the penalised logistic model, penalty chosen by 3 folds."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    df = table(spark, folder, "documents").join(labels, "doc_id")
    x = _fitted_features(df, QUALITY_ROLES, BINARY, "quality", "doc_id")
    model = train_model(x, "L2RegularizedLinearModel", BINARY, "quality", "doc_id")
    return model.predict(x)


@query("model_ridge")
def model_ridge(spark: SparkSession, folder: str) -> DataFrame:
    df = prices(spark, folder)
    x = _fitted_features(df, PRICE_ROLES, REGRESSION, "o_totalprice", "o_orderkey")
    model = train_model(x, "L2RegularizedLinearModel", REGRESSION, "o_totalprice", "o_orderkey")
    return model.predict(x)


@query("model_gbt")
def model_gbt(spark: SparkSession, folder: str) -> DataFrame:
    """One hundred boosted trees for the order price."""
    df = prices(spark, folder)
    x = _fitted_features(df, PRICE_ROLES, REGRESSION, "o_totalprice", "o_orderkey")
    return train_model(x, "GradientBoosting", REGRESSION, "o_totalprice", "o_orderkey").predict(x)


@query("model_gbt_multiclass")
def model_gbt_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    """One hundred rounds of boosted trees on the joint deviance of all classes."""
    df = table(spark, folder, "orders")
    x = _fitted_features(df, STATUS_ROLES, MULTICLASS, "o_orderstatus", "o_orderkey")
    model = train_model(x, "GradientBoosting", MULTICLASS, "o_orderstatus", "o_orderkey")
    return model.predict(x)


@query("model_gbt_grid")
def model_gbt_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf-wise boosting with a searched step size and number of leaves; one hundred trees per candidate."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    df = table(spark, folder, "documents").join(labels, "doc_id")
    x = _fitted_features(df, QUALITY_ROLES, BINARY, "quality", "doc_id")
    model = train_model(x, "LGBM", BINARY, "quality", "doc_id")
    return model.predict(x)


def _price_dataset(folder: str) -> X.Dataset:
    return X.Dataset(
        "orders", REGRESSION, PRICE_ROLES, "o_orderkey", lambda spark: prices(spark, folder)
    )


def _quality_dataset(folder: str) -> X.Dataset:
    def load(spark):
        labels = table(spark, folder, "labels").select("doc_id", "quality")
        return table(spark, folder, "documents").join(labels, "doc_id")

    return X.Dataset("documents", BINARY, QUALITY_ROLES, "doc_id", load)


@query("run_fold")
def run_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Every one of the twenty folds from encoding to scores, with its times."""
    dataset = _price_dataset(folder)
    settings = X.Settings()
    prepared, split = X.prepare_folds(spark, dataset, settings)
    results = X.run_folds(prepared, split, dataset, _BAYES, "L2RegularizedLinearModel", settings)
    names = list(results[0])
    return spark.createDataFrame([tuple(r[c] for c in names) for r in results], [f"`{c}`" for c in names]).toDF(*names)


@query("experiment_grid")
def experiment_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Two encoders with the linear model over twenty folds, for prices and, stratified, for quality labels."""
    path = scratch_path(spark, "grid")
    X.run_grid(
        spark, [_price_dataset(folder), _quality_dataset(folder)], ["Delete", _BAYES], ["L2RegularizedLinearModel"], path,
        X.Settings(),
    ).collect()
    return long_results(read_runs(spark, path))


