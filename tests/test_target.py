"""Target encoding: worked examples, unknown values, settings, and both join paths."""

import random

import pytest
from pyspark.ml.feature import StringIndexer, TargetEncoder
from pyspark.sql import functions as F

from tenc.operators import lookup as lookup_module
from tenc.operators.encoders.bayes import fit_empirical_bayes
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION, fit_stats
from tenc.operators.encoders.target import Shrinkage, TargetEncoding, fit

PRIOR = 4 / 6


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, "a", 1.0), (4, "b", 0.0), (5, "b", 1.0), (6, "c", 0.0)]
    return spark.createDataFrame(rows, "row_id long, c string, y double").cache()


def encoded(encoding, df, column="c"):
    rows = encoding.apply(df).select(column, column + "_enc").distinct().collect()
    return {r[0]: r[1] for r in rows}


@pytest.mark.parametrize(
    ("settings", "a", "b", "c"),
    [
        ({"m": 1}, 0.916667, 0.555556, 0.333333),
        ({"m": "n_avg"}, 0.866667, 0.583333, 0.444444),
        ({"shrinkage": "exponential", "k": 1, "f": 1.0}, 0.960266, 0.544824, 0.666667),
        ({"shrinkage": "exponential", "k": 5, "f": 1.0}, 0.706401, 0.658762, 0.666667),
        ({"shrinkage": "sigmoid", "k": 5, "f": 1.0}, 0.706401, 0.658762, 0.654676),
    ],
)
def test_worked_values(golden, settings, a, b, c):
    found = encoded(fit(golden, ["c"], "y", unknown="ignore", **settings), golden)
    assert found == pytest.approx({"a": a, "b": b, "c": c}, abs=1e-6)


def test_unseen_and_missing_values_get_the_prior(spark, golden):
    encoding = fit(golden, ["c"], "y", unknown="ignore")
    new = spark.createDataFrame([("z",), (None,)], "c string")
    assert [r.c_enc for r in encoding.apply(new).collect()] == pytest.approx([PRIOR, PRIOR])


def test_unseen_values_raise_on_request(spark, golden):
    encoding = fit(golden, ["c"], "y", unknown="error")
    assert encoding.apply(golden).count() == golden.count()
    unseen = spark.createDataFrame([("z",), ("y",), ("a",)], "c string")
    with pytest.raises(ValueError, match=r"\['y', 'z'\]"):
        encoding.require_known(unseen)
    with pytest.raises(Exception, match="unknown category in column 'c'"):
        encoding.apply(unseen).collect()
    encoding.apply(spark.createDataFrame([("a",), (None,)], "c string")).collect()


def test_settings_are_checked(golden):
    with pytest.raises(ValueError):
        fit(golden, ["c"], "y", unknown="drop")
    with pytest.raises(ValueError, match="sorted"):
        fit(golden, ["c"], "y", categories={"c": ["b", "a"]})
    with pytest.raises(ValueError):
        Shrinkage("bayes", m="n_max")
    with pytest.raises(ValueError):
        fit(golden, ["c"], "y", task="ranking")
    assert Shrinkage("bayes", m=2.5).m == 2.5


def test_listed_categories(golden):
    with pytest.raises(ValueError, match=r"\['c'\]"):
        fit(golden, ["c"], "y", categories={"c": ["a", "b"]})
    encoding = fit(golden, ["c"], "y", m="n_avg", unknown="ignore", categories={"c": ["a", "b", "q"]})
    found = encoded(encoding, golden)
    # Unlisted training values count as unseen; k still counts the observed ones.
    assert found["c"] == pytest.approx(PRIOR)
    assert found["a"] == pytest.approx(0.866667, abs=1e-6)


def test_multiclass_has_one_column_per_class(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("c", "z"), ("a", "x")]
    df = spark.createDataFrame(rows, "c string, label string")
    encoding = fit(df, ["c"], "label", MULTICLASS, m=1, unknown="ignore")
    assert encoding.stats.classes == ("x", "y", "z")
    row = encoding.apply(df.where("c = 'a'")).first()
    n, weight = 3, 3 / 4
    expected = [weight * k / n + (1 - weight) * p for k, p in ((2, 2 / 6), (1, 3 / 6), (0, 1 / 6))]
    assert [row.c_enc_x, row.c_enc_y, row.c_enc_z] == pytest.approx(expected)
    assert sum(expected) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one category; many categories are rare."""
    draw = random.Random(3)
    rows = []
    for i in range(9000):
        c = "hot" if i % 3 == 0 else f"c{draw.randrange(1500)}"
        rows.append((i, None if i % 500 == 0 else c, float(draw.random() < 0.3)))
    return spark.createDataFrame(rows, "row_id long, c string, y double").cache()


@pytest.mark.parametrize("task", [REGRESSION, MULTICLASS])
def test_shuffle_path_equals_broadcast_path(skewed, task, monkeypatch):
    monkeypatch.setattr(lookup_module, "HOT_SHARE", 20)
    encoding = fit(skewed, ["c"], "y", task, m="n_avg", unknown="ignore")
    small = encoding.apply(skewed).orderBy("row_id").collect()
    large = encoding.apply(skewed, broadcast_bytes=0)
    plan = large._jdf.queryExecution().toString()
    assert "_salt" in plan
    assert large.orderBy("row_id").collect() == small


def test_statistics_add_up(skewed):
    stats = fit_stats(skewed, ["c"], "y")
    total = stats.table("c").agg(F.sum("n"), F.sum(F.col("sums")[0])).first()
    missing = skewed.where("c is null").agg(F.count("*"), F.sum("y")).first()
    assert total[0] + missing[0] == 9000
    assert (total[1] + missing[1]) / 9000 == pytest.approx(stats.priors[0])


def test_encoding_lies_between_mean_and_prior(skewed):
    encoding = fit(skewed, ["c"], "y", m="n_avg", unknown="ignore")
    prior = encoding.stats.priors[0]
    for r in encoding.summary().collect():
        low, high = sorted((r["mean"], prior))
        assert low - 1e-12 <= r["enc"] <= high + 1e-12


def test_weight_grows_with_rows(skewed, spark):
    rule = fit(skewed, ["c"], "y", m="n_avg", unknown="ignore")
    meta = rule.stats.feature("c")
    n = spark.range(1, 200).select(rule.shrinkage.weight(F.col("id"), meta).alias("w"))
    weights = [r.w for r in n.orderBy("w").collect()]
    assert weights == sorted(weights) and 0 < weights[0] < weights[-1] < 1


@pytest.mark.parametrize("m", [1.0, "n_avg"])
def test_agrees_with_the_built_in_encoder(skewed, m):
    df = skewed.dropna()
    encoding = fit(df, ["c"], "y", m=m, unknown="ignore")
    meta = encoding.stats.feature("c")
    smoothing = meta.n_rows / meta.k if m == "n_avg" else m
    indexed = StringIndexer(inputCol="c", outputCol="i").fit(df).transform(encoding.apply(df))
    built_in = TargetEncoder(
        inputCols=["i"], outputCols=["t"], labelCol="y", targetType="binary", smoothing=smoothing
    ).fit(indexed)
    worst = built_in.transform(indexed).agg(F.max(F.abs(F.col("t") - F.col("c_enc")))).first()[0]
    assert worst < 1e-9


def test_saved_encodings_come_back(spark, golden, tmp_path):
    encoding = fit(golden, ["c"], "y", m="n_avg", unknown="ignore", categories={"c": ["a", "b", "c"]})
    encoding.save(str(tmp_path / "enc"))
    again = TargetEncoding.load(spark, str(tmp_path / "enc"))
    assert encoded(again, golden) == encoded(encoding, golden)
    assert again.shrinkage == encoding.shrinkage and again.stats.priors == encoding.stats.priors


def test_several_columns_in_order(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.0), ("a", 2, 3.0)], "c string, d int, y double")
    encoding = fit(df, ["d", "c"], "y", REGRESSION, unknown="ignore")
    assert encoding.apply(df).columns == ["c", "d", "y", "d_enc", "c_enc"]
    assert encoding.stats.feature("d").k == 2


def test_empirical_bayes(spark, golden):
    with pytest.raises(ValueError, match="single column"):
        fit_empirical_bayes(golden, ["c", "row_id"], "y")
    encoding = fit_empirical_bayes(golden, ["c"], "y", noise=0.0, fill="batch_mean")
    batch = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    found = {r.c: r.c_enc for r in encoding.apply(batch).collect()}
    assert found["a"] == pytest.approx(0.706401, abs=1e-6)
    assert found["z"] == pytest.approx((found["a"] + found["b"]) / 2)
