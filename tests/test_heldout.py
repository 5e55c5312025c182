"""Leave-one-out, out-of-fold and noisy encodings."""

import pytest
from pyspark.sql import functions as F

from tenc.operators.encoders import heldout as H
from tenc.operators.encoders.plain import fit_counts, fit_one_hot, one_hot_stages
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, "a", 1.0), (4, "b", 0.0), (5, "b", 1.0), (6, "c", 0.0)]
    return spark.createDataFrame(rows, "row_id long, c string, y double").cache()


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(600).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("c"),
        ((F.col("id") * 37) % 101).cast("double").alias("y"),
    ).cache()


def by_row(df, column="c_enc"):
    return {r["row_id"]: r[column] for r in df.select("row_id", column).collect()}


def test_leave_one_out_worked_values(golden):
    encoding = H.fit_leave_one_out(golden, ["c"], "y")
    expected = {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0, 6: 4 / 6}
    assert by_row(encoding.apply_training(golden)) == pytest.approx(expected)
    assert by_row(encoding.apply(golden)) == pytest.approx(
        {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.5, 5: 0.5, 6: 0.0}
    )


def test_leave_one_out_ignores_the_own_target(many):
    changed = many.withColumn("y", F.when(F.col("row_id") == 31, 5000.0).otherwise(F.col("y")))
    before = by_row(H.fit_leave_one_out(many, ["c"], "y", REGRESSION).apply_training(many))
    after = by_row(H.fit_leave_one_out(changed, ["c"], "y", REGRESSION).apply_training(changed))
    assert before[31] == pytest.approx(after[31])
    assert any(before[i] != pytest.approx(after[i]) for i in before if i != 31)


def test_leave_one_out_for_classes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "y")], "row_id int, c string, y string")
    out = H.fit_leave_one_out(df, ["c"], "y", MULTICLASS).apply_training(df).orderBy("row_id").collect()
    assert [(r.c_enc_x, r.c_enc_y) for r in out] == [(0.0, 1.0), (0.5, 0.5), (0.5, 0.5)]


def test_out_of_fold_matches_refitting(many):
    out = H.out_of_fold(many, "c", "y", "row_id", n_folds=4)
    rows = [r.asDict() for r in out.collect()]
    for r in rows:
        others = [o for o in rows if o["fold"] != r["fold"]]
        same = [o["y"] for o in others if o["c"] == r["c"]]
        pool = same or [o["y"] for o in others]
        assert r["c_enc"] == pytest.approx(sum(pool) / len(pool))


def test_both_join_paths_agree(many, monkeypatch):
    from tenc.operators import lookup

    monkeypatch.setattr(lookup, "HOT_SHARE", 10)
    plain = by_row(H.out_of_fold(many, "c", "y", "row_id"))
    assert by_row(H.out_of_fold(many, "c", "y", "row_id", broadcast_bytes=0)) == pytest.approx(plain)
    encoding = H.fit_leave_one_out(many, ["c"], "y", REGRESSION)
    assert by_row(encoding.apply_training(many, broadcast_bytes=0)) == pytest.approx(
        by_row(encoding.apply_training(many))
    )


def test_noise_depends_on_the_row_key_only(many):
    noisy = lambda df: by_row(df.withColumn("c_enc", H.add_noise(F.lit(1.0), "row_id", 0.01, 7)))
    first = noisy(many)
    assert noisy(many.repartition(13, "y")) == first
    mean = sum(first.values()) / len(first)
    spread = (sum((v - mean) ** 2 for v in first.values()) / len(first)) ** 0.5
    assert mean == pytest.approx(1.0, abs=0.002) and spread == pytest.approx(0.01, rel=0.15)
    with pytest.raises(ValueError, match="row key"):
        H.fit_leave_one_out(many, ["c"], "y", REGRESSION, noise=0.01)


def test_counts(spark, many):
    out = fit_counts(many, ["c"]).apply(spark.createDataFrame([("hot",), ("new",)], "c string"))
    assert {r.c: r.c_count for r in out.collect()} == {"hot": 200, "new": 0}


def test_one_hot_forms_agree(spark, many):
    new = spark.createDataFrame([("hot",), ("new",), (None,), ("c1",)], "c string")
    encoding = fit_one_hot(many, ["c"])
    flags = [c for c in encoding.apply(new).columns if c != "c"]
    wide = encoding.apply(new).collect()
    indexer, one_hot = one_hot_stages(["c"])
    model = indexer.fit(many)
    vectors = one_hot.fit(model.transform(many)).transform(model.transform(new)).collect()
    for w, v in zip(wide, vectors):
        assert [float(w[f]) for f in flags] == list(v["c_onehot"].toArray())
    with pytest.raises(ValueError, match="more than 10"):
        fit_one_hot(many, ["c"], limit=10)
