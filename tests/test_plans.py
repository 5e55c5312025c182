"""Features, models, experiments, and the shape of physical plans."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenc.operators import profile
from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.encoders.target import fit
from tenc.operators.rank import hash_position
from tenc.operators.splits import shuffle_split
from tenc.plans import experiment as X
from tenc.plans import registry
from tenc.plans.features import fit_features
from tenc.plans.models import train_model
from tenc.sources.runs import read_runs

ROLES = {"city.name": "Special", "kind": "OneHotEncoderDense", "size": "Numerical", "skip": "Delete", "y": "y"}


def make(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.concat(F.lit("c"), F.col("id") % 17).alias("city.name"),
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("kind"),
        ((F.col("id") * 7919) % 101 / 10).alias("size"),
        F.lit(1).alias("skip"),
        ((F.col("id") % 17) * 2.0 + (F.col("id") * 7919) % 101 / 20).alias("y"),
        (F.col("id") % 17 > 8).cast("double").alias("flag"),
        F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), (F.col("id") % 17 / 6 + 1).cast("int")).alias("cls"),
    )


@pytest.fixture(scope="module")
def data(spark):
    return make(spark).cache()


def test_every_name_resolves():
    assert registry.resolve("Special", "TargetEncoder") == "TargetEncoder"
    assert registry.resolve("Numerical", "TargetEncoder") == "Numerical"
    assert registry.resolve(None, "Delete") is None
    with pytest.raises(ValueError):
        registry.resolve("Special", "Nothing")
    with pytest.raises(ValueError):
        registry.register("TargetEncoder", registry.ENCODERS["TargetEncoder"].fit)


@pytest.mark.parametrize("encoder", [*registry.ENCODERS, "OneHotEncoder", "Delete"])
def test_feature_vectors(data, encoder):
    model = fit_features(data, ROLES, encoder, REGRESSION, "y", "k")
    out = model.transform(data, training=True)
    width = {"OneHotEncoder": 17, "Delete": 0}.get(encoder, 1) + 2 + 1
    assert model.size == width and out.count() == 300
    deviations = [
        np.std([r[0][i] for r in out.select(vector_to_array("features")).collect()])
        for i in range(width)
    ]
    assert deviations == pytest.approx([1.0] * width)


def test_leave_one_out_differs_between_training_and_new_rows(data):
    model = fit_features(data, ROLES, "LeaveOneOutEncoder-category_encoders", REGRESSION, "y", "k")
    first = lambda training: model.transform(data, training).orderBy("k").first().features[0]
    assert first(True) != pytest.approx(first(False))


def test_too_wide_one_hot_is_refused(data):
    with pytest.raises(ValueError, match="too many"):
        fit_features(data, ROLES, "OneHotEncoder", REGRESSION, "y", "k", one_hot_limit=5)


def test_ridge_equals_its_closed_form(data):
    model = fit_features(data, ROLES, "TargetEncoder", REGRESSION, "y", "k")
    x = model.transform(data)
    found = train_model(x, "L2RegularizedLinearModel", REGRESSION, "y", "k", penalties=(10.0,))
    rows = x.select(vector_to_array("features"), "y").collect()
    a, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    centred = a - a.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 10.0 * np.eye(a.shape[1]), centred.T @ (y - y.mean()))
    assert list(found.model.weights[0, 0]) == pytest.approx(list(expected), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize(
    ("name", "task", "y", "extra"),
    [
        ("L2RegularizedLinearModel", BINARY, "flag", {"penalties": (1.0, 100.0)}),
        ("L2RegularizedLinearModel", MULTICLASS, "cls", {"penalties": (1.0,)}),
        ("GradientBoosting", BINARY, "flag", {"trees": 3}),
        ("GradientBoosting", MULTICLASS, "cls", {"trees": 3}),
        ("LGBM", BINARY, "flag", {"trees": 2, "grid": {"stepSize": (0.1, 0.5)}}),
        ("XGB", REGRESSION, "y", {"trees": 2, "grid": {"maxDepth": (2, 3)}}),
        ("KNN", REGRESSION, "y", {}),
        ("KNN", BINARY, "flag", {}),
        ("KNN", MULTICLASS, "cls", {}),
    ],
)
def test_models_learn(data, name, task, y, extra):
    from tenc.operators.metrics import score_by_task

    roles = {"city.name": "Special", "size": "Numerical", y: "y"}
    x = fit_features(data, roles, "TargetEncoder", task, y, "k").transform(data).cache()
    fitted = train_model(x, name, task, y, "k", **extra)
    out = fitted.predict(x)
    assert out.count() == 300 and "features" not in out.columns
    score = score_by_task(out, task, y, "prediction").first().score
    assert score > (0.2 if name == "XGB" else 0.6)


def test_unknown_model(data):
    with pytest.raises(ValueError, match="unknown model"):
        train_model(data, "Oracle", REGRESSION, "y", "k")


def test_grid_resumes_skips_and_isolates_failures(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = X.Dataset("good", REGRESSION, ROLES, "k", make)
    bad = X.Dataset("bad", REGRESSION, ROLES, "k", lambda s: s.range(3))
    settings = X.Settings(n_splits=2, one_hot_limit=5)
    encoders = ["TargetEncoder", "OneHotEncoder"]
    status = lambda out: {(r.dataset, r.encoder): r.status for r in out.collect()}
    first = status(X.run_grid(spark, [bad, good], encoders, ["L2RegularizedLinearModel"], path, settings))
    assert first == {
        ("bad", "TargetEncoder"): "failed", ("bad", "OneHotEncoder"): "failed",
        ("good", "TargetEncoder"): "done", ("good", "OneHotEncoder"): "skipped",
    }
    again = status(X.run_grid(spark, [good], ["TargetEncoder"], ["L2RegularizedLinearModel"], path, settings))
    assert again == {("good", "TargetEncoder"): "stored"}
    runs = read_runs(spark, path).collect()
    assert len(runs) == 1 and len(runs[0].results.score) == 2
    assert runs[0].results.n_train_samples == [200.0, 200.0] and runs[0].results.score[0] > 0.8


def test_row_caps():
    assert X.Settings().fit_rows is None and X.Settings().one_hot_limit is None


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows_over_everything(plan):
    """Windows whose input was gathered into one partition."""
    return re.findall(r"Window .*\n.*(?:Sort .*\n.*)?Exchange SinglePartition.*", plan)


def test_no_window_gathers_data(spark, data):
    split = shuffle_split(data.select("k"), "k", 3)
    for df in (split, profile.rank_frequency(data, ["kind"]), profile.category_profile(data, ["kind"])):
        assert not windows_over_everything(physical(df))
    position = physical(hash_position(data.select("k"), "k", n_rows=300))
    gathered = windows_over_everything(position)
    # Only the counts by hash prefix are gathered.
    assert all("_bucket" in g for g in gathered)


def test_marking_a_split_shuffles_nothing(data):
    plan = physical(shuffle_split(data.select("k"), "k", 3))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_small_encodings_are_broadcast_and_scans_pruned(spark, tmp_path, data):
    data.drop("city.name").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = fit(table, ["kind"], "y", REGRESSION, unknown="ignore").apply(table).select("k", "kind_enc")
    plan = physical(out)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert re.search(r"ReadSchema: struct<k:bigint,kind:string>", plan)


def test_encodings_score_a_stream(spark, tmp_path, data):
    table = data.select("k", "kind", "y")
    encoding = fit(table, ["kind"], "y", REGRESSION, unknown="ignore")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    sink = (
        encoding.apply(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    sink.awaitTermination(120)
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, encoding.apply(table).collect()))
