"""Linear models of all folds together, against numpy and against one fold at a time."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenc.operators.encoders.heldout import fold_of
from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.splits import marked_split, plan_shuffle_split, plan_stratified_split
from tenc.plans import experiment as X
from tenc.plans import foldcube, linear, models, registry
from tenc.plans.features import fit_features

ROLES = {"city": "Special", "kind": "OneHotEncoderDense", "size": "Numerical", "y": "y"}
FOLDS = 4


def make(spark, n=600):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)))).alias("city"),
        F.when(F.col("id") == 5, "once").when(F.col("id") % 4 == 0, "a").otherwise("b").alias("kind"),
        (F.col("id") * 7919 % 101 / 10 + 500).alias("size"),
        (F.col("id") % 17 * 2.0 + noise + F.when(F.col("id") % 3 == 0, 7).otherwise(0)).alias("price"),
        (noise + F.col("id") % 17 > 14).cast("double").alias("flag"),
        F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), ((F.col("id") % 17 + noise) / 9.5 + 1).cast("int")).alias("cls"),
    )


@pytest.fixture(scope="module")
def data(spark):
    return make(spark).persist()


def table(data, y):
    return data.withColumn("y", F.col(y)).select("k", "city", "kind", "size", "y")


def cube_of(data, y, task, encoder="TargetEncoder"):
    df = table(data, y)
    plan = plan_shuffle_split(df, "k", FOLDS) if task == REGRESSION else plan_stratified_split(df, "k", "y", FOLDS)
    return df, plan, foldcube.build(df, plan, ROLES, encoder, task, "y", "k")


@pytest.mark.parametrize("encoder", registry.ENCODERS)
@pytest.mark.parametrize("y,task", [("price", REGRESSION), ("flag", BINARY), ("cls", MULTICLASS)])
def test_cube_equals_encoders_fitted_fold_by_fold(data, encoder, y, task):
    df, plan, found = cube_of(data, y, task, encoder)
    rows = {r["key"]: r for r in found.rows.collect()}
    size = found.outputs[0]
    for fold in (0, FOLDS - 1):
        train, test = df.where(~plan.is_test(fold)), df.where(plan.is_test(fold))
        fitted = registry.ENCODERS[encoder].fit(train, "city", "y", task, "k")
        own = getattr(fitted, "apply_training", fitted.apply)
        for part, apply in ((train, own), (test, fitted.apply)):
            out = apply(part, suffix="_enc")
            names = [c for c in out.columns if c.startswith("city_enc")]
            assert len(names) == size
            for r in out.collect():
                assert rows[r["k"]]["e0"][fold * size : (fold + 1) * size] == pytest.approx([r[c] for c in names], rel=1e-9, abs=1e-12)
                assert rows[r["k"]]["test"][fold] == (part is test)


def test_scans_do_not_depend_on_the_number_of_folds(spark, data):
    """One aggregate and one join hold all folds; jobs and exchanges are those of a single fold."""
    df = table(data, "price")
    jobs = []
    for n in (1, 12):
        plan = plan_shuffle_split(df, "k", n)
        context = spark.sparkContext
        before = context.statusTracker().getJobIdsForGroup(f"folds-{n}")
        context.setJobGroup(f"folds-{n}", "")
        found = foldcube.build(df, plan, ROLES, "TargetEncoder", REGRESSION, "y", "k")
        linear.fit_ridge(found)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"folds-{n}")) - len(before))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] and jobs[0] > 0


def matrices(found, fold):
    rows = found.rows.orderBy("key").collect()
    size = sum(found.outputs)
    x = np.array([[*r["shared"], *[v for i, k in enumerate(found.outputs) for v in r[f"e{i}"][fold * k : (fold + 1) * k]]] for r in rows])
    assert x.shape[1] == found.n_shared + size
    return x, np.array([r["label"] for r in rows]), np.array([r["part"] for r in rows]), np.array([r["test"][fold] for r in rows])


def closed_form(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    a = x - xm
    w = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ (y - ym))
    return w, ym - xm @ w


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_equals_closed_form_in_every_fold(data):
    _, _, found = cube_of(data, "price", REGRESSION)
    alphas = (0.1, 10.0, 1000.0)
    fit = linear.fit_ridge(found, alphas)
    train_scores, test_scores = linear.fold_scores(found, fit)
    for fold in range(FOLDS):
        x, y, part, test = matrices(found, fold)
        deviation = x[~test].std(axis=0)
        x = x / np.where(deviation > 1e-12, deviation, 1)
        means = []
        for alpha in alphas:
            held = []
            for j in range(3):
                w, b = closed_form(x[~test & (part != j)], y[~test & (part != j)], alpha)
                held.append(r2(y[~test & (part == j)], x[~test & (part == j)] @ w + b))
            means.append(np.mean(held))
        assert fit.penalties[fold, 0] == alphas[int(np.argmax(means))]
        w, b = closed_form(x[~test], y[~test], fit.penalties[fold, 0])
        assert train_scores[fold] == pytest.approx(r2(y[~test], x[~test] @ w + b), abs=1e-9)
        assert test_scores[fold] == pytest.approx(r2(y[test], x[test] @ w + b), abs=1e-9)
        assert fit.n_train[fold] == (~test).sum()
        hot = x[~test][:, : found.n_shared][:, np.array(found.flags)]
        assert fit.n_features[fold] == x.shape[1] - (hot.sum(axis=0) == 0).sum()


@pytest.mark.parametrize("y,task", [("flag", BINARY), ("cls", MULTICLASS)])
def test_logistic_optimum_choice_and_scores(data, y, task):
    _, _, found = cube_of(data, y, task)
    cs = (1e-3, 1.0, 1e3)
    fit = linear.fit_logistic(found, cs, balanced=task == BINARY)
    assert fit.scans < 20
    train_scores, test_scores = linear.fold_scores(found, fit)
    outputs = range(len(found.classes)) if found.classes else (1,)
    for fold in (0, FOLDS - 1):
        x, label, part, test = matrices(found, fold)
        deviation = x[~test].std(axis=0)
        deviation = np.where(deviation > 1e-12, deviation, 1)
        margins = x @ fit.weights[fold].T + fit.intercepts[fold]
        for o, c in enumerate(outputs):
            t = (label == c).astype(float)
            own = ~test
            share = np.ones(len(t))
            if task == BINARY:
                share = np.where(t > 0, own.sum() / (2 * t[own].sum()), own.sum() / (2 * (1 - t[own]).sum()))
            p = 1 / (1 + np.exp(-margins[:, o]))
            slope = ((share * (p - t))[own, None] * x[own] / deviation).sum(axis=0) + fit.weights[fold, o] * deviation / fit.penalties[fold, o]
            assert np.abs(slope).max() / own.sum() < 1e-6
            assert abs((share * (p - t))[own].sum()) / own.sum() < 1e-6
            assert fit.penalties[fold, o] in cs
        if task == MULTICLASS:
            hit = np.argmax(margins, axis=1) == label
            assert (train_scores[fold], test_scores[fold]) == pytest.approx((hit[~test].mean(), hit[test].mean()))
        else:
            for part_of, score in ((~test, train_scores[fold]), (test, test_scores[fold])):
                order = np.argsort(-margins[part_of, 0], kind="stable")
                hits = label[part_of][order]
                precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
                assert score == pytest.approx((precision * hits).sum() / hits.sum(), abs=2e-3)


def test_penalty_is_chosen_by_accuracy_for_each_class(data):
    _, _, found = cube_of(data, "cls", MULTICLASS)
    cs = (1e-4, 1.0)
    fit = linear.fit_logistic(found, cs)
    x, label, part, test = matrices(found, 0)
    deviation = x[~test].std(axis=0)
    x = x / np.where(deviation > 1e-12, deviation, 1)
    for c in range(len(found.classes)):
        means = []
        for penalty in cs:
            held = []
            for j in range(3):
                own, left = ~test & (part != j), ~test & (part == j)
                w = np.zeros(x.shape[1] + 1)
                z = np.hstack([x - x[~test].mean(axis=0), np.ones((len(x), 1))])
                t = (label == c).astype(float)
                for _ in range(40):
                    p = 1 / (1 + np.exp(-z[own] @ w))
                    ridge = np.append(np.ones(x.shape[1]), 0) / penalty
                    w = w - np.linalg.solve((z[own] * (p * (1 - p))[:, None]).T @ z[own] + np.diag(ridge), z[own].T @ (p - t[own]) + ridge * w)
                held.append((((z[left] @ w) > 0) == (t[left] > 0)).mean())
            means.append(np.mean(held))
        assert fit.penalties[0, c] == cs[int(np.argmax(np.round(means, 12)))]


def test_one_class_in_the_training_part(spark):
    df = spark.range(60).select(
        F.col("id").alias("k"), F.lit("x").alias("city"), F.lit("a").alias("kind"), F.col("id").cast("double").alias("size"),
        F.lit(1.0).alias("y"),
    )
    found = foldcube.build(df, plan_shuffle_split(df, "k", 2), ROLES, "TargetEncoder", BINARY, "y", "k")
    fit = linear.fit_logistic(found, balanced=True)
    assert (fit.weights == 0).all() and (fit.intercepts > 30).all()


def test_single_models_predict_rows_they_were_not_fitted_on(data):
    df = table(data, "price")
    train, other = df.where("k % 5 <> 0"), df.where("k % 5 = 0")
    features = fit_features(train, ROLES, "TargetEncoder", REGRESSION, "y", "k")
    x = features.transform(train, training=True)
    fitted = models.train_model(x, models.LINEAR, REGRESSION, "y", "k")
    rows = x.select(vector_to_array("features").alias("x"), "y", fold_of("k", 3).alias("p")).collect()
    a, y, p = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["p"] for r in rows])
    means = [
        np.mean([r2(y[p == j], a[p == j] @ w + b) for j in range(3) for w, b in [closed_form(a[p != j], y[p != j], alpha)]])
        for alpha in linear.RIDGE_ALPHAS
    ]
    w, b = closed_form(a, y, linear.RIDGE_ALPHAS[int(np.argmax(means))])
    held = features.transform(other).select("k", vector_to_array("features").alias("x"), "features", "y")
    expected = {r["k"]: float(np.array(r["x"]) @ w + b) for r in held.collect()}
    found = {r["k"]: r["prediction"] for r in fitted.predict(held.select("k", "features", "y")).collect()}
    assert found == pytest.approx(expected, rel=1e-9) and len(found) == 120


def test_normal_equations_hold_in_sql(data):
    """The gradient of the ridge loss at the solution, summed by SQL over the rows."""
    _, _, found = cube_of(data, "price", REGRESSION)
    fit = linear.fit_ridge(found)
    x, y, _, test = matrices(found, 1)
    deviation = x[~test].std(axis=0)
    deviation = np.where(deviation > 1e-12, deviation, 1)
    connection = duckdb.connect()
    names = [f"x{i}" for i in range(x.shape[1])]
    connection.sql(f"CREATE TABLE t ({', '.join(n + ' DOUBLE' for n in names)}, y DOUBLE)")
    connection.executemany(f"INSERT INTO t VALUES ({', '.join('?' * (len(names) + 1))})", [[*map(float, r), float(v)] for r, v in zip(x[~test], y[~test])])
    w, b, alpha = fit.weights[1, 0], float(fit.intercepts[1, 0]), fit.penalties[1, 0]
    residual = " + ".join(f"{n} * {float(v)!r}::DOUBLE" for n, v in zip(names, w)) + f" + {b!r}::DOUBLE - y"
    sums = connection.sql(f"SELECT sum({residual}), {', '.join(f'sum(({residual}) * {n})' for n in names)} FROM t").fetchall()[0]
    assert abs(sums[0]) < 1e-6
    for s, d, v in zip(sums[1:], deviation, w):
        assert s / d + alpha * v * d == pytest.approx(0, abs=1e-5)


def test_grid_scores_equal_fold_by_fold(spark, data, tmp_path):
    settings = X.Settings(n_splits=3)
    roles = {**ROLES}
    for y, task in (("price", REGRESSION), ("cls", MULTICLASS)):
        dataset = X.Dataset(y, task, roles, "k", lambda spark: table(data, y))
        prepared = X.prepare_rows(spark, dataset, settings)
        split = X.make_split(prepared, dataset, settings)
        together = X.run_folds(prepared, split, dataset, "TargetEncoder", models.LINEAR, settings)
        for fold in range(3):
            one = X.run_fold(prepared, split, fold, dataset, "TargetEncoder", models.LINEAR, settings)
            assert together[fold]["n_train_samples"] == one["n_train_samples"]
            assert together[fold]["score"] == pytest.approx(one["score"], abs=1e-6)
            assert together[fold]["train_score"] == pytest.approx(one["train_score"], abs=1e-6)


def test_wide_tables_and_other_models_go_fold_by_fold(data, monkeypatch):
    monkeypatch.setattr(foldcube, "MAX_WIDTH", 2)
    assert cube_of(data, "price", REGRESSION)[2] is None


def test_marks_of_folds_are_digested_once_for_all_encoders(data, monkeypatch):
    df, calls = table(data, "price"), []
    plan = plan_shuffle_split(df, "k", FOLDS)
    alone = foldcube.build(df, plan, ROLES, "TargetEncoder", REGRESSION, "y", "k")
    plain = type(plan).is_test
    monkeypatch.setattr(type(plan), "is_test", lambda self, fold: calls.append(fold) or plain(self, fold))
    both = foldcube.marked(df, plan)
    for encoder in ("Delete", "TargetEncoder"):
        found = foldcube.build(both, plan, ROLES, encoder, REGRESSION, "y", "k")
    assert len(calls) == FOLDS
    assert {r["key"]: (r["test"], r["e0"]) for r in found.rows.collect()} == {
        r["key"]: (r["test"], r["e0"]) for r in alone.rows.collect()
    }


@pytest.mark.parametrize("y", [None, "cls"])
@pytest.mark.parametrize("width", [6.0, 1e-4])
def test_marks_and_plan_come_from_one_digest(data, y, width):
    """Also where the cuts lie outside the window, and where rows have no class."""
    df = table(data, "cls").withColumn("cls", F.when(F.col("k") % 11 > 0, F.col("y")))
    plain = plan_shuffle_split(df, "k", FOLDS) if y is None else plan_stratified_split(df, "k", y, FOLDS)
    plan, rows = marked_split(df, "k", FOLDS, y=y, name="m", width=width)
    assert plan == plain and rows.columns == [*df.columns, "m"]
    expected = df.select("k", F.array(*[plain.is_test(i) for i in range(FOLDS)]).alias("m")).collect()
    assert {r["k"]: r["m"] for r in rows.collect()} == {r["k"]: r["m"] for r in expected}


def test_folds_of_a_small_file_have_work_for_every_core(spark, data, tmp_path):
    table(data, "flag").coalesce(1).write.parquet(str(tmp_path / "rows"))
    dataset = X.Dataset("flag", BINARY, ROLES, "k", lambda spark: spark.read.parquet(str(tmp_path / "rows")))
    rows, split = X.prepare_folds(spark, dataset, X.Settings(n_splits=FOLDS))
    found = foldcube.build(rows, split, ROLES, "TargetEncoder", BINARY, "y", "k")
    assert found.rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.rows.count() == 600
