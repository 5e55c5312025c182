"""The registered model queries over their whole job: all folds, all trees, scores that can be checked."""

import pytest

from tenc.operators.prepare import resolve_roles
from tenc.plans import experiment as X
from tenc.suite import modelling

FOLDER = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def test_searched_boosting_fits_all_trees(spark, monkeypatch):
    def caught(*args, **kwargs):
        assert kwargs.get("trees", 100) == 100
        raise Stop

    monkeypatch.setattr(modelling, "train_model", caught)
    monkeypatch.setattr(modelling, "_fitted_features", lambda *args: None)
    with pytest.raises(Stop):
        modelling.model_gbt_grid(spark, FOLDER)


@pytest.fixture(scope="module")
def grid(spark):
    return modelling.experiment_grid(spark, FOLDER).collect()


def test_grid_has_every_fold_of_every_run(grid):
    runs = {(r["dataset"], r["encoder"]) for r in grid}
    assert runs == {(d, e) for d in ("orders", "documents") for e in ("Delete", modelling._BAYES)}
    for run in runs:
        own = [r for r in grid if (r["dataset"], r["encoder"]) == run]
        assert sorted(r["fold"] for r in own) == list(range(20))
        assert all(0 < r["n_train_samples"] and r["score"] is not None for r in own)


def test_every_fold_of_the_fold_query(spark, grid):
    rows = sorted(modelling.run_fold(spark, FOLDER).collect(), key=lambda r: r["fold"])
    assert [r["fold"] for r in rows] == list(range(20))
    stored = {r["fold"]: r["score"] for r in grid if (r["dataset"], r["encoder"]) == ("orders", modelling._BAYES)}
    assert {r["fold"]: r["score"] for r in rows} == pytest.approx(stored)


def test_folds_of_the_grid_equal_folds_run_by_themselves(spark, grid):
    for dataset in (modelling._price_dataset(FOLDER), modelling._quality_dataset(FOLDER)):
        settings = X.Settings()
        prepared = modelling.materialise(X.prepare_rows(spark, dataset, settings))
        split = X.make_split(prepared, dataset, settings)
        stored = {r["fold"]: r for r in grid if (r["dataset"], r["encoder"]) == (dataset.name, modelling._BAYES)}
        for fold in (0, 19):
            one = X.run_fold(prepared, split, fold, dataset, modelling._BAYES, "L2RegularizedLinearModel", settings)
            for name in ("score", "train_score", "n_train_samples", "n_train_features"):
                assert stored[fold][name] == pytest.approx(one[name], abs=1e-6), (dataset.name, fold, name)
        assert resolve_roles(dataset.roles).target in prepared.columns
