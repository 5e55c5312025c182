"""Boosted trees against a search over the rows themselves."""

import numpy as np
import pytest

from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.plans import boosting
from tenc.plans.boosting import Growth


def grow(x, g, h, growth):
    """Best-first or level-wise growth by trying every cut between distinct values; returns a value a row."""
    leaves = [(np.arange(len(x)), 0)]

    def worth(rows):
        below = len(rows) if growth.by_rows else h[rows].sum() + growth.ridge
        return g[rows].sum() ** 2 / below if below > 0 else 0

    def best(rows, depth):
        found = None
        if growth.max_depth is not None and depth >= growth.max_depth:
            return None
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(left), len(right)) < growth.min_rows or min(h[left].sum(), h[right].sum()) < growth.min_curve:
                    continue
                gain = worth(left) + worth(right) - worth(rows)
                if gain > 1e-10 * max(worth(rows), 1e-12) and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found

    while growth.max_leaves is None or len(leaves) < growth.max_leaves:
        able = [(b[0], i, b) for i, (rows, depth) in enumerate(leaves) if (b := best(rows, depth))]
        if not able:
            break
        _, i, (_, left, right) = max(able, key=lambda a: a[0])
        _, depth = leaves.pop(i)
        leaves += [(left, depth + 1), (right, depth + 1)]
    value = np.zeros(len(x))
    for rows, _ in leaves:
        below = h[rows].sum() + growth.ridge
        value[rows] = g[rows].sum() / below if below > 1e-12 else 0
    return value


def plain_boost(x, y, task, k, growth, trees, weights=None):
    weight = np.ones(len(y)) if weights is None else weights[y.astype(int)]
    if task == REGRESSION:
        margins = np.full((len(y), 1), y.mean())
    elif task == BINARY:
        margins = np.full((len(y), 1), np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    else:
        margins = np.tile(np.log([(y == c).mean() for c in range(k)]), (len(y), 1))
    path = [margins.copy()]
    for _ in range(trees):
        if task == REGRESSION:
            g, h = y[:, None] - margins, np.ones_like(margins)
        elif task == BINARY:
            p = 1 / (1 + np.exp(-margins))
            g, h = y[:, None] - p, p * (1 - p)
        else:
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = (y[:, None] == np.arange(k)) - p, p * (1 - p) * k / (k - 1)
        margins = margins + growth.rate * np.column_stack(
            [grow(x, g[:, c] * weight, h[:, c] * weight, growth) for c in range(margins.shape[1])]
        )
        path.append(margins)
    return path


def table(n=160, seed=1, classes=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 6, n), rng.normal(size=n).round(1), np.ones(n)]).astype(float)
    signal = np.sin(x[:, 0] / 3) + x[:, 1] / 3 + x[:, 2] * (x[:, 0] > 8) + rng.normal(size=n) / 5
    label = np.digitize(signal, np.quantile(signal, [i / classes for i in range(1, classes)])).astype(float)
    return x, signal, label, rng.integers(0, 3, n)


def frame(spark, x, y, part):
    rows = [(float(v), int(p), list(map(float, r))) for r, v, p in zip(x, y, part)]
    return spark.createDataFrame(rows, "label double, part int, x array<double>").repartition(4)


LEAFWISE = Growth(rate=0.3, max_leaves=6, min_rows=5, min_curve=1e-3)
LEVELS = Growth(rate=0.2, max_depth=3, by_rows=True)
RIDGED = Growth(rate=0.3, max_depth=4, ridge=1.0, min_curve=1.0)


@pytest.mark.parametrize("growth", [LEAFWISE, LEVELS, RIDGED])
def test_trees_equal_a_search_over_rows(spark, monkeypatch, growth):
    monkeypatch.setattr(boosting, "RENEW", 2)
    x, signal, label, part = table()
    for y, task in ((signal, REGRESSION), ((label > 0).astype(float), BINARY)):
        found = boosting.fit_boosting(frame(spark, x, y, part), task, 1, [growth], 4, bins=250)
        expected = plain_boost(x, y, task, 2, growth, 4)[-1]
        assert np.allclose(found.margins(x), expected, atol=1e-6)
        leaves = [(t.feature < 0).sum() for row in found.trees for t in row]
        reached = [len(np.unique(t.nodes(boosting._binned(x, found.edges)))) for row in found.trees for t in row]
        assert max(reached) <= (growth.max_leaves or 2**growth.max_depth) and min(leaves) > 1


def test_joint_deviance_of_several_classes(spark):
    x, _, label, part = table(n=120)
    growth = Growth(rate=0.4, max_depth=2, by_rows=True)
    found = boosting.fit_boosting(frame(spark, x, label, part), MULTICLASS, 3, [growth], 5, bins=250)
    path = plain_boost(x, label, MULTICLASS, 3, growth, 5)
    assert np.allclose(found.margins(x), path[-1], atol=1e-6)
    chances = boosting._chances(MULTICLASS, found.margins(x))
    assert np.allclose(chances.sum(axis=1), 1)
    rows = np.arange(len(label)), label.astype(int)
    deviance = []
    for r in range(6):
        part_of = boosting.BoostedModel(MULTICLASS, found.trees[:r], found.start, found.rate, found.edges, growth)
        deviance.append(-np.log(boosting._chances(MULTICLASS, part_of.margins(x))[rows]).mean())
    assert all(a > b for a, b in zip(deviance, deviance[1:]))
    assert (found.predict(x) == np.argmax(path[-1], axis=1)).all()


def test_search_keeps_the_best_candidate_over_inner_folds(spark):
    x, signal, label, part = table(n=140, seed=3)
    y = (label > 0).astype(float)
    growths = boosting.candidates(Growth(min_rows=4), {"stepSize": (0.05, 0.5), "numLeaves": (2, 6)})
    assert [(g.rate, g.max_leaves) for g in growths] == [(0.05, 2), (0.05, 6), (0.5, 2), (0.5, 6)]
    rounds = []
    found = boosting.fit_boosting(frame(spark, x, y, part), BINARY, 1, growths, 3, balanced=True, bins=250, rounds=rounds)
    means = []
    for c, growth in enumerate(growths):
        scores = []
        for j in range(4):
            own = part != j
            weights = own.sum() / (2 * np.array([(y[own] == 0).sum(), (y[own] == 1).sum()]))
            expected = plain_boost(x[own], y[own], BINARY, 2, growth, 3, weights)[-1][:, 0]
            trees = [r[4 * c + j] for r in rounds]
            start = np.log((weights[1] * y[own]).sum() / (weights[0] * (1 - y[own])).sum())
            model = boosting.BoostedModel(BINARY, trees, np.array([start]), growth.rate, found.edges, growth)
            assert np.allclose(model.margins(x[own])[:, 0], expected, atol=1e-6)
            if j < 3:
                p, t = model.predict(x[~own]), y[~own]
                score = 0
                for v in np.unique(p):
                    score += t[p == v].sum() / t.sum() * t[p >= v].sum() / (p >= v).sum()
                scores.append(score)
        means.append(np.mean(scores))
    assert found.growth == growths[int(np.argmax(np.round(means, 12)))]


def test_constant_features_missing_values_and_no_rows(spark):
    x, y = np.ones((30, 2)), np.arange(30.0)
    found = boosting.fit_boosting(frame(spark, x, y, np.zeros(30)), REGRESSION, 1, [LEVELS], 2)
    assert np.allclose(found.predict(x), y.mean())
    with pytest.raises(Exception, match="missing"):
        boosting.fit_boosting(frame(spark, np.full((5, 1), np.nan), y[:5], np.zeros(5)), REGRESSION, 1, [LEVELS], 1)
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_boosting(frame(spark, x, y, np.zeros(30)).limit(0), REGRESSION, 1, [LEVELS], 1)


def test_rows_that_agree_are_one_cell_and_last_leaves_are_not_scanned(spark, monkeypatch):
    """Fifty copies of the rows give the same trees from as many cells, in three scans a tree of depth three."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 60), rng.integers(0, 5, 60)]).astype(float)
    y, scans, cells = x[:, 0] * x[:, 1] + rng.normal(size=60), [], []
    scanned, made = boosting._scanned, boosting._cells
    monkeypatch.setattr(boosting, "_scanned", lambda *args: scans.append(1) or scanned(*args))

    def counted(*args):
        state, tasks = made(*args)
        cells.append((state.count(), state.agg({"n": "sum"}).first()[0]))
        return state, tasks

    monkeypatch.setattr(boosting, "_cells", counted)
    for label, task in ((y, REGRESSION), ((y > y.mean()).astype(float), BINARY)):
        scans.clear(), cells.clear()
        one = boosting.fit_boosting(frame(spark, x, label, np.zeros(60)), task, 1, [LEVELS], 3)
        assert len(scans) <= 9
        many = boosting.fit_boosting(
            frame(spark, np.tile(x, (50, 1)), np.tile(label, 50), np.arange(3000) % 3), task, 1, [LEVELS], 3
        )
        assert cells[0][0] == cells[1][0] <= 60 and (cells[0][1], cells[1][1]) == (60, 3000)
        assert np.allclose(one.margins(x), many.margins(x))


@pytest.mark.parametrize("task", [REGRESSION, BINARY, MULTICLASS])
def test_models_of_a_search_are_fitted_without_scans_where_a_task_holds_the_cells(spark, monkeypatch, task):
    x, signal, label, part = table(n=150, seed=5)
    y = {REGRESSION: signal, BINARY: (label > 0).astype(float), MULTICLASS: label}[task]
    outputs = 3 if task == MULTICLASS else 1
    growths = boosting.candidates(Growth(min_rows=3), {"stepSize": (0.1, 0.5), "numLeaves": (3, 7)})
    if task != MULTICLASS:
        # With several classes these meet cuts that are equally good, and either may be made.
        growths += [RIDGED, LEVELS]
    scans, scanned = [], boosting._scanned
    monkeypatch.setattr(boosting, "_scanned", lambda *args: scans.append(1) or scanned(*args))

    def fitted():
        rounds = []
        balanced = task == BINARY
        rows = frame(spark, np.tile(x, (3, 1)), np.tile(y, 3), np.tile(part, 3))
        return boosting.fit_boosting(rows, task, outputs, growths, 4, balanced=balanced, rounds=rounds), rounds

    held, held_rounds = fitted()
    assert not scans
    monkeypatch.setattr(boosting, "_HELD_BYTES", 0)
    found, found_rounds = fitted()
    assert scans and held.growth == found.growth
    assert np.allclose(held.margins(x), found.margins(x))
    bins = boosting._binned(x, found.edges)
    for a, b in zip(held_rounds, found_rounds, strict=True):
        for m, (one, other) in enumerate(zip(a, b, strict=True)):
            own = part != [0, 1, 2, -1][m % 4]
            for s, t in zip(one, other, strict=True):
                assert np.allclose(s.value[s.nodes(bins[own])], t.value[t.nodes(bins[own])])
