"""Penalised linear models of all folds together.

Ridge models need nothing but sums: the products of all columns, by fold and inner fold, come from one scan.
Training parts are sums of parts, every penalty and fold is then a small system of equations, and r2 on
any part follows from the same sums. Logistic models of all folds, inner folds, classes and
penalties advance together by Newton steps: a scan gives every model's loss, gradient and second
derivatives. Only such sums, whose size depends on columns and models, reach the driver.

Penalties are those of the usual closed forms: ``sum of squares + alpha |w|^2`` and ``C * loss + |w|^2 / 2``, with
an intercept that is not penalised. A penalty is chosen by the mean score of the inner folds (r2, or
accuracy for each class against the rest; of equal ones the first), and the model with it learns from all parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.metrics import average_precision
from tenc.plans.foldcube import INNER_FOLDS, FoldRows

# The searched penalties.
RIDGE_ALPHAS = (0.1, 1.0, 10.0)
LOGISTIC_CS = tuple(10 ** (-4 + 8 * i / 9) for i in range(10))
MAX_SCANS = 100
# A model has converged when no entry of its gradient is above this share of its rows' weight.
TOLERANCE = 1e-9
# The parts of a fold: its inner folds, then its test rows. Models of all inner folds stand behind those without one.
_TEST = INNER_FOLDS
# Numbers that one step of a scan holds in a matrix of products.
_CELLS = 4_000_000
# Rows whose margins by all penalties stay in a core's cache.
_NEAR = 4_096


@dataclass(frozen=True)
class LinearFit:
    """Weights (by fold, output and column) on unscaled columns, intercepts, penalties and scans it took."""

    task: str
    weights: np.ndarray
    intercepts: np.ndarray
    penalties: np.ndarray
    scans: int
    n_train: np.ndarray
    n_features: np.ndarray
    # r2 of training and test rows by fold; other scores need the rows.
    train_scores: np.ndarray | None = None
    test_scores: np.ndarray | None = None


class _Batch:
    """A batch of rows as matrices."""

    def __init__(self, batch: pa.RecordBatch, shape: FoldRows):
        n = batch.num_rows
        self.label = batch.column("label").to_numpy(zero_copy_only=False)
        self.part = batch.column("part").to_numpy(zero_copy_only=False)
        self.test = batch.column("test").flatten().to_numpy(zero_copy_only=False).reshape(n, shape.n_folds)
        numbers = [batch.column("shared").flatten().to_numpy(zero_copy_only=False).reshape(n, shape.n_shared)]
        self.encoded = [
            batch.column(f"e{i}").flatten().to_numpy(zero_copy_only=False).reshape(n, shape.n_folds, k)
            for i, k in enumerate(shape.outputs)
        ]
        self.shared = numbers[0].astype(float)
        if np.isnan(self.shared).any():
            raise ValueError("a feature is missing")

    def columns(self, fold: int) -> np.ndarray:
        return np.hstack([self.shared, *[e[:, fold] for e in self.encoded]])


def _pieces(batches, shape: FoldRows, cells_a_row: int, most: int | None = None):
    rows = max(16, _CELLS // max(cells_a_row, 1))
    rows = min(rows, most or rows)
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            piece = whole.slice(at, rows)
            if piece.num_rows:
                yield _Batch(piece, shape)


def _used(data: FoldRows) -> DataFrame:
    return data.rows.select("label", "part", "shared", "test", *[f"e{i}" for i in range(len(data.outputs))])


def _added(rows: DataFrame, by: list[str]) -> dict[tuple, np.ndarray]:
    """Sum arrays of tasks entry by entry in Spark; a vector for each ``by`` reaches the driver."""
    cells = rows.select(*by, F.posexplode("values").alias("pos", "value"))
    sums = cells.groupBy(*by, "pos").agg(F.sum("value").alias("value"))
    table = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("all")).select(
        *by, F.transform("all", lambda x: x["value"]).alias("values")
    ).toArrow()
    keys = zip(*[table.column(c).to_pylist() for c in by])
    return {k: np.array(v) for k, v in zip(keys, table.column("values").to_pylist())}


def _centres(data: FoldRows) -> np.ndarray:
    """Means of columns and label, about which products are summed, against cancellation."""
    if data.centres is not None:
        return np.array(data.centres)
    means = [F.avg(F.col("shared")[i]) for i in range(data.n_shared)]
    # The encodings of a column have much the same mean in every fold.
    coded = [F.avg(F.col(f"e{i}")[c]) for i, k in enumerate(data.outputs) for c in range(k)]
    row = data.rows.agg(*[m.alias(f"m{i}") for i, m in enumerate([*means, *coded, F.avg("label")])]).first()
    return np.array([x or 0.0 for x in row])


def _products(batches, shape: FoldRows, centres: np.ndarray):
    size = shape.width + 2
    parts = INNER_FOLDS + 1
    # Columns that all folds share, one and the label: their products are taken once and added up by fold and part.
    plain = [*range(shape.n_shared), size - 2, size - 1]
    coded = list(range(shape.n_shared, size - 2))
    left, right = np.triu_indices(len(plain))
    both = np.zeros((shape.n_folds * parts, len(left)))
    sums = np.zeros((shape.n_folds, parts, size, size))
    ends = np.array([*centres[: shape.n_shared], 0.0, centres[-1]])
    for b in _pieces(batches, shape, len(left) + shape.n_folds * parts + size):
        n = len(b.label)
        z = np.hstack([b.shared, np.ones((n, 1)), b.label[:, None]]) - ends
        own = np.zeros((n, shape.n_folds, parts))
        np.put_along_axis(own, np.where(b.test, _TEST, b.part[:, None])[:, :, None], 1.0, axis=2)
        both += own.reshape(n, -1).T @ (z[:, left] * z[:, right])
        for f in range(shape.n_folds if coded else 0):
            e = np.hstack([x[:, f] for x in b.encoded]) - centres[shape.n_shared : -1]
            every = np.hstack([z, e])
            for i, c in enumerate(coded):
                sums[f, :, c, plain + coded] += ((own[:, f] * e[:, i : i + 1]).T @ every).T
    for c in coded:
        sums[:, :, plain, c] = sums[:, :, c, plain]
    both = both.reshape(shape.n_folds, parts, -1)
    at = np.array(plain)
    sums[:, :, at[left], at[right]] = both
    sums[:, :, at[right], at[left]] = both
    n = shape.n_folds * (INNER_FOLDS + 1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(shape.n_folds), INNER_FOLDS + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(INNER_FOLDS + 1), shape.n_folds).astype(np.int32)),
            pa.array(list(sums.reshape(n, -1)), pa.list_(pa.float64())),
        ],
        ["fold", "part", "values"],
    )


def gram(data: FoldRows) -> tuple[np.ndarray, np.ndarray]:
    """Products of all columns, one, and the label, by fold and part, and what columns and label were centred on."""
    centres = _centres(data)
    size = data.width + 2
    made = _used(data).mapInArrow(
        partial(_products, shape=_shape(data), centres=centres), "fold int, part int, values array<double>"
    )
    sums = np.zeros((data.n_folds, INNER_FOLDS + 1, size, size))
    for (fold, part), values in _added(made, ["fold", "part"]).items():
        sums[fold, part] = values.reshape(size, size)
    return sums, centres


def _shape(data: FoldRows) -> FoldRows:
    """What tasks need of the rows' description."""
    return FoldRows(None, data.n_folds, data.n_shared, data.outputs, data.classes, data.flags)


def _r2(products: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """r2 of a model on the rows whose products these are."""
    v = np.append(weights, [intercept, -1.0])
    n, total = products[-2, -2], products[-1, -2]
    if not n:
        return float("nan")
    error, spread = max(v @ products @ v, 0.0), products[-1, -1] - total * total / n
    return 1 - error / spread if spread > 0 else float(error == 0)


def _deviations(products: np.ndarray, centres: np.ndarray, scale: bool) -> np.ndarray:
    """Standard deviations of the columns; one for a column that does not vary, or where nothing is scaled."""
    n = max(products[-2, -2], 1)
    squares = np.diag(products)[:-2] / n
    variance = squares - (products[-2, :-2] / n) ** 2
    # What is left of a column that does not vary is the rounding of its sums.
    varies = variance > 1e-13 * (squares + centres[:-1] ** 2)
    return np.where(varies, np.sqrt(np.maximum(variance, 0)), 1.0) if scale else np.ones(len(variance))


def _ridge(products: np.ndarray, deviation: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    n, means = products[-2, -2], products[-2] / products[-2, -2]
    inner = products - n * np.outer(means, means)
    a = inner[:-2, :-2] / np.outer(deviation, deviation)
    b = inner[:-2, -1] / deviation
    weights = np.linalg.solve(a + alpha * np.eye(len(a)), b) / deviation
    return weights, means[-1] - means[:-2] @ weights


def _n_features(data: FoldRows, products: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Columns by fold: of flags, those that some training row has."""
    train = products[:, :INNER_FOLDS].sum(axis=1)
    n = train[:, -2, -2]
    sums = train[:, -2, : data.n_shared] + centres[: data.n_shared] * n[:, None]
    absent = (sums < 0.5) & np.array(data.flags or (False,) * data.n_shared, bool)
    return data.width - absent.sum(axis=1)


def fit_ridge(data: FoldRows, alphas: tuple[float, ...] = RIDGE_ALPHAS, scale: bool = True) -> LinearFit:
    """Ridge models of all folds from one scan (and one of means)."""
    products, centres = gram(data)
    weights, intercepts, chosen, train_scores, test_scores = [], [], [], [], []
    for fold in products:
        train = fold[:INNER_FOLDS].sum(axis=0)
        if not train[-2, -2]:
            raise ValueError("a fold has no training rows")
        deviation = _deviations(train, centres, scale)
        scores = []
        for alpha in alphas:
            held = [
                _r2(fold[j], *_ridge(train - fold[j], deviation, alpha))
                for j in range(INNER_FOLDS) if fold[j][-2, -2] and train[-2, -2] > fold[j][-2, -2]
            ]
            scores.append(np.mean(held) if held else -np.inf)
        best = alphas[int(np.argmax(scores))]
        w, b = _ridge(train, deviation, best)
        train_scores.append(_r2(train, w, b)), test_scores.append(_r2(fold[_TEST], w, b))
        weights.append(w), chosen.append(best)
        intercepts.append(b + centres[-1] - centres[:-1] @ w)
    n = products[:, :INNER_FOLDS, -2, -2].sum(axis=1)
    return LinearFit(
        REGRESSION, np.array(weights)[:, None], np.array(intercepts)[:, None], np.array(chosen)[:, None], 2, n,
        _n_features(data, products, centres), np.array(train_scores), np.array(test_scores),
    )


def _newton_sums(batches, shape: FoldRows, centres, deviations, state):
    """Loss, right answers on the part left out, gradient and second derivatives of every model that still moves.

    ``state`` gives by fold and output the numbers of the models, the inner fold each leaves out (or none),
    their weights with the intercept last, and the weights of rows of label 0 and 1.
    """
    size = shape.width + 1
    upper = np.triu_indices(size)
    sums = {m: np.zeros(2 + size + len(upper[0])) for s in state.values() for m in s[0]}
    # Models of one fold and output that learn from the same rows, alike weighted, go together.
    groups: dict[int, list] = {}
    for (f, c), (models, left_out, weights, balance) in state.items():
        kinds, kind = np.unique(np.column_stack([left_out, balance]), axis=0, return_inverse=True)
        for i, (part, *by_label) in enumerate(kinds):
            some = np.flatnonzero(kind.ravel() == i)
            groups.setdefault(f, []).append((c, int(part), by_label, [models[j] for j in some], weights[some].T))
    for b in _pieces(batches, shape, size * size, _NEAR):
        for f, ready in groups.items():
            train = ~b.test[:, f]
            label, part = b.label[train], b.part[train]
            x = np.hstack([(b.columns(f)[train] - centres[:-1]) / deviations[f], np.ones((len(label), 1))])
            pairs = x[:, upper[0]] * x[:, upper[1]]
            for c, out, by_label, models, weights in ready:
                own = part != out
                held, hit = x[~own] @ weights > 0, (label[~own] == c)[:, None]
                right = (held == hit).sum(axis=0)
                near, is_class = x[own], label[own] == c
                share = np.where(is_class, by_label[1], by_label[0])
                margin = near @ weights
                small = np.exp(-np.abs(margin))
                loss = share @ (np.log1p(small) + np.maximum(np.where(is_class[:, None], -margin, margin), 0))
                chance = np.where(margin >= 0, 1.0, small) / (1 + small)
                slope = (chance - is_class[:, None]).T @ (near * share[:, None])
                curve = (chance * (1 - chance)).T @ (pairs[own] * share[:, None])
                for i, m in enumerate(models):
                    sums[m] += np.concatenate([[loss[i], right[i]], slope[i], curve[i]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.array(list(sums), np.int32)), pa.array(list(sums.values()), pa.list_(pa.float64()))],
        ["model", "values"],
    )


def fit_logistic(
    data: FoldRows, cs: tuple[float, ...] = LOGISTIC_CS, balanced: bool = False, scale: bool = True,
    tolerance: float = TOLERANCE, max_scans: int = MAX_SCANS,
) -> LinearFit:
    """Logistic models of all folds: two classes (label 0 and 1), or each of ``data.classes`` against the rest.

    ``balanced`` weighs rows of a class by ``n / (2 n_class)``, counted in what a model learns from.
    """
    products, centres = gram(data)
    outputs = range(len(data.classes)) if data.classes else (1,)
    size = data.width + 1
    counts = _class_counts(data, outputs)
    train = products[:, :INNER_FOLDS].sum(axis=1)
    if (train[:, -2, -2] == 0).any():
        raise ValueError("a fold has no training rows")
    deviations = np.array([_deviations(t, centres, scale) for t in train])
    # A model for each fold, output, part left out (or none) and penalty.
    models = [(f, c, j, q) for f in range(data.n_folds) for c in outputs for j in range(INNER_FOLDS + 1) for q in range(len(cs))]
    left = np.array([j if j < INNER_FOLDS else -1 for _, _, j, _ in models])
    penalty = np.array([1 / cs[q] for *_, q in models])
    w = np.zeros((len(models), size))
    balance = np.ones((len(models), 2))
    mass = np.zeros(len(models))
    moving = np.ones(len(models), bool)
    for i, (f, c, j, _) in enumerate(models):
        own = counts[f, c][[p for p in range(INNER_FOLDS) if p != j]].sum(axis=0)
        mass[i] = own.sum()
        if not own.all():
            # Only one class to learn from: no weight, and an intercept that says so.
            w[i, -1], moving[i] = (36.0 if own[1] else -36.0), False
        elif balanced:
            balance[i] = own.sum() / (2 * own)
    ridge = np.ones(size)
    ridge[-1] = 0
    accepted, step_from = w.copy(), np.zeros_like(w)
    lowest, fraction = np.full(len(models), np.inf), np.ones(len(models))
    right = np.zeros(len(models))
    upper = np.triu_indices(size)
    scans = 0
    while moving.any() and scans < max_scans:
        state = {}
        for f in range(data.n_folds):
            for c in outputs:
                some = np.array([i for i, m in enumerate(models) if m[0] == f and m[1] == c and moving[i]], int)
                if len(some):
                    state[f, c] = (some.tolist(), left[some], w[some], balance[some])
        made = _used(data).mapInArrow(
            partial(_newton_sums, shape=_shape(data), centres=centres, deviations=deviations, state=state),
            "model int, values array<double>",
        )
        scans += 1
        for (i,), sums in _added(made, ["model"]).items():
            loss = sums[0] + penalty[i] * (ridge * w[i] ** 2).sum() / 2
            if loss > lowest[i] + 1e-12 * abs(lowest[i]):
                # Too far: half the way back, along the same direction.
                fraction[i] /= 2
                if fraction[i] < 1e-8:
                    w[i], moving[i] = accepted[i], False
                else:
                    w[i] = accepted[i] + fraction[i] * step_from[i]
                continue
            lowest[i], right[i], accepted[i], fraction[i] = loss, sums[1], w[i], 1.0
            slope = sums[2 : 2 + size] + penalty[i] * ridge * w[i]
            if np.abs(slope).max() <= tolerance * mass[i]:
                moving[i] = False
                continue
            curve = np.zeros((size, size))
            curve[upper] = sums[2 + size :]
            curve = curve + curve.T - np.diag(np.diag(curve)) + penalty[i] * np.diag(ridge)
            curve[-1, -1] += 1e-12 * mass[i]
            step_from[i] = -np.linalg.solve(curve, slope)
            w[i] = accepted[i] + step_from[i]
    index = {m: i for i, m in enumerate(models)}
    weights = np.zeros((data.n_folds, len(outputs), data.width))
    intercepts, chosen = np.zeros(weights.shape[:2]), np.zeros(weights.shape[:2])
    for f in range(data.n_folds):
        for o, c in enumerate(outputs):
            # Inner folds count alike, however many rows they have.
            held = counts[f, c][:INNER_FOLDS].sum(axis=1)
            scores = [
                sum(right[index[f, c, j, q]] / held[j] for j in range(INNER_FOLDS) if held[j]) for q in range(len(cs))
            ]
            best = int(np.argmax(np.round(scores, 12)))
            final = accepted[index[f, c, INNER_FOLDS, best]]
            weights[f, o] = final[:-1] / deviations[f]
            intercepts[f, o] = final[-1] - centres[:-1] @ weights[f, o]
            chosen[f, o] = cs[best]
    return LinearFit(
        MULTICLASS if data.classes else BINARY, weights, intercepts, chosen, scans + 2, train[:, -2, -2],
        _n_features(data, products, centres),
    )


def _class_counts(data: FoldRows, outputs) -> dict[tuple[int, int], np.ndarray]:
    """Rows of each part by whether they have the label, for every fold and output: one small table on the driver."""
    folds = F.posexplode("test").alias("fold", "is_test")
    long = data.rows.select("label", "part", folds)
    counted = long.groupBy("fold", F.when(F.col("is_test"), F.lit(_TEST)).otherwise(F.col("part")).alias("part"), "label").count()
    found = {(f, c): np.zeros((INNER_FOLDS + 1, 2)) for f in range(data.n_folds) for c in outputs}
    for r in counted.collect():
        for c in outputs:
            found[r["fold"], c][r["part"], int(r["label"] == c)] += r["count"]
    return found


def _fold_scores(batches, shape: FoldRows, fit: LinearFit):
    """Every row's score (or hit, for several classes) in every fold."""
    for b in _pieces(batches, shape, 8 * shape.n_folds + shape.width):
        for f in range(shape.n_folds):
            margin = b.columns(f) @ fit.weights[f].T + fit.intercepts[f]
            if fit.task == MULTICLASS:
                score = (np.argmax(margin, axis=1) == b.label).astype(float)
            else:
                score = 1 / (1 + np.exp(-np.clip(margin[:, 0], -700, 700)))
            n = len(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, f, np.int32)), pa.array(b.test[:, f]), pa.array(b.label), pa.array(score)],
                ["fold", "is_test", "label", "score"],
            )


def fold_scores(data: FoldRows, fit: LinearFit) -> tuple[np.ndarray, np.ndarray]:
    """Scores of training and test rows by fold."""
    if fit.task == REGRESSION:
        return fit.train_scores, fit.test_scores
    rows = _used(data).mapInArrow(
        partial(_fold_scores, shape=_shape(data), fit=fit), "fold int, is_test boolean, label double, score double"
    )
    by = ["fold", "is_test"]
    if fit.task == MULTICLASS:
        scored = rows.groupBy(*by).agg(F.avg("score").alias("score"))
    else:
        scored = average_precision(rows, "label", "score", by)
    found = {(r["fold"], r["is_test"]): r["score"] for r in scored.collect()}
    return tuple(
        np.array([np.nan if found.get((f, t)) is None else found[f, t] for f in range(data.n_folds)]) for t in (False, True)
    )
