"""Boosted trees on binned features, all candidates and inner folds of a search in the same scans.

Columns are cut at quantiles into bins, once, and rows that agree in all bins (and in label and inner fold, where these
matter) become one cell with their number: trees cannot tell them apart. A scan of the cells gives, for every node of every model that is being looked at,
sums of gradients, second derivatives and rows by feature and bin; the best cuts follow from these small tables,
and of two siblings only the smaller is summed, the other is the difference to its parent. Trees grow best-first to
a number of leaves, or level by level to a depth. For several classes a round grows a tree for each class on
the gradients of the joint deviance. Leaves get Newton values.

The first scan of a round adds the last trees to the cells' margins, which stay with the executors; every few rounds
they are written. Leaves that nothing can cut any more are not scanned: their sums are known from their parent.
Nothing but tables of bins reaches the driver: their size depends on features, bins and models, not on rows.

Cells that a task can hold need no scans where candidates are searched: every task gets them all and fits a model
of the search by itself, with the same cuts. What is held is limited in bytes; cells beyond that are scanned.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass, field
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.metrics import accuracy_score, average_precision, r2_score
from tenc.plans.foldcube import INNER_FOLDS
from tenc.session import materialise

MAX_BINS = 64
# Rounds after which the margins are written again.
RENEW = 10
# Cells taken at a time, and margins that are worth a task.
_ROWS = 8192
_TASK_MARGINS = 100_000
# Tables of so many tasks are added up on the driver; those of more are added by Spark first.
_FEW_TASKS = 16
# What the cells of a search may take in a task that holds them all: their bins, and this for each cell besides.
_HELD_BYTES = 128 << 20
_CELL_BYTES = 64
# Entries of cells by feature that are summed at a time.
_ENTRIES = 1 << 20


@dataclass(frozen=True)
class Growth:
    """A candidate: step size, leaves or depth of a tree, and what a leaf must hold.

    ``by_rows`` chooses cuts by the squared error of the gradients; else by the Newton gain, with ``ridge`` added to
    second derivatives.
    """

    rate: float = 0.1
    max_leaves: int | None = None
    max_depth: int | None = None
    ridge: float = 0.0
    min_rows: int = 1
    min_curve: float = 0.0
    by_rows: bool = False


@dataclass(frozen=True)
class Tree:
    """Arrays by node: feature (-1: a leaf), last bin that goes left, children and value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            left = bins[inner, self.feature[at]] <= self.cut[at]
            node[inner] = np.where(left, self.left[at], self.right[at])
            inner = inner[self.feature[node[inner]] >= 0]
        return node


@dataclass
class _Node:
    depth: int
    sums: np.ndarray | None = None  # gradient, second derivative, rows
    table: np.ndarray | None = None  # the same by feature and bin
    best: tuple[float, int, int] | None = None
    children: tuple[int, int] | None = None


@dataclass
class Growing:
    """A tree under way: known nodes, cut in advance where their gain may be wanted, and those to be summed.

    ``ahead`` is how many may be cut in advance at a time; without a limit a tree needs the fewest scans.
    """

    growth: Growth
    ahead: int | None = None
    nodes: list[_Node] = field(default_factory=lambda: [_Node(0)])
    waiting: list[tuple[int, int | None, int | None]] = field(default_factory=lambda: [(0, None, None)])
    done: Tree | None = None

    def receive(self, tables: dict[int, np.ndarray], shape: tuple[int, int]) -> None:
        for node, sibling, parent in self.waiting:
            known = self.nodes[node]
            known.table = tables.get(node, np.zeros((*shape, 3)))
            self._judge(known)
            if sibling is not None:
                self.nodes[sibling].table = self.nodes[parent].table - known.table
                self._judge(self.nodes[sibling])
                self.nodes[parent].table = None
        self.waiting = []
        self._advance()

    def _judge(self, node: _Node) -> None:
        g = self.growth
        node.sums = node.table[0].sum(axis=0)
        left = node.table.cumsum(axis=1)[:, :-1]
        right = node.sums - left
        if not left.size:
            return

        def worth(s):
            below = s[..., 2] if g.by_rows else s[..., 1] + g.ridge
            return np.where(below > 0, s[..., 0] ** 2 / np.where(below > 0, below, 1), 0)

        gain = worth(left) + worth(right) - worth(node.sums)
        # Differences of sums leave a rounding error where there is no row.
        fits = np.ones(gain.shape, bool)
        for side in (left, right):
            fits &= (side[..., 2] > max(g.min_rows, 1) - 0.5) & (side[..., 1] >= g.min_curve)
        gain = np.where(fits, gain, -np.inf)
        feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[feature, cut] > 1e-10 * max(worth(node.sums), 1e-12):
            node.best = (float(gain[feature, cut]), int(feature), int(cut))

    def _open(self, i: int) -> bool:
        node = self.nodes[i]
        return node.best is not None and not self._deep(i)

    def _advance(self) -> None:
        """Choose cuts best-first as far as gains are known; then ask for the nodes that may come next."""
        leaves, chosen = [0], set()
        while True:
            limit = self.growth.max_leaves
            left = None if limit is None else limit - len(leaves)
            able = [i for i in leaves if self._open(i)]
            if not able or left == 0:
                self.done = self._built(chosen)
                return
            top = max(able, key=lambda i: (self.nodes[i].best[0], -i))
            if self.nodes[top].children is None:
                if left != 1:
                    break
                # The last cut: nothing is asked about its leaves but their sums.
                self._cut(top)
            chosen.add(top)
            leaves.remove(top)
            leaves += self.nodes[top].children
        ahead = [i for i, n in enumerate(self.nodes) if n.children is None and n.sums is not None and self._open(i)]
        for i in sorted(ahead, key=lambda i: -self.nodes[i].best[0])[:left]:
            small, large = self._cut(i)
            if self._deep(small):
                continue
            self.waiting.append((small, large, i))
            if len(self.waiting) == self.ahead:
                break
        if not self.waiting:
            self._advance()

    def _deep(self, i: int) -> bool:
        return self.growth.max_depth is not None and self.nodes[i].depth >= self.growth.max_depth

    def _cut(self, i: int) -> tuple[int, int]:
        """Make the two children of a node; the one with fewer rows comes first."""
        node = self.nodes[i]
        _, feature, cut = node.best
        pair = (len(self.nodes), len(self.nodes) + 1)
        below = node.table[feature, : cut + 1].sum(axis=0)
        self.nodes += [_Node(node.depth + 1, below), _Node(node.depth + 1, node.sums - below)]
        node.children = pair
        return pair if 2 * below[2] <= node.sums[2] else pair[::-1]

    def tree(self) -> Tree:
        """The tree with all cuts made so far, also those in advance."""
        return self._built({i for i, n in enumerate(self.nodes) if n.children is not None})

    def _built(self, chosen: set[int]) -> Tree:
        n = len(self.nodes)
        feature, cut, left, right, value = np.full(n, -1), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        for i, node in enumerate(self.nodes):
            if i in chosen:
                _, feature[i], cut[i] = node.best
                left[i], right[i] = node.children
            elif node.sums is not None:
                below = node.sums[1] + self.growth.ridge
                value[i] = node.sums[0] / below if below > 1e-12 else 0.0
        return Tree(feature, cut, left, right, value)


@dataclass(frozen=True)
class BoostedModel:
    """Trees by round and output, where margins start, step size, and the edges of the bins."""

    task: str
    trees: list[list[Tree]]
    start: np.ndarray
    rate: float
    edges: list[np.ndarray]
    growth: Growth

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        total = np.tile(self.start, (len(x), 1))
        for row in self.trees:
            for k, tree in enumerate(row):
                total[:, k] += self.rate * tree.value[tree.nodes(bins)]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The value, the probability of class 1, or the number of the class."""
        return _answers(self.task, self.margins(x))


def _answers(task: str, margins: np.ndarray) -> np.ndarray:
    if task == REGRESSION:
        return margins[:, 0]
    return _chances(task, margins)[:, 0] if task == BINARY else np.argmax(margins, axis=1).astype(float)


def _chances(task: str, margins: np.ndarray) -> np.ndarray:
    if task == BINARY:
        return 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(task: str, label: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and second derivatives of the loss (the joint deviance for several classes)."""
    if task == REGRESSION:
        return label[:, None] - margins, np.ones_like(margins)
    p = _chances(task, margins)
    k = margins.shape[1]
    target = label[:, None] if task == BINARY else (label[:, None] == np.arange(k)[None, :]).astype(float)
    # Several classes share their margins: the usual factor k / (k - 1) on second derivatives.
    return target - p, p * (1 - p) * (k / (k - 1) if k > 1 else 1)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError("a feature is missing")
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper borders of all bins but the last, by column: quantiles, so each distinct value if there are few."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = rows.agg(
        *[F.percentile_approx(F.col("x")[i], shares, F.lit(100 * bins)).alias(f"q{i}") for i in range(width)],
        *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(width)],
    ).first()
    return [np.array(sorted({v for v in row[f"q{i}"] or [] if v < row[f"m{i}"]})) for i in range(width)]


def _prepare(batches, edges):
    for batch in batches:
        n = batch.num_rows
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges))
        bins = pa.array([r.tobytes() for r in _binned(x, edges)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("part"), bins], ["label", "part", "bins"])


def _matrix(column: pa.Array, dtype, shape: tuple) -> np.ndarray:
    """Binary values of one length, as one array without a step per row."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    first = int(np.frombuffer(ends, kind)[column.offset])
    count = int(np.prod(shape))
    return np.frombuffer(data, dtype, count, first).reshape(shape)


def _pieces(batches, width: int, shape: tuple[int, int]):
    """Label, part, number of rows, bins and margins (cells by model by output) of some cells at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            piece = whole.slice(at, _ROWS)
            n = piece.num_rows
            label, part, rows = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("label", "part", "n"))
            yield (
                piece, label, part, rows, _matrix(piece.column("bins"), np.uint8, (n, width)),
                _matrix(piece.column("margins"), np.float64, (n, *shape)),
            )


def _with_recent(margins, bins, recent, rates) -> np.ndarray:
    """Margins with the trees of the last rounds added."""
    total = margins.copy()
    for by_model in recent:
        for m, trees in enumerate(by_model):
            for k, tree in enumerate(trees):
                total[:, m, k] += rates[m] * tree.value[tree.nodes(bins)]
    return total


def _tables(batches, width, shape, bins_of, task, left_out, balance, growing):
    """Sums by model, output, node, feature and bin; only entries that have a row."""
    sums: dict[tuple[int, int], np.ndarray] = {
        key: np.zeros((len(nodes), width * bins_of, 3)) for key, (_, nodes) in growing.items()
    }
    for _, label, part, rows_of, bins, total in _pieces(batches, width, shape):
        place = bins.astype(np.int64) + np.arange(width)[None, :] * bins_of
        slopes = {}
        for (m, k), (tree, nodes) in growing.items():
            if m not in slopes:
                slope, curve = gradients(task, label, total[:, m])
                weight = rows_of if balance is None else rows_of * balance[m][label.astype(int)]
                slopes[m] = (slope * weight[:, None], curve * weight[:, None])
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            mine = slot[tree.nodes(bins)]
            rows = np.flatnonzero((mine >= 0) & (part != left_out[m]))
            if not len(rows):
                continue
            code = (mine[rows][:, None] * (width * bins_of) + place[rows]).ravel()
            for i, values in enumerate((slopes[m][0][rows, k], slopes[m][1][rows, k], rows_of[rows])):
                counted = np.bincount(code, np.repeat(values, width), len(nodes) * width * bins_of)
                sums[m, k][..., i] += counted.reshape(len(nodes), -1)
    columns = defaultdict(list)
    for (m, k), found in sums.items():
        node, pos = np.nonzero(found[..., 2])
        columns["model"].append(np.full(len(node), m)), columns["output"].append(np.full(len(node), k))
        columns["node"].append(np.array(growing[m, k][1], np.int64)[node]), columns["pos"].append(pos)
        for i, name in enumerate(("g", "h", "n")):
            columns[name].append(found[node, pos, i])
    if columns:
        kinds = {"g": np.float64, "h": np.float64, "n": np.float64}
        yield pa.RecordBatch.from_pydict(
            {c: pa.array(np.concatenate(v).astype(kinds.get(c, np.int32))) for c, v in columns.items()}
        )


def _renewed(batches, width, shape, rates, recent):
    for piece, _, _, _, bins, margins in _pieces(batches, width, shape):
        total = _with_recent(margins, bins, recent, rates)
        yield pa.RecordBatch.from_arrays(
            [*piece.columns[:4], pa.array([r.tobytes() for r in total], pa.binary())],
            ["label", "part", "n", "bins", "margins"],
        )


def _held(batches, width, shape, rates, recent, task, left_out, inner):
    """Answers of each model for the rows it did not learn from."""
    for _, label, part, rows, bins, margins in _pieces(batches, width, shape):
        total = _with_recent(margins, bins, recent, rates)
        for m in inner:
            own = np.flatnonzero(part == left_out[m])
            yield from _repeated(np.full(len(own), m, np.int32), label[own], _answers(task, total[own, m]), rows[own])


def _repeated(model, label, answer, rows):
    """A cell stands for that many rows; a large one comes out in several batches."""
    times = rows.astype(np.int64)
    while times.any():
        now = np.minimum(times, _ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(column, now)) for column in (model, label, answer)], ["model", "label", "answer"]
        )
        times = times - now


def _spread(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            piece = whole.slice(at, _ROWS)
            yield from _repeated(*(piece.column(c).to_numpy(zero_copy_only=False) for c in ("model", "label", "answer", "n")))


def _starts(counts, task, outputs, left_out, balanced) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Where each model's margins start, and its weights of the two classes."""
    starts, balance = [], []
    for j in left_out:
        own = [(r["label"], r["n"], r["s"]) for r in counts if r["part"] != j]
        n = sum(x[1] for x in own)
        if not n:
            raise ValueError("no rows to train on")
        if task == REGRESSION:
            starts.append([sum(x[2] for x in own) / n])
            continue
        by_class = np.array([sum(x[1] for x in own if x[0] == c) for c in range(max(outputs, 2))], float)
        if task == BINARY:
            weights = n / (2 * np.maximum(by_class, 1)) if balanced else np.ones(2)
            balance.append(weights)
            share = by_class * weights + 1e-9
            starts.append([np.log(share[1] / share[0])])
        else:
            starts.append(list(np.log(np.maximum(by_class, 1e-9) / n)))
    return np.array(starts, float), balance if balanced and task == BINARY else None


def _merged(rows: DataFrame, edges: list[np.ndarray], task: str, searched: bool) -> DataFrame:
    """``label, part, n, bins`` of the rows that agree."""
    binned = rows.select("label", "part", "x").mapInArrow(
        partial(_prepare, edges=edges), "label double, part int, bins binary"
    )
    # Without a search no part is left out; the squared error then needs nothing of a cell but its mean.
    keys = ["bins", "label", "part"] if searched else ["bins"] if task == REGRESSION else ["bins", "label"]
    known = binned.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *([] if "label" in keys else [F.avg("label").alias("label")]),
        *([] if "part" in keys else [F.lit(0).alias("part")]),
    )
    return materialise(known.select("label", "part", "n", "bins"))


def _cells(found: DataFrame, count: int, start: np.ndarray) -> tuple[DataFrame, int]:
    """The ``count`` cells with their margins, in as many tasks as these are worth; and the number of tasks."""
    limit = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-count * start.size // _TASK_MARGINS))
    # Cells are dealt by a hash, so that tasks are alike; beyond the usual number of tasks they only get larger.
    tasks = min(tasks, max(limit, found.rdd.getNumPartitions()))
    dealt = found.repartition(tasks, "bins", "label").withColumn("margins", F.lit(bytearray(start.tobytes())))
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), tasks


def _scanned(state: DataFrame, tasks: int, asked: dict, width: int, bins: int, known: dict) -> dict:
    """The tables of all nodes that are asked for, by model and output, then by node."""
    scan = partial(_tables, width=width, bins_of=bins, growing=asked, **known)
    cells = state.mapInArrow(scan, "model int, output int, node int, pos int, g double, h double, n double")
    keys = ["model", "output", "node", "pos"]
    if tasks > _FEW_TASKS:
        cells = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    found = cells.toArrow()
    m, k, node, pos = (found.column(c).to_numpy().astype(np.int64) for c in keys)
    place = {key: i for i, key in enumerate((*pair, n) for pair, (_, nodes) in asked.items() for n in nodes)}
    most = [max(key[i] for key in place) + 1 for i in range(3)]
    slot = np.zeros(most, np.int64)
    for key, i in place.items():
        slot[key] = i
    at = slot[m, k, node] * (width * bins) + pos
    size = len(place) * width * bins
    tables = np.stack([np.bincount(at, found.column(c).to_numpy(), size) for c in ("g", "h", "n")], axis=-1)
    tables = tables.reshape(len(place), width, bins, 3)
    return {pair: {n: tables[place[(*pair, n)]] for n in nodes} for pair, (_, nodes) in asked.items()}


def _fit_by_scans(found: DataFrame, count: int, models, trees: int, start: np.ndarray, width: int, bins: int, known: dict):
    """The trees by round, model and output; answers for the rows left out; and what is to be let go at last."""
    shape, outputs, rates = start.shape, start.shape[1], [g.rate for g, _ in models]
    state, tasks = _cells(found, count, start)
    kinds = "label double, part int, n double, bins binary, margins binary"
    made: list[list[list[Tree]]] = []
    recent: list[list[list[Tree]]] = []
    for number in range(trees):
        kept = state
        if recent:
            renew = partial(_renewed, width=width, shape=shape, rates=rates, recent=recent)
            state = state.mapInArrow(renew, kinds)
            # The plan is cut now and then; between, the first scan of the round fills the memory.
            state = (materialise(state) if number % RENEW == 0 else state).persist(StorageLevel.MEMORY_AND_DISK)
        growing = {(m, k): Growing(g) for m, (g, _) in enumerate(models) for k in range(outputs)}
        while todo := {key: t for key, t in growing.items() if t.done is None}:
            asked = {key: (t.tree(), [w[0] for w in t.waiting]) for key, t in todo.items()}
            tables = _scanned(state, tasks, asked, width, bins, known)
            if kept is not state:
                kept.unpersist()
                kept = state
            for key, t in todo.items():
                t.receive(tables[key], (width, bins))
        recent = [[[growing[m, k].done for k in range(outputs)] for m in range(len(models))]]
        made += recent
    inner = [m for m, (_, j) in enumerate(models) if j >= 0]
    answers = partial(
        _held, width=width, shape=shape, rates=rates, recent=recent, task=known["task"], left_out=known["left_out"], inner=inner
    )
    return made, state.mapInArrow(answers, "model int, label double, answer double"), state


@dataclass(frozen=True)
class _HeldCells:
    """All cells in a task: the bins that occur, and of each cell its row of these, label, part and number of rows."""

    bins: np.ndarray
    at: np.ndarray
    label: np.ndarray
    part: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(table: pa.Table, width: int) -> _HeldCells:
        cells = np.concatenate([_matrix(b.column("bins"), np.uint8, (b.num_rows, width)) for b in table.to_batches()])
        occurring, at = np.unique(cells.view(f"V{width}").ravel(), return_inverse=True)
        label, part, rows = (table.column(c).to_numpy() for c in ("label", "part", "n"))
        # In one order, whichever way the cells came in: sums then come out alike.
        order = np.lexsort((part, label, at))
        return _HeldCells(occurring.view(np.uint8).reshape(-1, width), at[order], label[order], part[order], rows[order])

    def boosted(self, task: str, growth: Growth, left_out: int, trees: int, start, balance, bins: int) -> list[list[Tree]]:
        """The trees by round and output of the model that does not learn from the part ``left_out``."""
        own = np.flatnonzero(self.part != left_out)
        used, at = np.unique(self.at[own], return_inverse=True)
        label, rows = self.label[own], self.rows[own]
        weight = rows if balance is None else rows * balance[label.astype(int)]

        def total(values):
            return np.bincount(at, values, len(used))

        k = len(start)
        if task == MULTICLASS:
            aims = np.column_stack([total(weight * (label == c)) for c in range(k)])
        else:
            aims = total(weight * label)[:, None]
        n, weights = total(rows), total(weight)[:, None]
        cells, margins = self.bins[used], np.tile(np.asarray(start, float), (len(used), 1))
        made = []
        for _ in range(trees):
            # Sums over the rows of a cell, which have one margin.
            if task == REGRESSION:
                slope, curve = aims - weights * margins, np.broadcast_to(weights, margins.shape)
            else:
                p = _chances(task, margins)
                slope, curve = aims - weights * p, weights * p * (1 - p) * (k / (k - 1) if k > 1 else 1)
            grown = [_grown(growth, cells, np.stack([slope[:, c], curve[:, c], n]), bins) for c in range(k)]
            for c, (_, values) in enumerate(grown):
                margins[:, c] += growth.rate * values
            made.append([tree for tree, _ in grown])
        return made


def _grown(growth: Growth, cells: np.ndarray, sums: np.ndarray, bins: int) -> tuple[Tree, np.ndarray]:
    """A tree on cells with these sums (gradient, second derivative, rows), and its value for each cell."""
    width = cells.shape[1]
    offset = np.arange(width) * bins
    step = max(1, _ENTRIES // width)

    def table(own):
        out = np.zeros((width * bins, 3))
        for low in range(0, len(own), step):
            some = own[low : low + step]
            place = (cells[some] + offset).ravel()
            for i in range(3):
                out[:, i] += np.bincount(place, np.repeat(sums[i, some], width), width * bins)
        return out.reshape(width, bins, 3)

    growing = Growing(growth, ahead=1)
    rows = {0: np.arange(len(cells))}

    def part(node: int) -> None:
        """Deal the cells of a node to its children."""
        if node in rows:
            _, feature, cut = growing.nodes[node].best
            own, pair = rows.pop(node), growing.nodes[node].children
            left = cells[own, feature] <= cut
            rows[pair[0]], rows[pair[1]] = own[left], own[~left]

    while growing.done is None:
        for _, _, parent in growing.waiting:
            if parent is not None:
                part(parent)
        growing.receive({w[0]: table(rows[w[0]]) for w in growing.waiting}, (width, bins))
    tree, values, open_nodes = growing.done, np.zeros(len(cells)), [0]
    while open_nodes:
        node = open_nodes.pop()
        if tree.feature[node] < 0:
            values[rows[node]] = tree.value[node]
        else:
            part(node)
            open_nodes += growing.nodes[node].children
    return tree, values


def _fitted(batches, shared, order, models, trees, start, bins, known):
    """Trees of each model, and its answers for the cells it did not learn from."""
    names = ["model", "trees", "label", "answer", "n"]
    kinds = [pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    for batch in batches:
        for number in batch.column(0).to_pylist():
            m, cells = order[number], shared.value
            growth, left_out = models[m]
            balance = None if known["balance"] is None else known["balance"][m]
            made = cells.boosted(known["task"], growth, left_out, trees, start[m], balance, bins)
            first = [pa.array(v, kind) for v, kind in zip(([m], [pickle.dumps(made)], [None], [None], [None]), kinds)]
            yield pa.RecordBatch.from_arrays(first, names)
            own = np.flatnonzero(cells.part == left_out)
            for low in range(0, len(own), _ROWS):
                some = own[low : low + _ROWS]
                place, back = np.unique(cells.at[some], return_inverse=True)
                margins = np.tile(np.asarray(start[m], float), (len(place), 1))
                for row in made:
                    for c, tree in enumerate(row):
                        margins[:, c] += growth.rate * tree.value[tree.nodes(cells.bins[place])]
                answers = _answers(known["task"], margins)[back]
                values = (np.full(len(some), m), [None] * len(some), cells.label[some], answers, cells.rows[some])
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)], names)


def _fit_held(found: DataFrame, count: int, models, trees: int, start: np.ndarray, width: int, bins: int, known: dict):
    """As ``_fit_by_scans``, a task for each model; each holds all cells."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(_HeldCells.of(found.toArrow(), width))
    # The longest first: large trees, on all parts.
    order = sorted(range(len(models)), key=lambda m: (-(models[m][0].max_leaves or 2 ** (models[m][0].max_depth or 30)), models[m][1]))
    work = partial(_fitted, shared=shared, order=order, models=models, trees=trees, start=start, bins=bins, known=known)
    fitted = materialise(
        spark.range(0, len(models), 1, len(models)).mapInArrow(
            work, "model int, trees binary, label double, answer double, n double"
        )
    )
    shared.unpersist()
    by_model = {r["model"]: pickle.loads(r["trees"]) for r in fitted.where("trees IS NOT NULL").select("model", "trees").collect()}
    made = [[by_model[m][number] for m in range(len(models))] for number in range(trees)]
    answers = fitted.where("trees IS NULL").select("model", "label", "answer", "n")
    return made, answers.mapInArrow(_spread, "model int, label double, answer double"), fitted


def fit_boosting(
    rows: DataFrame, task: str, outputs: int, growths: list[Growth], trees: int, balanced: bool = False,
    bins: int = MAX_BINS, rounds: list | None = None,
) -> BoostedModel:
    """Boost ``trees`` rounds for every candidate of ``growths``; of several the best over the inner folds is kept.

    ``rows`` has ``label`` (a number, or that of the class), ``part`` (inner fold) and features ``x``. ``outputs`` is
    the number of classes if there are more than two, else 1. ``rounds``, where given, collects the models' trees.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to train on")
    width = first[0]
    parts = [*range(INNER_FOLDS), -1] if len(growths) > 1 else [-1]
    models = [(g, j) for g in growths for j in parts]
    left_out = [j for _, j in models]
    label = F.lit(0.0) if task == REGRESSION else F.col("label")
    counts = rows.groupBy("part", label.alias("label")).agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()
    start, balance = _starts(counts, task, outputs, left_out, balanced)
    edges = _edges(rows, width, bins)
    found = _merged(rows, edges, task, len(growths) > 1)
    count = found.count()
    fit = _fit_held if len(growths) > 1 and count * (width + _CELL_BYTES) <= _HELD_BYTES else _fit_by_scans
    known = dict(shape=start.shape, task=task, left_out=left_out, balance=balance)
    made, held, state = fit(found, count, models, trees, start, width, bins, known)
    best = 0
    if len(growths) > 1:
        metric = {REGRESSION: r2_score, BINARY: average_precision, MULTICLASS: accuracy_score}[task]
        scores = {r["model"]: r["score"] for r in metric(held, "label", "answer", ["model"]).collect()}
        inner = [m for m, j in enumerate(left_out) if j >= 0]
        means = []
        for c in range(len(growths)):
            own = [scores.get(m) for m in inner if m // len(parts) == c]
            known = [s for s in own if s is not None]
            # A candidate without a score must not win.
            means.append(np.mean(known) if known else -np.inf)
        best = int(np.argmax(np.round(means, 12))) * len(parts) + INNER_FOLDS
    state.unpersist()
    if rounds is not None:
        rounds.extend(made)
    return BoostedModel(
        task, [r[best] for r in made], start[best], models[best][0].rate, edges, models[best][0]
    )


def candidates(growth: Growth, grid: dict[str, tuple]) -> list[Growth]:
    """A growth for each combination of searched values: ``stepSize``, ``numLeaves`` and ``maxDepth``."""
    names = {"stepSize": "rate", "numLeaves": "max_leaves", "maxDepth": "max_depth"}
    known = {f: getattr(growth, f) for f in growth.__dataclass_fields__}
    keys = [names[k] for k in grid]
    return [Growth(**{**known, **dict(zip(keys, values))}) for values in product(*grid.values())]
