"""Repeated train/test splits that depend only on row keys."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import SPLIT_SEED, key_hash
from tenc.operators.rank import hash_cuts
from tenc.session import written


@dataclass(frozen=True)
class SplitPlan:
    """The cut-off hash of every fold (and class): a row is a test row up to that hash.

    A few texts are all there is to keep. Rows are marked by an expression over their own key,
    so a fold needs neither a join nor a copy of the data.
    """

    key: str | list[str]
    seed: int
    cuts: tuple[dict[str, str], ...]
    y: str | None = None

    @property
    def n_splits(self) -> int:
        return len(self.cuts)

    def _cut(self, fold: int) -> Column:
        cuts = self.cuts[fold]
        if self.y is None:
            return F.lit(cuts.get(""))
        pairs = [F.lit(x) for item in sorted(cuts.items()) for x in item]
        if not pairs:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*pairs), quoted(self.y).cast("string"))

    def is_test(self, fold: int) -> Column:
        within = key_hash(self.key, self.seed, fold) <= self._cut(fold)
        return F.coalesce(within, F.lit(False))

    def mark(self, df: DataFrame, fold: int) -> DataFrame:
        """``df`` with ``is_test`` for one fold."""
        return df.withColumn("is_test", self.is_test(fold))

    def all_folds(self, df: DataFrame) -> DataFrame:
        """``df`` once per fold with ``fold`` and ``is_test``."""
        marks = F.posexplode(F.array(*[self.is_test(i) for i in range(self.n_splits)]))
        return df.select(*[quoted(c) for c in df.columns], marks.alias("fold", "is_test"))

    def test_rows(self, df: DataFrame) -> DataFrame:
        """The test rows of all folds, with ``fold``."""
        return self.all_folds(df).where("is_test").drop("is_test")


def _hashed(df: DataFrame, key: str | list[str], n_splits: int, seed: int, *keep: str) -> DataFrame:
    """``keep``, ``fold`` and ``_hash`` for every fold; each hash is computed a single time."""
    hashes = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), key_hash(key, seed, i).alias("_hash"))
            for i in range(n_splits)
        ]
    )
    return df.select(*keep, F.inline(hashes))


def plan_shuffle_split(
    df: DataFrame, key: str | list[str], n_splits: int = 20, test_size: float = 1 / 3,
    seed: int = SPLIT_SEED,
) -> SplitPlan:
    """Folds with exactly ``ceil(n * test_size)`` test rows."""
    n = df.count()
    take = ceil(n * test_size - 1e-9)
    sizes = df.sparkSession.createDataFrame(
        [(fold, n, take) for fold in range(n_splits)], "fold int, n long, take long"
    )
    rows = _hashed(df, key, n_splits, seed)
    found = {r["fold"]: r["cut"] for r in hash_cuts(rows, ["fold"], sizes).collect()}
    return SplitPlan(
        key, seed, tuple({"": found[i]} if i in found else {} for i in range(n_splits))
    )


def shuffle_split(
    df: DataFrame, key: str | list[str], n_splits: int = 20, test_size: float = 1 / 3,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """``df`` once per fold, with ``is_test`` on exactly ``ceil(n * test_size)`` rows."""
    return plan_shuffle_split(df, key, n_splits, test_size, seed).all_folds(df)


def class_sizes(df: DataFrame, y: str, test_size: float) -> DataFrame:
    """``class, n, take``: test rows per class, adding up to ``ceil(n * test_size)``.

    Training sizes are proportional; the rows lost to rounding go to the largest remainders
    (ties to the smaller class name).
    """
    label = quoted(y).cast("string")
    counts = (
        df.where(label.isNotNull())
        .groupBy(label.alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per class from here on.
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    n_train = total - F.ceil(total * F.lit(float(test_size)) - F.lit(1e-9))
    shares = counts.withColumns({"_total": total, "_train": n_train}).withColumns(
        {
            "_whole": F.floor(F.col("n") * F.col("_train") / F.col("_total")),
            "_part": (F.col("n") * F.col("_train")) % F.col("_total"),
        }
    )
    left = F.col("_train") - F.sum("_whole").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("_part"), "class"))
    train = F.col("_whole") + F.when(place <= left, 1).otherwise(0)
    return shares.select("class", "n", (F.col("n") - train).cast("long").alias("take"))


def plan_stratified_split(
    df: DataFrame, key: str | list[str], y: str, n_splits: int = 20, test_size: float = 1 / 3,
    seed: int = SPLIT_SEED,
) -> SplitPlan:
    """Folds that keep the class shares; a class is a label, so there are few of them."""
    per_class = class_sizes(df, y, test_size).collect()
    sizes = df.sparkSession.createDataFrame(
        [(fold, r["class"], r["n"], r["take"]) for fold in range(n_splits) for r in per_class],
        "fold int, _class string, n long, take long",
    )
    groups = ["fold", "_class"]
    named = df.withColumn("_class", quoted(y).cast("string"))
    rows = _hashed(named, key, n_splits, seed, "_class")
    cuts: tuple[dict[str, str], ...] = tuple({} for _ in range(n_splits))
    for r in hash_cuts(rows, groups, sizes).collect():
        cuts[r["fold"]][r["_class"]] = r["cut"]
    return SplitPlan(key, seed, cuts, y)


# Rows whose digests by all folds one task should make at most, on average.
ROWS_A_TASK = 500_000


def _bound(share: float) -> str:
    # The first eight hex digits of a share of the hash range; past the end, a larger text.
    return "g" if share >= 1 else f"{floor(max(share, 0.0) * (1 << 32)):08x}"


def _by_class(values: dict[str, Column], y: str | None) -> Column:
    """The value of a row's class; null without one."""
    if y is None:
        return values[""]
    if not values:
        return F.lit(None)
    pairs = [x for name in sorted(values) for x in (F.lit(name), values[name])]
    return F.try_element_at(F.create_map(*pairs), quoted(y).cast("string"))


def marked_split(
    df: DataFrame, key: str | list[str], n_splits: int = 20, test_size: float = 1 / 3, seed: int = SPLIT_SEED,
    y: str | None = None, name: str = "is_test_of", width: float = 6.0,
) -> tuple[SplitPlan, DataFrame]:
    """The plan of ``plan_shuffle_split`` (with ``y``: ``plan_stratified_split``), and ``df`` with an array of its marks, ``name``.

    Both come from one digest for each row and fold. Hashes are uniform, so a cut lies within a narrow window around
    its share of the hash range. The rows are written with a mark for each fold, which is null inside the window; the
    marks below it are counted, and only the open rows are digested again. Should a cut lie outside the window, the plan is
    made by itself. ``df`` is read twice (its size, then its rows), so it should be stored. Keys must be unique.
    Narrow rows take few bytes, so they are dealt out by number: later scans of them have work for every core.
    """
    n = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(n / ROWS_A_TASK))
    if y is None:
        sizes = {"": (n, ceil(n * test_size - 1e-9))}
    else:
        sizes = {r["class"]: (r["n"], r["take"]) for r in class_sizes(df, y, test_size).collect()}
    sizes = {c: (n, take) for c, (n, take) in sizes.items() if take > 0}
    half = {c: width * (sqrt(t / n * (1 - t / n) / n) + 2 / n) for c, (n, t) in sizes.items()}
    low = _by_class({c: F.lit(_bound(t / n - half[c])) for c, (n, t) in sizes.items()} or {"": F.lit("")}, y)
    high = _by_class({c: F.lit(_bound(t / n + half[c])) for c, (n, t) in sizes.items()} or {"": F.lit("")}, y)
    digests = F.array(*[key_hash(key, seed, i) for i in range(n_splits)])
    marks = F.array(*[
        F.when(F.col("_digests")[i] < F.col("_low"), F.lit(True)).when(F.col("_digests")[i] < F.col("_high"), F.lit(None))
        .otherwise(F.lit(False)) for i in range(n_splits)
    ])
    keys = [key] if isinstance(key, str) else list(key)
    dealt = df.repartition(tasks, *[quoted(k) for k in keys])
    stored = written(
        dealt.withColumns({"_low": low, "_high": high, "_digests": digests})
        .withColumn(name, marks).drop("_low", "_high", "_digests")
        .withColumn("_open", F.exists(name, lambda m: m.isNull())),
        "marked-rows",
    )
    group = (F.lit("") if y is None else quoted(y).cast("string")).alias("_class")
    below = stored.groupBy(group).agg(*[F.count_if(F.col(name)[i]).alias(f"n{i}") for i in range(n_splits)]).collect()
    counted = {r["_class"]: r for r in below}
    wanted = [(c, i, t - counted[c][f"n{i}"]) for c, (_, t) in sizes.items() for i in range(n_splits)]
    cuts: tuple[dict[str, str], ...] = tuple({} for _ in range(n_splits))
    if wanted and all(take > 0 for *_, take in wanted):
        digest = key_hash(key, seed, F.col("_fold")).alias("_cut")
        near = (
            stored.where("_open").select(group, *[quoted(k) for k in keys], F.posexplode(name).alias("_fold", "_mark"))
            .where("_mark is null").groupBy("_class", "_fold", digest).agg(F.count(F.lit(1)).alias("_n"))
        )
        # About sqrt(n) rows a fold and class.
        order = Window.partitionBy("_class", "_fold").orderBy("_cut")
        places = df.sparkSession.createDataFrame(wanted, "_class string, _fold int, _take long")
        reached = (F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take"))
        found = (
            near.join(F.broadcast(places), ["_class", "_fold"]).withColumn("_upto", F.sum("_n").over(order))
            .where(reached).select("_class", "_fold", "_cut", (F.col("_upto") > F.col("_take")).alias("_tied")).collect()
        )
        if any(r["_tied"] for r in found):
            raise ValueError("rows share a key: their order is not settled, so no exact cut exists")
        for r in found:
            cuts[r["_fold"]][r["_class"]] = r["_cut"]
    if sum(map(len, cuts)) == len(wanted):
        plan = SplitPlan(key, seed, cuts, y)
    elif y is None:
        plan = plan_shuffle_split(df, key, n_splits, test_size, seed)
    else:
        plan = plan_stratified_split(df, key, y, n_splits, test_size, seed)
    own = _by_class({c: F.array(*[F.lit(plan.cuts[i][c]) for i in range(n_splits)]) for c in sizes} or {"": F.lit(None)}, y)
    # A cut outside the window also settles marks that look settled.
    known = plan.cuts is cuts
    settled = F.transform(
        name,
        lambda m, i: F.coalesce(m if known else F.lit(None).cast("boolean"), key_hash(key, seed, i) <= F.get("_cuts", i), F.lit(False)),
    )
    chosen = F.when(F.col("_open"), settled).otherwise(F.col(name)) if known else settled
    rows = stored.withColumn("_cuts", own).withColumn(name, chosen)
    return plan, rows.select(*[quoted(c) for c in df.columns], name)


def stratified_split(
    df: DataFrame, key: str | list[str], y: str, n_splits: int = 20, test_size: float = 1 / 3,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Like ``shuffle_split`` with the class shares kept in every fold."""
    return plan_stratified_split(df, key, y, n_splits, test_size, seed).all_folds(df)


def fold_target_stats(
    df: DataFrame, test: DataFrame, column: str, y: str, n_splits: int
) -> DataFrame:
    """``fold, category, n, s``: rows and sum of y over the training part of every fold.

    ``test`` holds the test rows of all folds of ``df``. Only these are aggregated fold by fold;
    the training part is the category's total minus its test part.
    """
    category = quoted(column).cast("string").alias("category")
    value = quoted(y).cast("double")
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    totals = (
        df.groupBy(category)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
        .withColumn("fold", folds)
    )
    left_out = test.groupBy("fold", category).agg(
        F.count(F.lit(1)).alias("_tn"), F.sum(value).alias("_ts")
    )
    return (
        totals.join(left_out, ["fold", "category"], "left")
        .select(
            "fold",
            "category",
            (F.col("_n") - F.coalesce("_tn", F.lit(0))).alias("n"),
            (F.col("_s") - F.coalesce("_ts", F.lit(0.0))).alias("s"),
        )
        .where("n > 0")
    )
