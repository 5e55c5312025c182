"""The features of all folds at once.

The statistics of a category in the training part of a fold are its totals less those of its test rows. So one
aggregate by category, with a sum for each fold, holds the encodings of all folds (a cube of categories
by folds), and one join carries them to the rows. The rows are written once, each with an array of its encoded
values by fold, and every fold's model reads its place in that array.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import SPLIT_SEED
from tenc.operators.encoders.heldout import add_noise, fold_of
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION, FeatureMeta
from tenc.operators.lookup import lookup
from tenc.operators.prepare import DELETE, ONE_HOT, resolve_roles
from tenc.operators.profile import one_hot_guard
from tenc.operators.splits import SplitPlan
from tenc.plans.registry import ENCODERS, FoldRule, resolve
from tenc.session import written

# Feature columns beyond which matrices of all folds would grow too large; such runs go fold by fold.
MAX_WIDTH = 256
INNER_FOLDS = 3
# Holds for each fold whether a row is a test row.
MARKS = "_test_of_folds"


@dataclass(frozen=True)
class FoldRows:
    """Rows with ``label``, inner fold ``part``, ``shared`` features, ``test`` by fold, and ``e0, e1, ...``.

    ``e0, ...`` are encoded columns, each an array of fold by output. The label of several classes is
    the number of the class. ``classes`` is empty for numbers and two classes.
    """

    rows: DataFrame
    n_folds: int
    n_shared: int
    outputs: tuple[int, ...]
    classes: tuple[str, ...] = ()
    # Whether a shared column is a 0/1 flag of a category.
    flags: tuple[bool, ...] = ()
    # Near the means of columns and label, where they are known without reading the rows.
    centres: tuple[float, ...] | None = None

    @property
    def width(self) -> int:
        return self.n_shared + sum(self.outputs)


def _labels(df: DataFrame, y: str) -> tuple[str, ...]:
    # One class is one column of every multiclass result, so the classes fit on the driver.
    text = quoted(y).cast("string")
    return tuple(r[0] for r in df.select(text.alias("c")).where("c is not null").distinct().orderBy("c").collect())


def _cube(base: DataFrame, category: str, n_folds: int, n_classes: int) -> DataFrame:
    """``category``, ``total``, training rows ``n`` by fold and target ``sums`` by output and fold, written once."""
    folds = range(n_folds)
    out = [F.when(F.col("test")[i], F.lit(1)).otherwise(F.lit(0)) for i in folds]
    by = [F.col(category).alias("category")]
    if not n_classes:
        left_out = [F.sum(F.col("label") * out[i]) for i in folds]
        grouped = base.groupBy(*by).agg(
            F.count("*").alias("total"), F.sum("label").alias("s"),
            F.array(*[F.sum(o) for o in out]).alias("tn"), F.array(*left_out).alias("ts"),
        )
        n = F.transform("tn", lambda t: (F.col("total") - t).cast("double"))
        return written(
            grouped.select("category", "total", n.alias("n"), F.array(F.transform("ts", lambda t: F.col("s") - t)).alias("sums")),
            "cube",
        )
    by_class = base.groupBy(*by, "label").agg(
        F.count("*").alias("m"), F.array(*[(F.count("*") - F.sum(o)).cast("double") for o in out]).alias("k")
    )
    grouped = by_class.groupBy("category").agg(
        F.sum("m").alias("total"), F.array(*[F.sum(F.col("k")[i]) for i in folds]).alias("n"),
        F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "k"))).alias("of"),
    )
    nothing = F.array_repeat(F.lit(0.0), n_folds)
    sums = F.array(*[F.coalesce(F.try_element_at("of", F.lit(c)), nothing) for c in range(n_classes)])
    return written(grouped.select("category", "total", "n", sums.alias("sums")), "cube")


def _totals(cube: DataFrame, n_folds: int, outputs: int) -> tuple[list[tuple[float, int, list[float]]], int, int, float]:
    """Training rows, observed categories and priors of every fold, categories, the longest one's bytes, and a row's mean ``n``.

    One row reaches the driver.
    """
    row = cube.agg(
        F.array(*[F.sum(F.col("n")[i]) for i in range(n_folds)]).alias("n"),
        F.array(*[F.count_if((F.col("n")[i] > 0) & F.col("category").isNotNull()) for i in range(n_folds)]).alias("k"),
        F.array(
            *[F.array(*[F.sum(F.col("sums")[c][i]) for c in range(outputs)]) for i in range(n_folds)]
        ).alias("s"),
        F.count("category").alias("rows"), F.max(F.octet_length("category")).alias("longest"),
        F.try_divide(F.sum(F.col("total") * F.col("n")[0]), F.sum("total")).alias("mean_n"),
    ).first()
    n = row["n"] or [0.0] * n_folds
    found = [
        (n[i] or 0.0, row["k"][i], [(s or 0.0) / n[i] if n[i] else 0.0 for s in row["s"][i]]) for i in range(n_folds)
    ]
    return found, row["rows"] or 0, row["longest"] or 0, row["mean_n"] or 0.0


def _encoded(rule: FoldRule, folds, outputs: int, own: bool) -> Column:
    """Values by fold and output, from ``n`` and ``sums`` of a category (null where it was never seen)."""
    values = []
    for i, (n_rows, k, priors) in enumerate(folds):
        n = F.coalesce(F.col("n")[i], F.lit(0.0))
        for c in range(outputs):
            prior = F.lit(priors[c])
            total = F.coalesce(F.col("sums")[c][i], F.lit(0.0))
            if rule.kind == "count":
                values.append(n)
                continue
            mean = F.try_divide(total, n)
            if rule.kind == "left_out":
                y = (F.col("label") == c).cast("double") if outputs > 1 else F.col("label")
                left = F.when(n > 1, (total - y) / (n - 1))
                values.append(F.coalesce(F.when(F.col("test")[i], mean).otherwise(left), prior))
                continue
            weight = rule.shrinkage.weight(n, FeatureMeta("", n_rows, k, 0, 0))
            values.append(F.when(n > 0, weight * mean + (1 - weight) * prior).otherwise(prior))
    return F.array(*values)


def marked(df: DataFrame, split: SplitPlan) -> DataFrame:
    """``df`` with its folds' marks, written once: a mark costs a digest of the key for each fold."""
    if MARKS in df.columns:
        return df
    marks = F.array(*[split.is_test(i) for i in range(split.n_splits)])
    return written(df.withColumn(MARKS, marks), "marked-rows")


def build(
    df: DataFrame, split: SplitPlan, roles: Mapping[str, str], encoder: str, task: str, y: str, key: str,
    one_hot_limit: int | None = None,
) -> FoldRows | None:
    """All folds' features of a prepared table, or None if an encoder or the width does not allow it.

    Models of classes read the features many times, so they are written. Those of numbers read them once.
    """
    columns = resolve_roles(roles)
    actions = {c: resolve(roles[c], encoder) for c in columns.features}
    used = {c: a for c, a in actions.items() if a != DELETE}
    if not used:
        raise ValueError("no feature column is left")
    rules = {c: ENCODERS[a].fold_rule for c, a in used.items() if a in ENCODERS}
    if any(r is None for r in rules.values()):
        return None
    hot = [c for c, a in used.items() if a in ONE_HOT]
    if hot:
        limit = MAX_WIDTH if one_hot_limit is None else min(one_hot_limit, MAX_WIDTH)
        if one_hot_guard(df.select(*[quoted(c).alias(f"h{i}") for i, c in enumerate(hot)]), [f"h{i}" for i in range(len(hot))], limit).where("skip_one_hot").count():
            return None
    classes = _labels(df, y) if task == MULTICLASS else ()
    label = quoted(y).cast("double")
    if classes:
        label = (F.array_position(F.array(*[F.lit(c) for c in classes]), quoted(y).cast("string")) - 1).cast("double")
    shared, flags = [], []
    for c, action in used.items():
        if action in ONE_HOT:
            # At most MAX_WIDTH values, as just checked.
            values = [r[0] for r in df.select(quoted(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").collect()]
            shared += [quoted(c).cast("string").eqNullSafe(F.lit(v)).cast("double") for v in values]
            flags += [True] * len(values)
        elif c not in rules:
            shared.append(quoted(c).cast("double"))
            flags.append(False)
    outputs = len(classes) or 1
    if len(shared) + outputs * len(rules) > MAX_WIDTH:
        return None
    n_folds = split.n_splits
    base = marked(df, split).where(quoted(y).isNotNull()).select(
        quoted(key).alias("key"), label.alias("label"), fold_of(key, INNER_FOLDS).alias("part"),
        (F.array(*shared) if shared else F.array().cast("array<double>")).alias("shared"),
        F.col(MARKS).alias("test"),
        *[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(rules)],
    )
    rows = base
    sizes, means = [], []
    for i, rule in enumerate(rules.values()):
        cube = _cube(base, f"c{i}", n_folds, len(classes))
        folds, n_categories, longest, mean_n = _totals(cube, n_folds, outputs)
        size = 1 if rule.kind == "count" else outputs
        # Encoded targets lie about their prior.
        means += [mean_n] if rule.kind == "count" else folds[0][2]
        row_bytes = longest + 8 * n_folds * (outputs + 1) + 64
        known = cube.where("category is not null")
        if rule.kind == "left_out":
            table, values = known, ["n", "sums"]
        else:
            table, values = known.select("category", "total", _encoded(rule, folds, size, False).alias("enc")), ["enc"]
        joined = lookup(
            rows, table, [F.col(f"c{i}")], ["category"], values, row_bytes * n_categories, "total",
            int(sum(f[0] for f in folds)) // max(n_folds, 1), row_bytes,
        )
        if rule.kind == "left_out":
            found = _encoded(rule, folds, size, True)
        else:
            priors = F.array(*[F.lit(p if rule.kind != "count" else 0.0) for f in folds for p in f[2][:size]])
            found = F.coalesce("enc", priors)
        if rule.noise:
            found = F.transform(found, lambda v: add_noise(v, "key", rule.noise, SPLIT_SEED))
        rows = joined.withColumn(f"e{i}", found).drop(*values, f"c{i}")
        sizes.append(size)
    rows = rows.select("key", "label", "part", "shared", "test", *[f"e{i}" for i in range(len(rules))])
    if task != REGRESSION:
        return FoldRows(written(rows, "fold-features"), n_folds, len(shared), tuple(sizes), classes, tuple(flags))
    plain = [F.avg(F.col("shared")[i]).alias(f"m{i}") for i in range(len(shared))]
    *own, middle = (x or 0.0 for x in base.agg(*plain, F.avg("label").alias("label")).first())
    return FoldRows(rows, n_folds, len(shared), tuple(sizes), classes, tuple(flags), (*own, *means, middle))
