"""Encodings that keep a row's own target out: leave-one-out and out-of-fold, plus noise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import SPLIT_SEED, hash_word, key_hash, standard_normal
from tenc.operators.encoders.stats import BINARY, MULTICLASS, CategoryStats, fit_stats
from tenc.operators.lookup import lookup
from tenc.session import materialise


def add_noise(encoded: Column, key: str | list[str], level: float, seed: int) -> Column:
    """Multiply by ``1 + level * z`` with one standard normal ``z`` per row key."""
    if not level:
        return encoded
    return encoded * (F.lit(1.0) + F.lit(level) * standard_normal(key_hash(key, seed)))


@dataclass(frozen=True)
class LeaveOneOutEncoding:
    """Training rows get the mean of the other rows of their category; new rows the full mean."""

    stats: CategoryStats
    y: str
    noise: float = 0.0
    key: str | None = None
    seed: int = SPLIT_SEED
    fill: str = "prior"

    def apply_training(
        self, df: DataFrame, suffix: str = "_enc", broadcast_bytes: int | None = None
    ) -> DataFrame:
        return self._apply(df, suffix, True, broadcast_bytes)

    def apply(
        self, df: DataFrame, suffix: str = "_enc", broadcast_bytes: int | None = None
    ) -> DataFrame:
        return self._apply(df, suffix, False, broadcast_bytes)

    def _apply(
        self, df: DataFrame, suffix: str, training: bool, broadcast_bytes: int | None
    ) -> DataFrame:
        stats = self.stats
        for meta in stats.features:
            names = stats.output_names(meta.name, suffix)
            joined = lookup(
                df, stats.table(meta.name).withColumn("_n", F.col("n")),
                [quoted(meta.name).cast("string")], ["category"], ["_n", "sums"],
                meta.table_bytes, "n", meta.n_rows, meta.row_bytes, broadcast_bytes,
            )
            kept = [quoted(c) for c in df.columns]
            encoded = []
            for i, name in enumerate(names):
                total, n = F.get("sums", F.lit(i)), F.col("_n")
                if training:
                    own = (
                        quoted(self.y).cast("string").eqNullSafe(stats.classes[i]).cast("double")
                        if stats.task == MULTICLASS
                        else quoted(self.y).cast("double")
                    )
                    value = F.when(n > F.lit(1), (total - own) / (n - 1))
                    value = F.when(quoted(self.y).isNull(), total / n).otherwise(value)
                else:
                    value = total / n
                encoded.append(value.alias(name))
            df = fill_unseen(
                joined.select(*kept, *encoded), dict(zip(names, stats.priors)), self.fill
            )
            if self.noise:
                df = df.withColumns(
                    {c: add_noise(quoted(c), self.key, self.noise, self.seed) for c in names}
                )
        return df


def fill_unseen(df: DataFrame, priors: dict[str, float], fill: str) -> DataFrame:
    """Fill missing encodings with the prior or with the mean of the encoded batch."""
    if fill == "prior":
        defaults = dict(priors)
    elif fill == "batch_mean":
        row = df.agg(*[F.avg(quoted(c)).alias(f"_{i}") for i, c in enumerate(priors)]).first()
        defaults = {c: priors[c] if row[i] is None else row[i] for i, c in enumerate(priors)}
    else:
        raise ValueError(f"fill must be 'prior' or 'batch_mean', got {fill!r}")
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(v)) for c, v in defaults.items()})


def fit_leave_one_out(
    df: DataFrame, columns: list[str], y: str, task: str = BINARY, noise: float = 0.0,
    key: str | None = None, seed: int = SPLIT_SEED, fill: str = "prior",
) -> LeaveOneOutEncoding:
    if noise and key is None:
        raise ValueError("noise needs a row key")
    return LeaveOneOutEncoding(fit_stats(df, columns, y, task), y, noise, key, seed, fill)


def fold_of(key: str | list[str], n_folds: int, seed: int = SPLIT_SEED) -> Column:
    """Fold number of a row from its key."""
    return F.pmod(hash_word(key_hash(key, seed)), F.lit(n_folds)).cast("int")


def out_of_fold(
    df: DataFrame, column: str, y: str, key: str | list[str], n_folds: int = 5,
    seed: int = SPLIT_SEED, suffix: str = "_enc", broadcast_bytes: int | None = None,
) -> DataFrame:
    """Encode each row by the mean of its category over the rows of all other folds.

    One aggregation by category and fold is enough: the other folds are the category's total
    minus its own fold. A category without rows elsewhere gets the prior of the other folds.
    """
    spark = df.sparkSession
    folded = df.withColumn("_fold", fold_of(key, n_folds, seed))
    value, target = quoted(column).cast("string"), quoted(y).cast("double")
    # Rows without a target take an encoding but add nothing to it.
    parts = materialise(
        folded.groupBy(value.alias("category"), "_fold").agg(
            F.count(target).alias("n"), F.coalesce(F.sum(target), F.lit(0.0)).alias("s")
        )
    )
    totals = parts.groupBy("category").agg(F.sum("n").alias("_tn"), F.sum("s").alias("_ts"))
    others = (
        parts.where("category is not null")
        .join(totals, "category")
        .select(
            "category", F.col("_fold").alias("fold"), "n",
            F.when(
                F.col("_tn") > F.col("n"), (F.col("_ts") - F.col("s")) / (F.col("_tn") - F.col("n"))
            ).alias("_mean"),
        )
    )
    size = parts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("category")).alias("bytes"),
        F.max(F.octet_length("category")).alias("longest"),
        F.sum("n").alias("n"),
    ).first()
    # One prior per fold: at most n_folds rows.
    sums = {r["_fold"]: r for r in parts.groupBy("_fold").agg(F.sum("n"), F.sum("s")).collect()}
    n_all = sum(r["sum(n)"] for r in sums.values())
    s_all = sum(r["sum(s)"] for r in sums.values())
    priors = spark.createDataFrame(
        [
            (f, (s_all - r["sum(s)"]) / (n_all - r["sum(n)"]) if n_all > r["sum(n)"] else None)
            for f, r in sums.items()
        ],
        "_fold int, _prior double",
    )
    joined = lookup(
        folded, others, [value, F.col("_fold")], ["category", "fold"], ["_mean"],
        (size["bytes"] or 0) + 80 * size["rows"], "n", size["n"] or 0,
        (size["longest"] or 0) + 80, broadcast_bytes,
    ).join(F.broadcast(priors), "_fold", "left")
    return joined.select(
        *[quoted(c) for c in df.columns],
        F.col("_fold").alias("fold"),
        F.coalesce("_mean", "_prior").alias(column + suffix),
    )
