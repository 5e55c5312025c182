"""Shrunken target encoding."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.operators.encoders.stats import (
    BINARY,
    MULTICLASS,
    CategoryStats,
    FeatureMeta,
    fit_stats,
)
from tenc.operators.lookup import lookup
from tenc.operators.relate import unseen_values

UNKNOWN_CHOICES = ("error", "ignore")
_SHOWN = 20


@dataclass(frozen=True)
class Shrinkage:
    """How far a category mean is trusted, given its number of rows.

    ``bayes``        n / (n + m), with m a number or ``n_avg`` (rows per category)
    ``exponential``  logistic in (n - k) / f, and zero for categories seen at most once
    ``sigmoid``      the same logistic curve without the special case
    """

    kind: str = "bayes"
    m: float | str = 1
    k: float = 1
    f: float = 1.0

    def __post_init__(self):
        if self.kind not in ("bayes", "exponential", "sigmoid"):
            raise ValueError(f"unknown shrinkage {self.kind!r}")
        if self.m != "n_avg" and not (isinstance(self.m, (int, float)) and self.m > 0):
            raise ValueError("m must be 'n_avg' or a positive number")

    def weight(self, n: Column, feature: FeatureMeta) -> Column:
        if self.kind == "bayes":
            m = feature.n_rows / max(feature.k, 1) if self.m == "n_avg" else float(self.m)
            return n / (n + F.lit(m))
        curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(self.k)) / F.lit(self.f)))
        if self.kind == "exponential":
            return F.when(n <= 1, F.lit(0.0)).otherwise(curve)
        return curve


def validate(unknown: str, categories: dict[str, list] | None) -> None:
    if unknown not in UNKNOWN_CHOICES:
        raise ValueError(f"unknown must be one of {UNKNOWN_CHOICES}, got {unknown!r}")
    for column, listed in (categories or {}).items():
        if list(listed) != sorted(listed):
            raise ValueError(f"the categories of column {column!r} are not sorted")


@dataclass(frozen=True)
class TargetEncoding:
    """A fitted encoding; applying it to a table is a left join with the prior as default."""

    stats: CategoryStats
    shrinkage: Shrinkage
    unknown: str = "error"
    categories: dict[str, list] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.stats.features]

    def known(self, column: str) -> DataFrame:
        """``category, n, sums`` of the categories that count as known."""
        table = self.stats.table(column)
        if column not in self.categories:
            return table
        listed = self.stats.spark.createDataFrame(
            [(str(c),) for c in self.categories[column]], "category string"
        )
        return table.join(F.broadcast(listed), "category", "left_semi")

    def table(self, column: str) -> DataFrame:
        """``category, n, means, enc``: the encoding of one column as a plain table."""
        stats = self.stats
        weight = self.shrinkage.weight(F.col("n"), stats.feature(column))
        means = F.transform("sums", lambda s: s / F.col("n"))
        blended = F.zip_with(
            "means",
            stats.prior_array,
            lambda mean, prior: F.col("_w") * mean + (F.lit(1.0) - F.col("_w")) * prior,
        )
        return (
            self.known(column)
            .withColumns({"means": means, "_w": weight})
            .select("category", "n", "means", blended.alias("enc"))
        )

    def summary(self) -> DataFrame:
        """The whole encoding in long form: ``feature, category, class, n, mean, enc``."""
        labels = self.stats.classes or ("",)
        parts = []
        for column in self.columns:
            parts.append(
                self.table(column)
                .select(
                    F.lit(column).alias("feature"),
                    "category",
                    "n",
                    F.posexplode(F.arrays_zip("means", "enc")).alias("_i", "_pair"),
                )
                .select(
                    "feature",
                    "category",
                    F.get(F.array(*[F.lit(c) for c in labels]), F.col("_i")).alias("class"),
                    "n",
                    F.col("_pair.means").alias("mean"),
                    F.col("_pair.enc").alias("enc"),
                )
            )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def unknown_values(self, df: DataFrame, column: str) -> DataFrame:
        known = self.known(column).select(F.col("category").alias(column))
        return unseen_values(df.select(quoted(column).cast("string").alias(column)), known, column)

    def require_known(self, df: DataFrame) -> None:
        for column in self.columns:
            found = self.unknown_values(df, column).orderBy("value").limit(_SHOWN).collect()
            if found:
                values = [r["value"] for r in found]
                raise ValueError(f"unknown categories in column {column!r}: {values}")

    def apply(
        self, df: DataFrame, suffix: str = "_enc", broadcast_bytes: int | None = None
    ) -> DataFrame:
        """Add the encoded columns of every feature, in feature order.

        Unseen categories get the prior. With ``unknown='error'`` the job fails at the first row
        that has one, in the same pass, for streams too; ``require_known`` lists them beforehand.
        """
        for column in self.columns:
            df = self._apply_one(df, column, suffix, broadcast_bytes)
        return df

    def _apply_one(
        self, df: DataFrame, column: str, suffix: str, broadcast_bytes: int | None
    ) -> DataFrame:
        stats = self.stats
        names = stats.output_names(column, suffix)
        meta = stats.feature(column)
        table = self.table(column).select("category", "n", F.col("enc").alias("_enc"))
        joined = lookup(
            df, table, [quoted(column).cast("string")], ["category"], ["_enc"],
            meta.table_bytes, "n", meta.n_rows, meta.row_bytes, broadcast_bytes,
        )
        found = F.col("_enc")
        if self.unknown == "error":
            value = quoted(column).cast("string")
            message = F.concat(F.lit(f"unknown category in column {column!r}: "), value)
            found = F.when(value.isNotNull() & found.isNull(), F.raise_error(message)).otherwise(found)
        encoded = [
            F.coalesce(F.get(found, F.lit(i)), F.lit(prior)).alias(name)
            for i, (name, prior) in enumerate(zip(names, stats.priors))
        ]
        return joined.select(*[quoted(c) for c in df.columns], *encoded)

    def save(self, path: str) -> None:
        """Store statistics and settings under ``path`` (files only, no session needed later)."""
        stats = self.stats
        stats.spark.read.parquet(stats.path).write.partitionBy("feature").mode(
            "overwrite"
        ).parquet(f"{path}/stats")
        settings = {
            "task": stats.task,
            "features": [asdict(f) for f in stats.features],
            "classes": list(stats.classes),
            "priors": list(stats.priors),
            "shrinkage": asdict(self.shrinkage),
            "unknown": self.unknown,
            "categories": self.categories,
        }
        stats.spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(
            1
        ).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TargetEncoding:
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        stats = CategoryStats(
            spark,
            f"{path}/stats",
            settings["task"],
            tuple(FeatureMeta(**f) for f in settings["features"]),
            tuple(settings["classes"]),
            tuple(settings["priors"]),
        )
        return cls(
            stats, Shrinkage(**settings["shrinkage"]), settings["unknown"], settings["categories"]
        )


def fit(
    df: DataFrame,
    columns: list[str],
    y: str,
    task: str = BINARY,
    shrinkage: str = "bayes",
    m: float | str = 1,
    k: float = 1,
    f: float = 1.0,
    unknown: str = "error",
    categories: dict[str, list] | None = None,
    path: str | None = None,
) -> TargetEncoding:
    """Fit a target encoding of ``columns``.

    ``categories`` optionally lists (sorted) what a column may hold. With ``unknown='error'``
    other training values raise; with ``'ignore'`` they are treated like unseen ones.
    """
    rule = Shrinkage(shrinkage, m, k, f)
    validate(unknown, categories)
    listed = {c: [str(v) for v in values] for c, values in (categories or {}).items()}
    stats = fit_stats(df, columns, y, task, path)
    encoding = TargetEncoding(stats, rule, unknown, listed)
    if unknown == "error" and listed:
        for column in listed:
            observed = stats.table(column).select(F.col("category").alias(column))
            extra = encoding.unknown_values(observed, column).orderBy("value").limit(_SHOWN)
            values = [r["value"] for r in extra.collect()]
            if values:
                raise ValueError(f"unlisted categories in column {column!r}: {values}")
    return encoding


__all__ = ["MULTICLASS", "Shrinkage", "TargetEncoding", "fit"]
