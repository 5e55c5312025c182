"""Encodings without a target: frequency and one-hot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.operators.encoders.stats import REGRESSION, CategoryStats, fit_stats
from tenc.operators.lookup import lookup
from tenc.operators.profile import ONE_HOT_LIMIT, one_hot_guard


@dataclass(frozen=True)
class CountEncoding:
    """Each value becomes the number of fitted rows that hold it; unseen values become 0."""

    stats: CategoryStats

    def apply(
        self, df: DataFrame, suffix: str = "_count", broadcast_bytes: int | None = None
    ) -> DataFrame:
        for meta in self.stats.features:
            joined = lookup(
                df, self.stats.table(meta.name).withColumn("_n", F.col("n")),
                [quoted(meta.name).cast("string")], ["category"], ["_n"],
                meta.table_bytes, "n", meta.n_rows, meta.row_bytes, broadcast_bytes,
            )
            df = joined.select(
                *[quoted(c) for c in df.columns],
                F.coalesce("_n", F.lit(0)).cast("long").alias(meta.name + suffix),
            )
        return df


def fit_counts(df: DataFrame, columns: list[str]) -> CountEncoding:
    with_zero = df.select(*[quoted(c) for c in columns], F.lit(0.0).alias("_zero"))
    return CountEncoding(fit_stats(with_zero, columns, "_zero", REGRESSION))


@dataclass(frozen=True)
class OneHotEncoding:
    """One 0/1 column per known value; unseen and missing values are all zeros."""

    values: dict[str, tuple[str, ...]]

    def apply(self, df: DataFrame) -> DataFrame:
        flags = [
            (quoted(c).cast("string").eqNullSafe(F.lit(v))).cast("int").alias(f"{c}_{v}")
            for c, values in self.values.items()
            for v in values
        ]
        return df.select(*[quoted(c) for c in df.columns], *flags)


def fit_one_hot(
    df: DataFrame, columns: list[str], limit: int = ONE_HOT_LIMIT
) -> OneHotEncoding:
    """Learn the values; refuses a column with more than ``limit`` of them."""
    wide = [r["column"] for r in one_hot_guard(df, columns, limit).where("skip_one_hot").collect()]
    if wide:
        raise ValueError(f"more than {limit} categories in {wide}: not one-hot encoded")
    known = {}
    for c in columns:
        # At most ``limit`` values, as just checked.
        rows = df.select(quoted(c).cast("string").alias("v")).distinct().where("v is not null")
        known[c] = tuple(r["v"] for r in rows.orderBy("v").collect())
    return OneHotEncoding(known)


def one_hot_stages(columns: list[str], suffix: str = "_onehot") -> list:
    """The same encoding as ML stages: one vector slot per value, zeros for unseen values."""
    index = [c + "_index" for c in columns]
    return [
        StringIndexer(
            inputCols=columns, outputCols=index, handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=index, outputCols=[c + suffix for c in columns], dropLast=True),
    ]
