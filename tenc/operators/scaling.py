"""Scaling by the standard deviation, without centring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted


@dataclass(frozen=True)
class Scaling:
    """Population standard deviations; a constant column is left as it is."""

    deviations: dict[str, float]

    def apply(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.select(
            *[quoted(c) for c in df.columns],
            *[(quoted(c) / F.lit(s)).alias(c + suffix) for c, s in self.deviations.items()],
        )


def fit_scaling(df: DataFrame, columns: list[str]) -> Scaling:
    row = df.agg(*[F.stddev_pop(quoted(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return Scaling({c: row[i] or 1.0 for i, c in enumerate(columns)})


def fit_vector_scaling(df: DataFrame, source: str, target: str) -> ElementwiseProduct:
    """The same for the entries of a vector column, as an ML transformer."""
    row = df.select(
        Summarizer.metrics("variance", "count").summary(F.col(source)).alias("s")
    ).select("s.variance", "s.count").first()
    n = row["count"]
    shrink = (n - 1) / n if n > 1 else 0.0
    deviations = [(v * shrink) ** 0.5 for v in row["variance"].toArray()]
    factors = Vectors.dense([1.0 / s if s > 1e-12 else 1.0 for s in deviations])
    return ElementwiseProduct(scalingVec=factors, inputCol=source, outputCol=target)
