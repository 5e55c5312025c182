"""Empirical-Bayes encoding of a single column with a logistic trust curve and noise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted
from tenc.functions.hashing import SPLIT_SEED
from tenc.operators.encoders.heldout import add_noise, fill_unseen
from tenc.operators.encoders.stats import BINARY
from tenc.operators.encoders.target import TargetEncoding, fit
from tenc.operators.lookup import lookup


@dataclass(frozen=True)
class EmpiricalBayesEncoding:
    encoding: TargetEncoding
    noise: float
    key: str | None
    seed: int
    fill: str

    def apply(
        self, df: DataFrame, suffix: str = "_enc", broadcast_bytes: int | None = None
    ) -> DataFrame:
        stats = self.encoding.stats
        meta = stats.features[0]
        names = stats.output_names(meta.name, suffix)
        joined = lookup(
            df, self.encoding.table(meta.name).withColumn("_enc", F.col("enc")),
            [quoted(meta.name).cast("string")], ["category"], ["_enc"],
            meta.table_bytes, "n", meta.n_rows, meta.row_bytes, broadcast_bytes,
        )
        encoded = [F.get("_enc", F.lit(i)).alias(c) for i, c in enumerate(names)]
        out = joined.select(*[quoted(c) for c in df.columns], *encoded)
        out = fill_unseen(out, dict(zip(names, stats.priors)), self.fill)
        if self.noise:
            out = out.withColumns(
                {c: add_noise(quoted(c), self.key, self.noise, self.seed) for c in names}
            )
        return out


def fit_empirical_bayes(
    df: DataFrame, columns: list[str], y: str, task: str = BINARY, k: float = 5, f: float = 1.0,
    noise: float = 0.01, key: str | None = None, seed: int = SPLIT_SEED, fill: str = "prior",
) -> EmpiricalBayesEncoding:
    """``fill='batch_mean'`` gives unseen categories the mean of the encoded batch instead."""
    if len(columns) != 1:
        raise ValueError("the empirical-Bayes encoder takes a single column")
    if noise and key is None:
        raise ValueError("noise needs a row key")
    encoding = fit(df, columns, y, task, "sigmoid", k=k, f=f, unknown="ignore")
    return EmpiricalBayesEncoding(encoding, noise, key, seed, fill)
