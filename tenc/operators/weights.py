"""Class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import quoted


def add_class_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Balanced weights: rows divided by the number of classes times the rows of the class."""
    # One row per class reaches the driver.
    counts = {
        r[0]: r[1]
        for r in df.groupBy(quoted(y).cast("string")).agg(F.count(F.lit(1))).collect()
        if r[0] is not None
    }
    total = sum(counts.values())
    pairs = [
        F.lit(x) for c, n in sorted(counts.items()) for x in (c, total / (len(counts) * n))
    ]
    weights = F.create_map(*pairs)
    return df.withColumn(name, F.try_element_at(weights, quoted(y).cast("string")))
