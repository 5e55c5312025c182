"""Left join against a keyed table, with the plan chosen by the table's known size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenc.functions.cleaning import quoted

# Tables up to this many bytes go to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key holding more than one row in this many is "hot". At most this many keys can be hot.
HOT_SHARE = 2048
_SALTS = 1024


def _spread(df: DataFrame) -> Column:
    """A row-dependent salt from the columns that can be hashed."""
    usable = [
        quoted(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, T.AtomicType) or isinstance(f.dataType, T.NumericType)
    ]
    return F.pmod(F.xxhash64(*usable), F.lit(_SALTS)).cast("int")


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: list[Column],
    keys: list[str],
    values: list[str],
    table_bytes: int,
    weight: str,
    total: int,
    row_bytes: int,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Add ``values`` of ``table`` to ``df`` where ``on`` equals ``keys``; null where absent.

    ``table`` has one row per key and ``weight`` says how many fitted rows that key had out of
    ``total``. Within the byte bound the table is broadcast. Beyond it, only the hot keys are
    broadcast: at most ``HOT_SHARE`` of them whatever the data, and fewer if one row of the table
    can take many bytes (``row_bytes``). Their rows are then spread over the shuffle by a salt,
    while all other rows meet the rest of the table by key.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    right_keys = [f"_key{i}" for i in range(len(keys))]
    slim = table.select(
        *[F.col(k).alias(r) for k, r in zip(keys, right_keys)], *values, F.col(weight).alias("_w")
    )
    kept = [quoted(c) for c in df.columns]

    if table_bytes <= limit:
        small = F.broadcast(slim.drop("_w"))
        matches = [left == small[r] for left, r in zip(on, right_keys)]
        return df.join(small, matches, "left").select(*kept, *values)

    most_hot = max(min(HOT_SHARE, BROADCAST_BYTES // max(row_bytes, 1)), 8)
    bound = max(total // most_hot, 1)
    hot = slim.where(F.col("_w") > bound).select(
        *right_keys, F.struct(*values).alias("_hot"), F.lit(True).alias("_is_hot")
    )
    cold = slim.where(F.col("_w") <= bound).select(
        *[F.col(r).alias("_c" + r) for r in right_keys],
        *[F.col(v).alias("_cold_" + v) for v in values],
        F.lit(0).alias("_zero"),
    )
    with_hot = df.join(
        F.broadcast(hot), [left == F.col(r) for left, r in zip(on, right_keys)], "left"
    )
    is_hot = F.col("_is_hot").isNotNull()
    unmatched = is_hot
    for left in on:
        unmatched = unmatched | left.isNull()
    staged = with_hot.withColumns(
        {f"_j{i}": F.when(~is_hot, left) for i, left in enumerate(on)}
        | {"_salt": F.when(unmatched, _spread(df)).otherwise(F.lit(0))}
    )
    joined = staged.join(
        cold,
        [F.col(f"_j{i}") == F.col("_c" + r) for i, r in enumerate(right_keys)]
        + [F.col("_salt") == F.col("_zero")],
        "left",
    )
    return joined.select(
        *kept,
        *[
            F.when(is_hot, F.col("_hot")[v]).otherwise(F.col("_cold_" + v)).alias(v)
            for v in values
        ],
    )
