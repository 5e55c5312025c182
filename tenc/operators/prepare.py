"""Role-driven preparation of a table: select, check, fill, drop, sample, normalise."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenc.functions.cleaning import normalise_text, quoted
from tenc.functions.hashing import SAMPLE_SEED
from tenc.operators.rank import first_by_hash, hash_position

NUMERICAL = "Numerical"
SPECIAL = "Special"
TARGET = "y"
DELETE = "Delete"
ONE_HOT = ("OneHotEncoder", "OneHotEncoderDense", "OneHotEncoderDense-1")
CATEGORICAL = (*ONE_HOT, SPECIAL)
MISSING_LIMIT = 0.15
MISSING_TEXT = "na"


@dataclass(frozen=True)
class Columns:
    """What the roles of a table mean for its columns."""

    features: tuple[str, ...]
    target: str
    special: str | None


def resolve_roles(roles: Mapping[str, str]) -> Columns:
    """Features in schema order, the first target and the first special column."""
    used = {c: r for c, r in roles.items() if r != DELETE}
    targets = [c for c, r in used.items() if r == TARGET]
    if not targets:
        raise ValueError("no column has the role 'y'")
    special = next((c for c, r in used.items() if r == SPECIAL), None)
    return Columns(tuple(c for c, r in used.items() if r != TARGET), targets[0], special)


def project_roles(df: DataFrame, roles: Mapping[str, str], key: str | None = None) -> DataFrame:
    """Keep the columns that have a role other than delete (and the row key)."""
    names = [c for c, r in roles.items() if r != DELETE]
    if key and key not in names:
        names = [key, *names]
    return df.select(*[quoted(c) for c in names])


def missing_fractions(
    df: DataFrame, columns: list[str], limit: float = MISSING_LIMIT
) -> DataFrame:
    """One row per column: the share of missing values and whether it is above the limit."""
    one_row = df.agg(
        *[F.avg(quoted(c).isNull().cast("int")).alias(f"_m{i}") for i, c in enumerate(columns)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("fraction"))
            for i, c in enumerate(columns)
        ]
    )
    return one_row.select(F.inline(pairs)).withColumn("exceeds", F.col("fraction") > limit)


def warn_missing(df: DataFrame, columns: list[str], limit: float = MISSING_LIMIT) -> list[str]:
    """Warn about columns with too many missing values (one row per column reaches the driver)."""
    high = missing_fractions(df, columns, limit).where("exceeds").collect()
    for row in high:
        warnings.warn(
            f"column {row['column']!r}: {row['fraction']:.3f} of the values are missing, "
            f"more than {limit:.3f}",
            stacklevel=2,
        )
    return [row["column"] for row in high]


def fill_missing_by_role(
    df: DataFrame, roles: Mapping[str, str], text: str = MISSING_TEXT
) -> DataFrame:
    """Missing values of categorical columns become a category of their own."""
    filled = {
        c: F.coalesce(quoted(c).cast("string"), F.lit(text))
        for c, r in roles.items()
        if r in CATEGORICAL
    }
    return df.select(*[filled.get(c, quoted(c)).alias(c) for c in df.columns])


def _is_missing(df: DataFrame, name: str):
    missing = quoted(name).isNull()
    if dict(df.dtypes)[name] in ("double", "float"):
        missing = missing | F.isnan(quoted(name))
    return missing


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~_is_missing(df, c)
    return df.where(keep)


def normalise_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    chosen = set(columns)
    return df.select(
        *[(normalise_text(quoted(c)) if c in chosen else quoted(c)).alias(c) for c in df.columns]
    )


def prepare(
    df: DataFrame,
    roles: Mapping[str, str],
    key: str,
    n_rows: int = -1,
    normalise: bool = True,
    shuffle: bool = False,
    seed: int = SAMPLE_SEED,
    check_missing: bool = True,
) -> DataFrame:
    """Project, check, fill, drop incomplete rows, sample, then normalise the special columns.

    The order matters: filling comes before dropping, normalising last. ``n_rows=-1`` keeps all
    rows; ``shuffle`` adds their position in the seeded order, since a table has no row order.
    """
    columns = resolve_roles(roles)
    out = project_roles(df, roles, key)
    used = [*columns.features, columns.target]
    if check_missing:
        warn_missing(out, used)
    out = drop_missing(fill_missing_by_role(out, roles), used)
    if n_rows != -1:
        out = first_by_hash(out, key, n_rows, seed)
    if shuffle:
        out = hash_position(out, key, seed)
    if normalise:
        out = normalise_columns(out, [c for c, r in roles.items() if r == SPECIAL])
    return out
