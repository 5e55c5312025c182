"""Cleaning expressions. All are plain column expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lenient_int(c: Column, source_type: str = "string") -> Column:
    """Whole number or null: text must be a whole number, doubles are cut toward zero."""
    if source_type == "string":
        trimmed = F.trim(c)
        return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("long"))
    number = c.cast("double")
    bounded = F.abs(number) < F.lit(9.2e18)
    return F.when(bounded & ~F.isnan(number), number.cast("long"))


def replace_text(c: Column, replacements: Mapping[str, str]) -> Column:
    """Apply literal replacements one after the other."""
    for old, new in replacements.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def replace_in_text_columns(df: DataFrame, replacements: Mapping[str, str]) -> DataFrame:
    """Literal replacements in every string column, in one projection."""
    texts = set(text_columns(df))
    return df.select(
        *[
            replace_text(quoted(c), replacements).alias(c) if c in texts else quoted(c)
            for c in df.columns
        ]
    )


def sentinel_to_null(c: Column, sentinels: Iterable[str]) -> Column:
    return F.when(~c.isin(list(sentinels)), c)


def containing_to_null(c: Column, fragment: str) -> Column:
    return F.when(~c.contains(fragment), c)


def int_unless_containing(c: Column, fragment: str) -> Column:
    """Null where the text holds ``fragment``, otherwise a lenient whole number."""
    return lenient_int(containing_to_null(c, fragment))


def year_of(c: Column, pattern: str = "MM/dd/yyyy", strict: bool = False) -> Column:
    """Year of a date text; unreadable text gives null, or raises when ``strict``."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return F.year(parse(c, pattern if strict else F.lit(pattern)))


def log_magnitude(c: Column) -> Column:
    """ln |c|; null at zero (where the logarithm is minus infinity) and at NaN."""
    magnitude = F.abs(c.cast("double"))
    return F.when((magnitude > 0) & ~F.isnan(magnitude), F.ln(magnitude))


def keep_positive_log(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ln |source| as ``target`` and keep the rows where it is above zero."""
    return df.withColumn(target, log_magnitude(quoted(source))).where(quoted(target) > 0)


def log_shifted(c: Column, epsilon: float = 1e-10) -> Column:
    return F.ln(c.cast("double") + F.lit(epsilon))


def number_with_separators(c: Column, separator: str = ",") -> Column:
    return F.replace(c, F.lit(separator), F.lit("")).try_cast("double")


def without_last_character(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - 1).try_cast("double")


def equals_label(c: Column, value: str) -> Column:
    """1.0 where ``c`` is ``value``, 0.0 otherwise (missing counts as different)."""
    return c.eqNullSafe(F.lit(value)).cast("double")


def differs_from(c: Column, value) -> Column:
    """Row predicate ``c != value`` that keeps missing values."""
    return ~c.eqNullSafe(F.lit(value))


def recode(c: Column, mapping: Mapping, keep_unmapped: bool = True) -> Column:
    """Replace values by a lookup; values outside the mapping stay as text or become null."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    mapped = F.try_element_at(lookup, c)
    return F.coalesce(mapped, c.cast("string")) if keep_unmapped else mapped


def normalise_text(c: Column) -> Column:
    """Lower case with one blank on either side; a missing value is the text ``nan``."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(c.cast("string"), F.lit("nan"))), F.lit(" "))


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])
