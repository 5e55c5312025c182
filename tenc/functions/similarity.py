"""String similarities between two columns, each between 0 and 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gram_set(c: Column, size: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram."""
    last = F.greatest(F.length(c) - F.lit(size - 1), F.lit(1))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(size)))
    )


def character_set(c: Column) -> Column:
    return gram_set(c, 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    def score(sets: Column) -> Column:
        total = F.size(sets["a"]) + F.size(sets["b"])
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        return _once(shared, lambda n: n / (total - n))

    return _once(F.struct(a.alias("a"), b.alias("b")), score)


def sorensen_of_sets(a: Column, b: Column) -> Column:
    def score(sets: Column) -> Column:
        total = F.size(sets["a"]) + F.size(sets["b"])
        return F.lit(2.0) * F.size(F.array_intersect(sets["a"], sets["b"])) / total

    return _once(F.struct(a.alias("a"), b.alias("b")), score)


def gram_similarity(a: Column, b: Column, size: int = 3) -> Column:
    return jaccard_of_sets(gram_set(a, size), gram_set(b, size))


def jaccard_similarity(a: Column, b: Column) -> Column:
    return jaccard_of_sets(character_set(a), character_set(b))


def sorensen_similarity(a: Column, b: Column) -> Column:
    return sorensen_of_sets(character_set(a), character_set(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)
