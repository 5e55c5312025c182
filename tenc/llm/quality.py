"""Quality rules compiled into one projection of built-in functions.

A rule bounds a measure of a text; the table of rules is data. All measures and verdicts come
from the columns of one row, so there is no shuffle and no user function. Missing texts count
as empty: they have no words and fail. Repeated rows are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SPACES = " \t\n\x0b\f\r"

# Frequent function words of the languages that are kept.
STOP_WORDS = (
    "the of and to in is that was for it with as by on from be this are at or an not "
    "der die das und ist ein eine in den von zu mit im dem des für auf nicht sich als "
    "le la les de des et est un une dans pour que qui sur avec par pas du en au elle "
    "el los las del y o es una con por para su se lo como al"
).split()


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high`` for texts of at least ``from_words`` words."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, 50),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words which the text has at least twice.

    Runs are told apart by a 64-bit hash of their words.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - window),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]),
        )

    def covered(sorted_runs: Column) -> Column:
        repeated = F.filter(
            sorted_runs,
            lambda x, k: F.coalesce(F.get(sorted_runs, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_runs, k + 1)["h"] == x["h"], F.lit(False)),
        )
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["i"])),
            start,
            lambda acc, i: F.struct(
                i.alias("last"),
                (acc["total"] + F.least(F.lit(window), i - acc["last"])).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    def count(h: Column) -> Column:
        runs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(runs, covered))

    return F.when(F.size(found) <= window, 0).otherwise(_let(_let(found, hashes), count))


def _verdict(rule: Rule) -> Column:
    ratio = F.col(rule.numerator).cast("double")
    if rule.denominator:
        ratio = ratio / F.greatest(F.col(rule.denominator), F.lit(1))
    fine = F.lit(True)
    if rule.low is not None:
        fine = fine & (ratio >= rule.low)
    if rule.high is not None:
        fine = fine & (ratio <= rule.high)
    return fine | (F.col("n_words") < rule.from_words) if rule.from_words else fine


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns), the measures, ``base_failed``, ``failed_rules`` and ``kept``.

    Measures replace columns of the same name in the result.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    names = docs.columns if keep is None else keep
    found = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__text"))
    found = found.withColumns({"__words": words(text), "__lines": lines})
    measures = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.translate(text, _SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        "n_stop_words": F.size(
            F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))
        ).cast("long"),
    }
    kept = [F.col(f"`{c}`") for c in names if c not in measures]
    result = found.select(*kept, *[m.alias(n) for n, m in measures.items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(
        F.array(*[F.when(~_verdict(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return result.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of ``docs`` that pass the base rule and all ``rules``."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    judged = measured(renamed, rules, keep=list(names.values()))
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
