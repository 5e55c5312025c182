"""Order-independent document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph (a line with a character other than ASCII white space) is hashed to 126 bits. A
fingerprint counts, for each bit, the paragraphs that have it set, modulo 2**20, next to the
number of paragraphs. Counts are packed three to a 64-bit word with a spare bit between them, so
that adding words adds all counts. Equal multisets of paragraphs have equal fingerprints in any
order; adding or taking away a paragraph is adding or taking away its fingerprint.

Read as sums of +1 and -1, the counts of two fingerprints have a cosine that estimates the
cosine of the two multisets, with a standard error of at most 0.09.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenc.llm.common import attach, saved

_ONES = 1 | 1 << 21 | 1 << 42
_COUNTS = ((1 << 20) - 1) * _ONES
_MODULUS = (1 << 20) * _ONES
_WORDS = 43
# Documents a block of neighbouring keys holds on average.
BLOCK_DOCS = 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def _vector(paragraph: Column) -> Column:
    """The 43 words that one paragraph adds."""
    halves = [F.xxhash64(F.lit(i), paragraph) for i in (1, 2)]
    return _let(
        F.array(*halves),
        lambda h: F.array(
            *[F.shiftright(F.get(h, F.lit(i)), s).bitwiseAND(_ONES) for i in (0, 1) for s in range(21)],
            F.lit(1).cast("long"),
        ),
    )


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, an array of 43 longs; a missing text counts as empty."""
    paragraphs = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]")
    )
    return F.aggregate(
        paragraphs, F.array_repeat(F.lit(0).cast("long"), _WORDS), lambda acc, p: plus(acc, _vector(p))
    )


def plus(left: Column, right: Column) -> Column:
    """The fingerprint of two multisets put together."""
    return F.zip_with(left, right, lambda a, b: (a + b).bitwiseAND(_COUNTS))


def minus(left: Column, right: Column) -> Column:
    """The fingerprint of ``left`` without the paragraphs of ``right``, which it must hold."""
    return F.zip_with(left, right, lambda a, b: (a + _MODULUS - b).bitwiseAND(_COUNTS))


def text_form(prints: Column) -> Column:
    return F.concat_ws("", F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def signs(prints: Column) -> Column:
    """The 126 sums of +1 and -1."""
    low = F.lit((1 << 20) - 1)

    def lanes(x: Column, n: Column) -> Column:
        return F.array(*[
            (2 * F.shiftright(x, 21 * i).bitwiseAND(low) - n).cast("double") for i in range(3)
        ])

    return F.flatten(F.transform(
        F.slice(prints, 1, _WORDS - 1), lambda x: lanes(x, F.get(prints, F.lit(_WORDS - 1)))
    ))


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def likeness(left: str, right: str) -> Column:
    """From 0 to 1: the cosine of two fingerprints' sums; 1 if they are equal, negative ones count as 0."""
    a, b = signs(F.col(left)), signs(F.col(right))
    cosine = _let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda s: F.try_divide(
            _dot(s["a"], s["b"]), F.sqrt(_dot(s["a"], s["a"])) * F.sqrt(_dot(s["b"], s["b"]))
        ),
    )
    inside = F.least(F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(F.col(left) == F.col(right), 1.0).otherwise(inside)


def with_next(docs: DataFrame, columns: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each row with ``columns`` of the next row by descending ``doc_id``, as ``next_<column>``.

    After the last row comes the first. Rows of equal ``doc_id`` follow each other by the hash of
    their text; missing keys come last. Keys are cut into blocks as wide as the middle half of
    the keys suggests, so a block has few rows wherever keys lie as close as there or wider.
    Each block's first rows are also dealt to the block before it.
    """
    low, high, n = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.count("doc_id")
    ).first()
    if n:
        q1, q3 = docs.agg(F.percentile_approx("doc_id", [0.25, 0.75], 1000)).first()[0]
        width = max(1, int((q3 - q1) / max(1, n // 2) * block_docs))
    else:
        low, width = 0, 1
    block = F.coalesce(F.floor((F.col("doc_id") - low) / width).cast("long"), F.lit(-1).cast("long"))
    keyed = docs.withColumn("_block", block)
    heads = keyed.groupBy("_block").agg(F.max("doc_id").alias("doc_id"))
    # One row a block: the only window that is not dealt by key.
    downward = Window.orderBy(F.desc("_block"))
    everything = downward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = saved(
        heads.select(
            F.col("doc_id").alias("_head"),
            F.coalesce(F.lag("_block").over(downward), F.min("_block").over(everything)).alias("_to"),
        ),
        "heads",
    )
    present = attach(
        keyed.withColumn("_head", F.col("doc_id")), heads.where("_head is not null"), ["_head"]
    ).drop("_head")
    missing = heads.where("_head is null").first()
    if missing is not None:
        present = present.withColumn(
            "_to", F.when(F.col("doc_id").isNull(), F.lit(missing["_to"])).otherwise(F.col("_to"))
        )
    places = F.array(
        F.struct(F.col("_block").alias("block"), F.lit(False).alias("copy")),
        F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("block"), F.lit(True).alias("copy"))),
    )
    dealt = present.withColumn("_at", F.explode(F.filter(places, lambda p: p.isNotNull())))
    order = Window.partitionBy("_at.block").orderBy(
        "_at.copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )
    shifted = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return shifted.where(~F.col("_at.copy")).select(*docs.columns, *[f"next_{c}" for c in columns])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose later half the next document replaces."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_print", fingerprint(F.col("text")))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    changed = with_next(base, ["text", "_print"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "_print", "next__print", edited.alias("_edited")
    )
    printed = changed.withColumn("_edited_print", fingerprint(F.col("_edited")))
    return printed.select(
        "doc_id", "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("_print")).alias("fingerprint"),
        text_form(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness("_print", "_edited_print").alias("near_edited"),
        likeness("_print", "next__print").alias("near_next"),
    )
