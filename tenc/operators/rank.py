"""Exact global positions without a single-task sort.

Rows are ordered by a hash of their key. Hash prefixes cut that order into even buckets, so a
bucket's offset comes from a small table of counts and the sort happens bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenc.functions.hashing import SAMPLE_SEED, key_hash
from tenc.session import materialise

# Rows one sort bucket should hold at most, on average.
ROWS_PER_BUCKET = 1_000_000


def prefix_digits(n_rows: int) -> int:
    """Hex digits needed so that an average bucket stays under ``ROWS_PER_BUCKET`` (1 to 5)."""
    digits = 1
    while digits < 5 and n_rows / 16**digits > ROWS_PER_BUCKET:
        digits += 1
    return digits


def hash_position(
    df: DataFrame, keys: str | list[str], seed: int = SAMPLE_SEED, n_rows: int | None = None,
    name: str = "row_pos",
) -> DataFrame:
    """Add the 1-based position of every row in the seeded hash order of its key."""
    digits = prefix_digits(df.count() if n_rows is None else n_rows)
    hashed = df.withColumn("_hash", key_hash(keys, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    # At most 16 ** 5 rows: the window over all of them orders prefixes, not data.
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_bucket",
            (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        )
    )
    order = [F.col("_hash")] + [F.col(k) for k in ([keys] if isinstance(keys, str) else keys)]
    within = Window.partitionBy("_bucket").orderBy(*order)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(within))
        .select(*df.columns, name)
    )


def _hex_bound(share: Column) -> Column:
    """The first eight hex digits of a share of the hash range; past the end, a larger text."""
    scaled = F.floor(F.greatest(share, F.lit(0.0)) * F.lit(float(1 << 32))).cast("long")
    return F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(scaled)), 8, "0"))


def hash_cuts(
    hashed: DataFrame, groups: list[str], sizes: DataFrame, digest: str = "_hash"
) -> DataFrame:
    """Per group, the largest hash among its first ``take`` rows in hash order.

    ``sizes`` is a small table with the groups, their ``n`` rows and ``take``. Hashes are
    uniform, so the cut lies close to ``take / n`` of the hash range: one pass counts the rows
    below a narrow window there and keeps the hashes inside it, about sqrt(n) of them. Should a
    cut lie outside, the window grows until it covers the range, so the result is exact. Keys must be
    unique: a cut between rows of one key raises.
    """
    wanted = sizes.where("take > 0")
    n_wanted = wanted.count()
    width = 6.0
    while True:
        share = F.col("take") / F.col("n")
        half = F.sqrt(share * (1 - share) / F.col("n")) * width + F.lit(2 * width) / F.col("n")
        bounds = wanted.select(
            *groups, "take",
            _hex_bound(share - half).alias("_lower"), _hex_bound(share + half).alias("_upper"),
        )
        place = F.when(F.col(digest) >= F.col("_lower"), F.col(digest)).alias("cut")
        near = (
            hashed.join(F.broadcast(bounds), groups)
            .where(F.col(digest) < F.col("_upper"))
            .groupBy(*groups, "take", place)
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        order = Window.partitionBy(*groups).orderBy(F.col("cut").asc_nulls_first())
        reached = F.col("_upto") >= F.col("take")
        before = F.col("_upto") - F.col("_n") < F.col("take")
        found = materialise(
            near.withColumn("_upto", F.sum("_n").over(order))
            .where(reached & before & F.col("cut").isNotNull())
            .select(*groups, "cut", (F.col("_upto") > F.col("take")).alias("_tied"))
        )
        if found.where("_tied").count():
            raise ValueError("rows share a key: their order is not settled, so no exact cut exists")
        if found.count() == n_wanted:
            return found.drop("_tied")
        if width > 1e9:
            raise ValueError("more rows were asked for than there are keys")
        width *= 64


def first_by_hash(
    df: DataFrame, keys: str | list[str], n: int, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Exactly ``n`` rows, drawn without replacement; all rows if there are no more than that.

    The order is settled by one cut-off hash, so the rows themselves are only filtered.
    """
    n_rows = df.count()
    if n >= n_rows:
        return df
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_hash", key_hash(keys, seed))
    size = df.sparkSession.createDataFrame([(0, n_rows, n)], "_g int, n long, take long")
    marked = hashed.select("_hash", F.lit(0).alias("_g"))
    cut = hash_cuts(marked, ["_g"], size).first()["cut"]
    return hashed.where(F.col("_hash") <= cut).select(*df.columns)
