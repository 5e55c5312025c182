"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.session import scratch_path

# A table of at most so many rows may be broadcast when its rows are a few numbers wide.
BROADCAST_ROWS = 1_000_000
# Characters of text a Python worker handles at a time; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000

_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to differ from all columns."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows, as columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_written(df: DataFrame) -> DataFrame:
    """The rows of a table read from Parquet, in the order of its files and of the rows in them.

    Partitions ascend in that order; Spark itself deals files to tasks by size. Files are ordered by the
    number of the task that wrote them. Anything but a table as read is given back as it is.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return df
    task, file, row = unused(df, "task", "file", "row")
    meta = df.metadataColumn("_metadata")
    placed = df.select("*", meta["file_name"].alias(file), meta["row_index"].alias(row)).withColumn(
        task, F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")
    )
    return placed.repartitionByRange(task, file, row).sortWithinPartitions(task, file, row).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def attach(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a written table of narrow rows: broadcast up to ``limit`` rows, else by key.

    In the second case Spark splits the tasks of keys that hold many rows of ``left``.
    """
    small = right.count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of a key's decimal text; a missing key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and all else as it is."""
    return (text or "").encode("utf-8", "replace").translate(_ASCII_LOWER).split()


def text_batches(
    batches: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches so that each holds few characters; ``text`` also comes as a list."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text or "") > chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text or "")
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def map_texts(
    df: DataFrame, keep: list[str], schema: str,
    function: Callable[[Iterator[tuple[pa.RecordBatch, list[str | None]]]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """Run ``function`` over batches of ``keep`` and ``text``; nothing else is read."""

    def run(batches):
        return function(text_batches(batches))

    return df.select(*keep, "text").mapInArrow(run, schema)
