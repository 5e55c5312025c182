"""Delimited text files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenc.functions.cleaning import quoted
from tenc.session import written

# Texts that stand for a missing value in the raw files.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_markers_to_null(df: DataFrame, markers: Iterable[str] = NULL_MARKERS) -> DataFrame:
    """Replace marker texts by null in all string columns."""
    listed = list(markers)
    return df.select(
        *[
            F.when(~quoted(f.name).isin(listed), quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def text_schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    names: list[str] | None = None,
    multiline: bool | str = False,
    preamble: int = 0,
    markers: Iterable[str] | None = NULL_MARKERS,
) -> DataFrame:
    """Read delimited text; every column arrives as text and is cast later by its role.

    ``names`` reads a file without header. ``preamble`` skips that many lines before the header
    of each file. Gzip and bzip2 files are read as they are; zip archives need repacking first.

    ``multiline=True`` lets cells hold line breaks; one task then reads a whole file. With
    ``multiline="split"`` many tasks read a file (``read_split``): for UTF-8 without a preamble,
    where quotes occur in quoted cells only.
    """
    if multiline == "split":
        if preamble or encoding.upper().replace("-", "") != "UTF8":
            raise ValueError("a split read needs UTF-8 and no preamble")
        df = read_split(spark, path, sep, names)
        return null_markers_to_null(df, markers) if markers is not None else df
    reader = (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if preamble:
        df = _skip_lines(spark, reader, path, preamble, names, sep, encoding)
    elif names:
        df = reader.schema(text_schema(names)).csv(path)
    else:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
    return null_markers_to_null(df, markers) if markers is not None else df


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with each row's file, the start of its block and its running number in the task."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )


def _header_names(
    spark: SparkSession, path: str | list[str], preamble: int, sep: str, encoding: str
) -> list[str]:
    """The column names in the first line after the preamble, which must agree in all files."""
    # Whole lines, in the encoding of the data; blank lines do not count, as in the reader.
    lines = (
        spark.read.option("sep", "\u0001").option("quote", "").option("encoding", encoding)
        .schema("value string").csv(path)
    )
    top = _numbered(lines).where("_start = 0")
    first = top.groupBy("_file").agg(F.min("_at").alias("_first"))
    # One row per file goes on; of equal headers one reaches the driver, of different ones two.
    headers = (
        top.join(first, "_file").where(F.col("_at") == F.col("_first") + preamble)
        .select("value").distinct().limit(2).collect()
    )
    if len(headers) != 1:
        raise ValueError("the files have different headers" if headers else "no header line")
    return _cells(spark, headers[0]["value"], sep)


def _cells(spark: SparkSession, header: str, sep: str) -> list[str]:
    """The cells of a header as column names; empty ones are named by their place."""
    width = header.count(sep) + 1
    cells = (
        spark.createDataFrame([(header,)], "value string")
        .select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {
            "sep": sep, "quote": '"', "escape": '"', "nullValue": "", "multiLine": "true",
        }).alias("r")).first()["r"]
    )
    found = list(cells)
    # Separators inside quotes make the count too high; the cells beyond the last are empty.
    quoted_away = header.count(sep) - _separators(header, sep)
    found = found[: width - quoted_away]
    return [(c or "").strip() or f"_c{i}" for i, c in enumerate(found)]


def _separators(line: str, sep: str) -> int:
    """Separators of a line outside of quotes."""
    return sum(part.count(sep) for part in line.split('"')[::2])


def _skip_lines(
    spark: SparkSession, reader, path: str | list[str], preamble: int, names: list[str] | None,
    sep: str, encoding: str,
) -> DataFrame:
    """Drop the first lines of each file by their position in the file's first block.

    Positions are only ranked among the rows of that block: their running number starts anew at
    each block, so the cut needs no look at other blocks.
    """
    lines = preamble
    if names is None:
        names, lines = _header_names(spark, path, preamble, sep, encoding), preamble + 1
    numbered = _numbered(reader.schema(text_schema(names)).csv(path))
    first_row = (
        numbered.where("_start = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    )
    # One row per input file; the optimiser weighs its size.
    return (
        numbered.join(first_row, "_file", "left")
        .where((F.col("_start") > 0) | (F.col("_at") >= F.col("_first") + lines))
        .select(*[quoted(n) for n in names])
    )


def read_split(
    spark: SparkSession, path: str | list[str], sep: str = ",", names: list[str] | None = None
) -> DataFrame:
    """Delimited text with line breaks in quoted cells, each file read by as many tasks as it has blocks.

    A line starts a record if an even number of quotes lies before it in its file. Quotes are counted
    by block, a row for each block is summed up over the file, and lines are numbered inside their
    block only. Lines that are whole records are parsed where they are; only the lines of longer
    records meet by record. Lines end in a line feed, with or without a carriage return before it.
    Empty lines between records are left out. Without ``names`` the first record of every file is the
    header, which must be the same in all.
    """
    lines = _numbered(spark.read.option("lineSep", "\n").text(path)).withColumn(
        "_odd", F.length(F.regexp_replace("value", '[^"]', "")) % 2
    )
    block, inside = ["_file", "_start"], Window.partitionBy("_file", "_start").orderBy("_at")
    before = F.sum("_odd").over(inside) - F.col("_odd")
    numbered = lines.withColumn("_before", before)
    # A row a block: its quotes, and its last record start for either state that it may begin in.
    per_block = numbered.groupBy(*block).agg(
        F.sum("_odd").alias("_quotes"),
        F.max(F.when(F.col("_before") % 2 == 0, F.col("_at"))).alias("_last0"),
        F.max(F.when(F.col("_before") % 2 == 1, F.col("_at"))).alias("_last1"),
    )
    along = Window.partitionBy("_file").orderBy("_start")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    states = per_block.withColumn(
        "_state", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2
    ).withColumn("_last", F.when(F.col("_state") == 0, F.col("_last0")).otherwise(F.col("_last1")))
    carried = states.select(*block, "_state", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    placed = numbered.join(carried, block)
    starts = (F.col("_before") + F.col("_state")) % 2 == 0
    # A line inside a record belongs to the last start of its block or else of the blocks before.
    record = F.coalesce(F.last(F.when(starts, F.col("_at")), ignorenulls=True).over(inside), F.col("_carried"))
    marked = placed.select("_file", "_at", "value", record.alias("_record"), (starts & (F.col("_odd") == 0)).alias("_whole"))
    whole = marked.where("_whole").select("_file", "_record", "value")
    folded = marked.where("NOT _whole").groupBy("_file", "_record").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n"
        ).alias("value")
    )
    records = whole.unionByName(folded).withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    if names is None:
        # One record a file, and of equal ones one reaches the driver.
        tops = records.groupBy("_file").agg(F.min("_record").alias("_record"))
        records = written(records, "records")
        heads = records.join(tops, ["_file", "_record"]).select("value").distinct().limit(2).collect()
        if len(heads) != 1:
            raise ValueError("the files have different headers" if heads else "no header line")
        names = _cells(spark, heads[0]["value"], sep)
        records = records.join(tops.withColumnRenamed("_record", "_top"), "_file").where("_record > _top")
    schema = text_schema(f"c{i}" for i in range(len(names)))
    parsed = records.select(F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)])


def names_from_dictionary(dictionary: DataFrame, column: str = "Column Name") -> list[str]:
    """Column names listed in a data dictionary file, in file order (one row per column)."""
    return [r[0] for r in dictionary.select(quoted(column)).collect()]


def with_row_key(df: DataFrame, name: str = "row_id", index: str | None = None) -> DataFrame:
    """Add a key per row that does not depend on how the input was cut into tasks.

    The key is the text of the ``index`` column where there is one; of rows that share it all but the first, in the
    order of a hash of their contents, have their number behind it. Without an index, or where it is missing, the key is
    a hash of the row's contents and, among rows that are equal in all columns and so interchangeable, their number.
    """
    digest = F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    if index is not None:
        held = df.withColumn("_digest", digest).withColumn("_held", F.coalesce(quoted(index).cast("string"), F.col("_digest")))
        place = F.row_number().over(Window.partitionBy("_held").orderBy("_digest"))
        numbered = held.withColumn("_place", place)
        key = F.when(F.col("_place") == 1, F.col("_held")).otherwise(F.concat_ws("#", "_held", "_place"))
        return numbered.withColumn(name, key).drop("_digest", "_held", "_place")
    within = Window.partitionBy("_digest").orderBy("_digest")
    return (
        df.withColumn("_digest", digest)
        .withColumn(name, F.concat_ws("-", "_digest", F.row_number().over(within)))
        .drop("_digest")
    )


__all__ = [
    "NULL_MARKERS", "names_from_dictionary", "null_markers_to_null", "read_delimited", "read_split",
    "text_schema", "with_row_key",
]
