"""Role catalogues: which column plays which part in which dataset."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = (
    "struct<clf_type: string, col_action: map<string, string>, "
    "dirtiness_type: map<string, string>>"
)


def load_roles(path: str) -> dict[str, dict]:
    """The catalogue as a dictionary: dataset -> ``col_action`` (in order) and ``clf_type``."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def roles_table(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as rows ``dataset, task, position, column, role``."""
    whole = spark.read.text(path, wholetext=True)
    datasets = whole.select(F.from_json("value", f"map<string, {_ENTRY}>").alias("entries"))
    entries = datasets.select(F.explode("entries").alias("dataset", "entry"))
    return entries.select(
        "dataset",
        F.col("entry.clf_type").alias("task"),
        F.posexplode("entry.col_action").alias("position", "column", "role"),
    )


def merge_roles(own: dict[str, dict], catalogue: dict[str, dict]) -> dict[str, dict]:
    """Entries of the catalogue fill in the datasets that bring no roles of their own."""
    return {**catalogue, **own}
