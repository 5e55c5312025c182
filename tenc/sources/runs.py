"""Run records: one nested JSON row per run, read back in long form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenc.operators.metrics import SCORE_TYPES

RESULT_FIELDS = (
    "fold", "n_train_samples", "n_train_features", "score", "train_score", "encoding_time",
    "training_time",
)

_TEXTS = T.MapType(T.StringType(), T.StringType())
_NAMED = T.StructType().add("label", "string").add("name", "string").add("params", _TEXTS)
_RESULTS = T.StructType(
    [T.StructField(f, T.ArrayType(T.DoubleType())) for f in RESULT_FIELDS]
)
RUN_SCHEMA = (
    T.StructType()
    .add("dataset", "string")
    .add("n_splits", "integer")
    .add("test_size", "double")
    .add("n_rows", "long")
    .add("encoder", "string")
    .add("str_preprocess", "boolean")
    .add("clf", _NAMED)
    .add("ShuffleSplit", T.ArrayType(T.StringType()))
    .add("scaler", T.StructType().add("name", "string").add("params", _TEXTS))
    .add("sample_seed", "integer")
    .add("shuffleseed", "integer")
    .add("col_action", _TEXTS)
    .add("clf_type", "string")
    .add("results", _RESULTS)
)
# Stored records may also say how columns were reduced; it is read but is no parameter of our runs.
_REDUCTION = T.StructType().add("method", "string").add("size", "integer")
_STORED = T.StructType([*RUN_SCHEMA.fields, T.StructField("dimension_reduction", _REDUCTION)])
PARAMETERS = [f.name for f in RUN_SCHEMA.fields if f.name != "results"]


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Append run records as JSON, one folder per dataset."""
    runs.withColumn("dataset_folder", F.col("dataset")).write.mode(mode).partitionBy(
        "dataset_folder"
    ).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records with the name of the file each came from."""
    raw = spark.read.schema(_STORED).json(path)
    return raw.select(
        *_STORED.names, F.col("_metadata.file_name").alias("results_file")
    )


def long_results(runs: DataFrame) -> DataFrame:
    """One row per run and fold, with the name of the task's score."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(SCORE_TYPES.items())])
    per_fold = F.arrays_zip(*[F.col(f"results.{f}").alias(f) for f in RESULT_FIELDS])
    keep = ["dataset", "encoder", "n_splits"]
    keep += [c for c in ("results_file",) if c in runs.columns]
    return runs.select(
        *keep,
        F.col("clf.label").alias("clf"),
        F.try_element_at(names, F.col("clf_type")).alias("score_type"),
        F.explode(per_fold).alias("_r"),
    ).select(*keep, "clf", "score_type", *[F.col(f"_r.{f}").alias(f) for f in RESULT_FIELDS])


def parameter_key(runs: DataFrame, name: str = "run_key") -> DataFrame:
    """A canonical text of all parameters: maps in key order, results left out."""
    ordered = []
    for f in RUN_SCHEMA.fields:
        if f.name == "results":
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.map_entries(c))
        elif isinstance(f.dataType, T.StructType):
            c = F.struct(
                *[
                    F.array_sort(F.map_entries(c[g.name])).alias(g.name)
                    if isinstance(g.dataType, T.MapType)
                    else c[g.name].alias(g.name)
                    for g in f.dataType.fields
                ]
            )
        ordered.append(c.alias(f.name))
    return runs.withColumn(name, F.sha2(F.to_json(F.struct(*ordered)), 256))
