"""Manifests, examples, vectors and predictions on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.functions.text import format_gold_line, one_line
from cellweft.operators.ordering import with_position
from cellweft.sources.splits import json_objects

EXAMPLE_SCHEMA = "instruction string, answer string, path_csvs array<string>, db_id string, question_id string"


def write_manifest(classified: DataFrame, out: str) -> None:
    """Paths under their class: classified(table_id, path, cls)."""
    classified.write.mode("overwrite").partitionBy("cls").parquet(out)


def read_manifest(spark: SparkSession, path: str, cls: str | None = None, idx: DataFrame | None = None) -> DataFrame:
    """Manifest rows, of one class if asked (only its folder is read), and by position if idx(position) is
    given; positions count from 0 in path order."""
    rows = spark.read.parquet(path)
    if cls is not None:
        rows = rows.where(F.col("cls") == cls)
    if idx is None:
        return rows
    numbered = with_position(rows, ["path"], name="_p").withColumn("position", F.col("_p") - 1).drop("_p")
    return numbered.join(idx, "position", "left_semi")


def read_examples(spark: SparkSession, path: str, json_list: bool = True, schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    """Examples from JSON with a declared schema.

    Files with a JSON list are cut into their objects by as many tasks as they have splits; JSON lines
    (`json_list=False`) need no such search.
    """
    if not json_list:
        return spark.read.schema(schema).json(path)
    return json_objects(spark, path).select(F.from_json("value", schema).alias("x")).select("x.*")


def write_vectors(vectors: DataFrame, out: str) -> None:
    """Vectors by database: vectors(db_id, table_id, row_id, col_idx, vector)."""
    vectors.write.mode("overwrite").partitionBy("db_id").parquet(out)


def read_vectors(spark: SparkSession, path: str, db_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if db_id is None else rows.where(F.col("db_id") == db_id)


def write_predictions(predictions: DataFrame, out: str, key: str = "question_id") -> None:
    """Records as JSON, and predictions and gold as text lines in the same order.

    Rows that share a key are ordered by what they say, so line n of both files is the same record.
    """
    ordered = predictions.orderBy(key, "pred", "gold", "db_id")
    predictions.write.mode("overwrite").json(f"{out}/model_output")
    ordered.select(one_line("pred").alias("value")).write.mode("overwrite").text(f"{out}/pred")
    ordered.select(format_gold_line("gold", "db_id").alias("value")).write.mode("overwrite").text(f"{out}/gold")


def resume_or_compute(todo: DataFrame, store: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored results, after the missing ones were computed and added."""
    spark = todo.sparkSession
    try:
        stored = spark.read.parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    missing = todo if stored is None else todo.join(stored.select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(store)
    return spark.read.parquet(store)
