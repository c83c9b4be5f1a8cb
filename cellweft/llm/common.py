"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.session import work_folder


def stored(df: DataFrame, part: str) -> DataFrame:
    """The frame written to the cluster's shared folder and read again: lineage ends here."""
    path = f"{work_folder(df.sparkSession)}/{part}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def grouped(batches, n_keys: int):
    """Lists of rows (tuples) with equal first n_keys columns, from batches sorted by them; a group may span batches."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield held
                held, key = [], row[:n_keys]
            held.append(row)
    if held:
        yield held
