"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps, as Parquet for the next one.

All stages but the last return the columns of docs, whatever others there are and whatever they are called.  Long texts are
taken whole; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweft.llm import bpe, decontamination, jaccard_join, language_id, suffix_dedup
from cellweft.llm.common import stored

#: Documents with a lower mean probability for their best language are in none.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null texts among them, and those in no known language go.

    Rows that repeat stay or go together; without a labelled row all go.
    """
    return language_id.keep_known(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Null texts are nobody's copies; of rows that share text and doc_id one stays.
    """
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document that loses all its text goes.

    Null texts stay null; rows that share a doc_id, and rows without one, take nothing from each other.
    """
    return suffix_dedup.cut_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows that repeat stay or go together."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids, in place of columns of these names; null texts have neither."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("token_ids", token_ids),
]
#: SQL cannot express the trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
