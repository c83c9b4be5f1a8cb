"""Instruction examples: their tables, their token ids and their padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions import sequences as seq
from cellweft.operators.joins import join_hot, join_small
from cellweft.operators.ordering import with_position
from cellweft.session import evaluated_once, use_checkpoints

# ids below this number, of words of no more than so many bytes, are sent to every executor
COMMON_IDS = 200_000
COMMON_BYTES = 64


def example_columns(examples: DataFrame, columns: DataFrame, key: str, tables: str = "path_csvs") -> DataFrame:
    """All columns of all tables of an example, in table order and then column order."""
    listed = examples.select(key, F.posexplode(tables).alias("table_pos", "table_id"))
    return join_small(listed, columns, "table_id")


def column_sequence(listed: DataFrame, key: str) -> DataFrame:
    """The columns of an example as one array (an example names few tables)."""
    item = F.struct("table_pos", "col_idx", F.concat_ws(".", "table_id", "col_name").alias("name"))
    arrays = listed.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("c"))
    return arrays.select(key, F.transform("c", lambda x: x["name"]).alias("columns"))


def split_by_placeholder(examples: DataFrame, placeholder: str, text: str = "instruction") -> tuple[DataFrame, DataFrame]:
    """(examples with a placeholder, rejects with a reason)."""
    has = F.contains(F.col(text), F.lit(placeholder))
    return examples.where(has), examples.where(~has).withColumn("reason", F.lit("no placeholder"))


def placeholder_column_check(
    examples: DataFrame, table_widths: DataFrame, key: str, placeholder: str, text: str = "instruction"
) -> DataFrame:
    """Examples whose number of placeholders differs from the number of columns of their tables."""
    named = examples.select(key, F.explode("path_csvs").alias("table_id"))
    widths = (
        join_small(named, table_widths.select("table_id", "n_cols"), "table_id")
        .groupBy(key)
        .agg(F.sum("n_cols").alias("n_columns"))
    )
    found = (F.length(text) - F.length(F.replace(F.col(text), F.lit(placeholder), F.lit("")))) / len(placeholder)
    return (
        examples.select(key, found.cast("bigint").alias("n_placeholders"))
        .join(widths, key, "left")
        .withColumn("n_columns", F.coalesce("n_columns", F.lit(0)).cast("bigint"))
        .where("n_placeholders <> n_columns")
    )


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """Words with an id by falling frequency, from 0.

    The word counts are checkpointed, since numbering them reads them several times and they are far
    smaller than the texts.
    """
    use_checkpoints(texts.sparkSession)
    counts = texts.select(F.explode(seq.words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("_neg", -F.col("n")).checkpoint()
    return with_position(keyed, ["_neg", "word"], name="_p").select("word", "n", (F.col("_p") - 1).cast("int").alias("id"))


def tokenise_by_vocabulary(texts: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Ids of a text by a vocabulary join.

    The words of the lowest ids, which `vocabulary` gives to the most frequent words, meet their ids where they stand; only the
    others are shuffled by word.  Any ids give the same result.
    """
    placed = texts.select(key, F.posexplode(seq.words(text)).alias("pos", "word"))
    vocab = evaluated_once(vocab.select("word", "id"), "vocabulary")
    is_common = F.coalesce(F.col("id").between(0, COMMON_IDS - 1) & (F.octet_length("word") <= COMMON_BYTES), F.lit(False))
    common = F.broadcast(vocab.where(is_common))
    rare = join_hot(placed.join(common, "word", "left_anti"), vocab.where(~is_common), "word")
    found = placed.join(common, "word").unionByName(rare)
    # the array holds one text's tokens
    back = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("w"))
    ids = back.select(key, F.col("w.id").alias("ids"))
    return texts.select(key).join(ids, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def tokenise(texts: DataFrame, text: str, hook: Callable[[pd.Series], pd.Series], out: str = "ids") -> DataFrame:
    """Ids by a user's tokenizer: the hook maps a series of texts to a series of id lists, batch by batch."""
    encode = F.pandas_udf(hook, "array<int>")
    return texts.withColumn(out, encode(F.col(text)))


def supervised_ids(
    pairs: DataFrame, encode: Callable[[Column], Column], source: str = "source", target: str = "target"
) -> DataFrame:
    """input_ids of source + target, and labels with the source's part ignored."""
    ids = encode(F.concat(source, target))
    return pairs.withColumn("input_ids", ids).withColumn(
        "labels", seq.mask_prompt_labels("input_ids", F.size(encode(F.col(source))))
    )


def collate_pad(batches: DataFrame, pad_id: int, left: bool = False, batch: str = "batch_id") -> DataFrame:
    """Pad ids and labels to the longest of the batch; adds the attention mask.

    Takes assign_batch's output, so a batch is small.
    """
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    return (
        batches.withColumn("_len", longest)
        .withColumn("input_ids", seq.pad_ids("input_ids", "_len", pad_id, left))
        .withColumn("labels", seq.pad_ids("labels", "_len", seq.IGNORE_LABEL, left))
        .withColumn("attention_mask", seq.attention_mask("input_ids", pad_id))
        .drop("_len")
    )


def token_stats(cells: DataFrame, columns: DataFrame, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Largest number of tokens of a cell per column; a numeric cell has one token."""
    count = count or (lambda c: F.size(seq.words(c)))
    kinds = columns.select("table_id", "col_idx", F.col("dtype").isin("int64", "float64").alias("_num"))
    tokens = F.when(F.col("_num"), 1).otherwise(count(F.coalesce("value", F.lit("nan"))))
    return (
        join_small(cells, kinds, ["table_id", "col_idx"])
        .groupBy("table_id", "col_idx")
        .agg(F.max(tokens).alias("max_tokens"), F.sum(tokens).cast("bigint").alias("n_tokens"))
    )


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = 3000) -> DataFrame:
    """A user's function over batches of at most `batch_size` rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield fn(frame.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)


def chunked_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int) -> DataFrame:
    """A user's function over the data split in `workers` parts; the parts come back as one table."""
    return batched_map(df.repartition(workers), fn, schema)


def flatten_results(df: DataFrame, results: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of an array of results."""
    return df.select(*keep, F.explode(results).alias("result"))
