"""Seeded samples, splits, batches and shards.

Random order is the md5 of a seed and the row's key, so a sample is the same on every run, on every
cluster size and after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.joins import join_small
from cellweft.operators.ordering import first_rows, hash_key, key_at, row_total, with_position


def sample_rows(
    rows: DataFrame, n: int, seed: int, by: Sequence[str] = ("table_id",), pos: str = "row_pos", bounded: bool = False, **kw
) -> DataFrame:
    """Tables over n rows keep n random rows in random order, others keep theirs; adds `sample_pos`.

    The n + 1 rows of least random key say both which rows a table over n keeps and whether it is one, so no
    table is counted.
    """
    by = list(by)
    keyed = rows.withColumn("_rnd", hash_key(seed, *by, pos))
    few = first_rows(keyed, by, ["_rnd", pos], n + 1, name="_least", bounded=bounded, **kw)
    table = Window.partitionBy(*by)  # at most n + 1 rows each
    over = F.max("_least").over(table) > n
    kept = few.withColumn("_over", over).where(~F.col("_over") | (F.col("_least") <= n))
    place = F.row_number().over(table.orderBy(F.when(F.col("_over"), F.col("_least")).otherwise(0), pos))
    return kept.withColumn("sample_pos", place.cast("bigint")).select(*rows.columns, "sample_pos")


def _ranked_columns(columns: DataFrame, seed: int) -> DataFrame:
    """Columns with their random rank in the table; a table's columns are few."""
    return columns.withColumn("_rnd", hash_key(seed, "table_id", "col_idx")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("table_id").orderBy("_rnd", "col_idx"))
    )


def sample_columns(columns: DataFrame, max_col: int, seed: int) -> DataFrame:
    """Tables over max_col columns keep that many random ones in random order; adds `col_pos` from 0."""
    table = Window.partitionBy("table_id")
    ranked = _ranked_columns(columns, seed).withColumn("_over", F.count(F.lit(1)).over(table) > max_col)
    return (
        ranked.withColumn("col_pos", F.when(F.col("_over"), F.col("_rank") - 1).otherwise(F.col("col_idx")))
        .where(F.col("col_pos") < max_col)
        .drop("_rnd", "_rank", "_over")
    )


def permute_columns(columns: DataFrame, seed: int) -> DataFrame:
    """A random permutation of each table's columns: position `pos` (from 0) holds column `src_idx`."""
    return _ranked_columns(columns, seed).select(
        "table_id", (F.col("_rank") - 1).alias("pos"), F.col("col_idx").alias("src_idx")
    )


def truncate_random(
    rows: DataFrame,
    columns: DataFrame,
    max_row: int,
    max_col: int,
    seed: int,
    pos: str = "row_pos",
    bounded: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Random order of rows and of columns, first max_row and max_col kept with their new positions."""
    keyed = rows.withColumn("_rnd", hash_key(seed, "table_id", pos))
    kept = first_rows(keyed, ["table_id"], ["_rnd", pos], max_row, name="new_row", bounded=bounded).drop("_rnd")
    cols = permute_columns(columns, seed).where(F.col("pos") < max_col)
    return kept, cols.select("table_id", F.col("src_idx").alias("col_idx"), F.col("pos").alias("new_col"))


def split_train_valid(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Exactly floor(n/20) random rows are `valid`, the others `train`.  Rows are not shuffled.

    With fewer than 20 rows all are `train`.
    """
    keys = df.select(hash_key(seed, key).alias("_h"), key)
    last = key_at(keys, ["_h", key], lambda n: n - F.floor(n / 20))
    return df.withColumn("split", F.when(F.struct(hash_key(seed, key), key) <= last, "train").otherwise("valid"))


def split_ordered(df: DataFrame, key: str) -> DataFrame:
    """The last ceil(n/10) rows in key order are `eval`, the others `train`."""
    last = key_at(df.select(key), [key], lambda n: n - F.ceil(n / 10))
    return df.withColumn("split", F.when(F.struct(key) <= last, "train").otherwise("eval"))


def head_sample(df: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """First n rows in order; all of them when n is not given."""
    return df if n is None else df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows without replacement."""
    return df.orderBy(hash_key(seed, key), key).limit(n)


def inspect_samples(df: DataFrame, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    return seeded_sample(df, key, k, seed)


def assign_batch(df: DataFrame, order: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of `size` rows, the last one short; adds `batch_id` from 0 and `batch_pos` from 1."""
    return (
        with_position(df, order, by=by, name="_p")
        .withColumn("batch_id", F.floor((F.col("_p") - 1) / size).cast("bigint"))
        .withColumn("batch_pos", ((F.col("_p") - 1) % size + 1).cast("bigint"))
        .drop("_p")
    )


def assign_chunk(df: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """Chunks of floor(n/workers)+1 rows; later chunks may stay empty."""
    size = F.floor(row_total(df) / workers) + 1
    return (
        with_position(df, order, name="_p")
        .withColumn("chunk_id", F.floor((F.col("_p") - 1) / size).cast("bigint"))
        .drop("_p")
    )


def shard_by_rank(df: DataFrame, key: str, world_size: int, shuffle_seed: int | None = None) -> DataFrame:
    """Deal rows in turn to `world_size` shards, in key order or in a seeded random order."""
    order = [key]
    keyed = df
    if shuffle_seed is not None:
        keyed = df.withColumn("_rnd", hash_key(shuffle_seed, key))
        order = ["_rnd", key]
    dealt = with_position(keyed, order, name="_p").withColumn("shard", ((F.col("_p") - 1) % world_size).cast("bigint"))
    return dealt.select(*df.columns, "shard")


def turn_label(position: str | Column) -> Column:
    """`turn 1` .. `turn 4`, then `turn > 4`."""
    at = F.col(position) if isinstance(position, str) else position
    return F.when(at <= 4, F.concat(F.lit("turn "), at.cast("string"))).otherwise("turn > 4")


def label_turns(df: DataFrame, session: Sequence[str], order: Sequence[str]) -> DataFrame:
    return with_position(df, order, by=session, name="_p").withColumn("turn_id", turn_label("_p")).drop("_p")


def every_n_steps(df: DataFrame, step: str, n: int) -> DataFrame:
    return df.where(F.col(step) % n == 0)


def split_anchor_shuffled(rows: DataFrame, pos: str = "sample_pos") -> DataFrame:
    """First floor(n/2) rows of a table are the `anchor` half, the rest the `shuffled` half; adds `half_pos`.

    Takes the output of sample_rows, so a table has no more rows than its cap.
    """
    half = F.floor(F.max(pos).over(Window.partitionBy("table_id")) / 2)
    return (
        rows.withColumn("_half", half)
        .withColumn("half", F.when(F.col(pos) <= F.col("_half"), "anchor").otherwise("shuffled"))
        .withColumn("half_pos", F.when(F.col(pos) <= F.col("_half"), F.col(pos)).otherwise(F.col(pos) - F.col("_half")))
        .drop("_half")
    )


def limited_eval(metrics: DataFrame, batch_id: str, value: str, last_batch: int = 10) -> DataFrame:
    """Mean of a metric over batches 0 .. last_batch only."""
    return metrics.where(F.col(batch_id) <= last_batch).agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_items")
    )
