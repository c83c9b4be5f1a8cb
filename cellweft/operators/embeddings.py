"""Pooling, similarity and contrastive loss over vectors, and vectors for cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.functions import vectors as vec
from cellweft.functions.sequences import words
from cellweft.operators.joins import join_hot, join_small
from cellweft.session import evaluated_once

TEMPERATURE = 0.07
POOL_FLOOR = 1e-9
WIDTHS = 100

# Rows that stand before a vocabulary.
SPECIAL_TOKENS = ("[CLS]", "[SEP]")
UNUSED_TOKENS = 100


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str, dim: int, mask: str | None = None, out: str = "vector") -> DataFrame:
    """Mean vector per group, over rows with mask 1 where a mask is given.

    One sum per component: the partial sums of a group meet in the shuffle, never its vectors, and no row is
    multiplied by the number of components.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    sums = [F.sum(F.get(F.col(vector), F.lit(i)).cast("double") * weight).alias(f"_s{i}") for i in range(dim)]
    total = df.groupBy(*by).agg(F.sum(weight).alias("_w"), *sums)
    floor = F.greatest(F.col("_w"), F.lit(POOL_FLOOR))
    return total.select(*by, F.array(*[F.col(f"_s{i}") / floor for i in range(dim)]).alias(out))


def mean_pool(tokens: DataFrame, key: Sequence[str], dim: int) -> DataFrame:
    """Masked mean of token vectors: tokens(key, vector, mask)."""
    return mean_vectors(tokens, key, "vector", dim, mask="mask")


def pool_rows(cells: DataFrame, dim: int) -> DataFrame:
    """Column vectors: the mean over a table's valid rows, where the first column's mask says which rows
    are valid.  cells(table_id, row_pos, col_idx, vector, mask)."""
    valid = cells.where("col_idx = 0 AND mask = 1").select("table_id", "row_pos")
    return mean_vectors(cells.join(valid, ["table_id", "row_pos"]), ["table_id", "col_idx"], "vector", dim)


def drop_zero_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.where(vec.norm(vector) > vec.ZERO_NORM)


def add_name_vector(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Add the vector of a column's name to each cell vector: names(table_id, col_idx, name_vector)."""
    joined = join_small(cells, names, ["table_id", "col_idx"])
    return joined.withColumn("vector", vec.add_vectors("vector", "name_vector")).drop("name_vector")


def semantic_vs_isolated(in_table: DataFrame, isolated: DataFrame) -> DataFrame:
    """Cosine of each column's vector in its table with its vector as a table of its own."""
    other = isolated.withColumnRenamed("vector", "isolated")
    return in_table.join(other, ["table_id", "col_idx"]).select(
        "table_id", "col_idx", vec.cosine_similarity(vec.l2_normalize("vector"), vec.l2_normalize("isolated")).alias("similarity")
    )


def cosine_by_width(similarities: DataFrame, widths: int = WIDTHS) -> DataFrame:
    """Mean similarity per table, then per number of columns; tables with mean 0 are not counted, and a
    width without tables shows 0.  Widths run from 0 to `widths - 1`, or to the widest table."""
    tables = similarities.groupBy("table_id").agg(
        F.avg("similarity").alias("m"), F.count(F.lit(1)).alias("n_cols")
    )
    by_width = tables.groupBy("n_cols").agg(
        F.coalesce(F.try_divide(F.sum("m"), F.count_if(F.col("m") != 0)), F.lit(0.0)).alias("similarity")
    )
    top = by_width.agg(F.greatest(F.max("n_cols"), F.lit(widths - 1)).alias("top"))
    all_widths = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("n_cols"))
    return all_widths.join(by_width, "n_cols", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def pairwise_similarity(batches: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Dot product of every query with every key of its batch, over the temperature.

    batches(batch_id, item, query, key) come from assign_batch, so a batch is small and its pairs are the
    result.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(batch["query"].to_numpy()).astype(np.float64)
        k = np.stack(batch["key"].to_numpy()).astype(np.float64)
        sims = q @ k.T / temperature
        items = batch["item"].to_numpy()
        n = len(items)
        return pd.DataFrame(
            {
                "batch_id": batch["batch_id"].iloc[0],
                "query_item": np.repeat(items, n),
                "key_item": np.tile(items, n),
                "similarity": sims.ravel(),
            }
        )

    return batches.groupBy("batch_id").applyInPandas(run, "batch_id bigint, query_item bigint, key_item bigint, similarity double")


def contrastive_loss(batches: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """InfoNCE per batch: each anchor against all shuffled vectors and all other anchors of the batch; the
    shuffled vector of the same item is the right one.

    batches(batch_id, item, anchor, shuffled) come from assign_batch, so a batch is small.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("item")
        a = np.stack(batch["anchor"].to_numpy()).astype(np.float64)
        s = np.stack(batch["shuffled"].to_numpy()).astype(np.float64)
        logits = np.concatenate([a @ s.T, a @ a.T], axis=1) / temperature
        n = len(a)
        logits[np.arange(n), n + np.arange(n)] = -np.inf
        top = logits.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
        losses = total - logits[np.arange(n), np.arange(n)]
        return pd.DataFrame({"batch_id": [batch["batch_id"].iloc[0]], "n_items": [n], "loss": [float(losses.mean())]})

    return batches.groupBy("batch_id").applyInPandas(run, "batch_id bigint, n_items bigint, loss double")


def contrastive_loss_tiled(batches: DataFrame, temperature: float = TEMPERATURE, tile: int = 1024) -> DataFrame:
    """contrastive_loss for batches of any size: (batch_id, n_items, loss).

    A batch is dealt into tiles of about `tile` items, and each tile of anchors meets each tile of keys by itself.  What such a
    product leaves of an anchor is the largest logit and the sum of exponents beside it; these states are merged, so a
    task holds two tiles, never a batch, and no similarity becomes a row.
    """
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    dealt = join_small(batches, sizes.withColumn("_tiles", F.ceil(F.col("_n") / tile)), "batch_id")
    dealt = dealt.withColumn("_tile", F.pmod(F.xxhash64("item"), F.col("_tiles")))
    packed = "batch_id bigint, _tiles bigint, _tile bigint, items binary, anchors binary, shuffled binary"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        data = [np.stack(rows[c].to_numpy()).astype(np.float64).tobytes() for c in ("anchor", "shuffled")]
        row = [*(int(rows[c].iloc[0]) for c in ("batch_id", "_tiles", "_tile")), rows["item"].to_numpy(np.int64).tobytes(), *data]
        return pd.DataFrame([row], columns=["batch_id", "_tiles", "_tile", "items", "anchors", "shuffled"])

    tiles = evaluated_once(dealt.groupBy("batch_id", "_tile").applyInPandas(pack, packed), "tiles")
    # a tile of anchors goes to each tile of keys of its batch
    asked = tiles.select("batch_id", F.col("_tile").alias("tile"), "items", "anchors", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    keys = tiles.select("batch_id", F.col("_tile").alias("_other"), F.col("items").alias("key_items"), F.col("anchors").alias("key_anchors"), "shuffled")
    state = "batch_id bigint, tile bigint, items binary, top binary, total binary, own binary"

    def product(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                items, others = np.frombuffer(row.items, np.int64), np.frombuffer(row.key_items, np.int64)
                a, b, s = (np.frombuffer(x, np.float64) for x in (row.anchors, row.key_anchors, row.shuffled))
                a, b, s = a.reshape(len(items), -1), b.reshape(len(others), -1), s.reshape(len(others), -1)
                same = items[:, None] == others[None, :]
                cross, inner = a @ s.T / temperature, np.where(same, -np.inf, a @ b.T / temperature)
                top = np.maximum(cross.max(axis=1), inner.max(axis=1))
                total = np.exp(cross - top[:, None]).sum(axis=1) + np.exp(inner - top[:, None]).sum(axis=1)
                own = np.where(same, cross, 0.0).sum(axis=1)
                out.append((row.batch_id, row.tile, row.items, top.tobytes(), total.tobytes(), own.tobytes()))
            yield pd.DataFrame(out, columns=["batch_id", "tile", "items", "top", "total", "own"])

    both = asked.join(keys, ["batch_id", "_other"]).select("batch_id", "tile", "items", "anchors", "key_items", "key_anchors", "shuffled")
    partial = both.mapInPandas(product, state)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        top, total, own = (np.stack([np.frombuffer(x, np.float64) for x in rows[c]]) for c in ("top", "total", "own"))
        best = top.max(axis=0)
        losses = best + np.log((total * np.exp(top - best)).sum(axis=0)) - own.sum(axis=0)
        return pd.DataFrame({"batch_id": [rows["batch_id"].iloc[0]], "n": [len(losses)], "loss": [float(losses.sum())]})

    summed = partial.groupBy("batch_id", "tile").applyInPandas(merge, "batch_id bigint, n bigint, loss double")
    return summed.groupBy("batch_id").agg(F.sum("n").alias("n_items"), (F.sum("loss") / F.sum("n")).alias("loss"))


def running_loss_mean(metrics: DataFrame, step: str, value: str, log_interval: int) -> DataFrame:
    """Mean of a metric over each block of `log_interval` steps; steps count from 1.

    A block with gaps counts as long as it is over: only the last block, if its last step is missing, is left out.
    """
    block = F.floor((F.col(step) - 1) / log_interval).cast("bigint")
    last = metrics.agg(F.max(step)).first()[0] or 0
    means = metrics.groupBy(block.alias("block")).agg(F.avg(value).alias("mean_value"))
    return means.where((F.col("block") + 1) * log_interval <= last)


def native_vector(dim: int) -> Callable[[Column], Column]:
    """Feature hashing of a value's words: no model, and no Python."""
    return lambda value: vec.hashed_features(words(value), dim)


def embed_cells(cells: DataFrame, embed: Callable[[Column], Column], distinct: bool = False) -> DataFrame:
    """A vector for every cell.  With `distinct`, for costly models, each distinct value is embedded once and
    joined back; otherwise cells are embedded where they are."""
    filled = cells.withColumn("value", F.coalesce("value", F.lit("nan")))
    if not distinct:
        return filled.withColumn("vector", embed(F.col("value")))
    filled = evaluated_once(filled, "cells")
    vectors = filled.select("value").distinct().withColumn("vector", embed(F.col("value")))
    return join_hot(filled, vectors, "value")


def counted_cells(cells: DataFrame) -> DataFrame:
    """Equal cells of a column as one row, with their number `n_cells`: what is summed up by column needs no row per cell."""
    return cells.groupBy("table_id", "col_idx", "value").agg(F.count(F.lit(1)).alias("n_cells"))


def model_hook(encode: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A user's embedding model as a column function: a series of texts to a series of vectors."""
    udf = F.pandas_udf(encode, "array<float>")
    return lambda value: udf(value)


def special_token_rows(spark: SparkSession, vocab: DataFrame, n_unused: int = UNUSED_TOKENS) -> DataFrame:
    """A vocabulary(word, id) behind its special tokens, with ids moved up."""
    fixed = spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id int, word string")
    unused = spark.range(n_unused).select(
        (F.col("id") + len(SPECIAL_TOKENS)).cast("int").alias("id"), F.format_string("[unused%d]", F.col("id")).alias("word")
    )
    moved = vocab.select((F.col("id") + len(SPECIAL_TOKENS) + n_unused).cast("int").alias("id"), "word")
    return fixed.unionByName(unused).unionByName(moved)
