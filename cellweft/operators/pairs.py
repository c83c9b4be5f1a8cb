"""Pairs of tables, and table names resolved from loose keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.joins import join_small
from cellweft.operators.ordering import first_rows, with_position


def _partners(i: Column, n: Column, first: int, limit: int) -> Column:
    """Right partners of row i of n when pairs (i, j), j >= i + first, are listed in order up to `limit`.

    The number of pairs before row i is known in closed form, so only pairs that are kept are made.
    """
    before = i * n - (i * (i - 1) / 2).cast("bigint") - i * first
    last = F.least(n - 1, i + first + (limit - before) - 1)
    return F.when((before < limit) & (i + first <= last), F.sequence(i + first, last))


def pair_all(tables: DataFrame, key: str, limit: int) -> DataFrame:
    """Pairs (i <= j) in order of the key; the list holds `limit` pairs at most."""
    # the first `limit` tables hold every pair that can be kept, so these windows see a bounded input
    head = tables.select(key).orderBy(key).limit(limit)
    ranked = head.select(
        key,
        (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint").alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    left = ranked.select(F.col(key).alias("left_id"), "i", F.explode(_partners(F.col("i"), F.col("n"), 0, limit)).alias("j"))
    right = ranked.select(F.col(key).alias("right_id"), F.col("i").alias("j"))
    return left.join(right, "j").select("left_id", "right_id")


def pair_same_width(tables: DataFrame, seed: int, limit: int) -> DataFrame:
    """Per width: the first `limit` pairs of different tables, and as many random tables paired with
    themselves."""
    head = first_rows(tables.select("table_id", "n_cols"), ["n_cols"], ["table_id"], limit + 1, name="_pos")
    width = Window.partitionBy("n_cols")
    ranked = head.select(
        "n_cols", "table_id", (F.col("_pos") - 1).alias("i"), F.count(F.lit(1)).over(width).alias("n")
    )
    left = ranked.select(
        "n_cols", F.col("table_id").alias("left_id"), F.explode(_partners(F.col("i"), F.col("n"), 1, limit)).alias("j")
    )
    right = ranked.select("n_cols", F.col("table_id").alias("right_id"), F.col("i").alias("j"))
    negatives = left.join(right, ["n_cols", "j"]).select("n_cols", "left_id", "right_id", F.lit("different").alias("kind"))

    sizes = tables.groupBy("n_cols").agg(F.count(F.lit(1)).alias("n"))
    made = F.least(F.lit(limit), (F.col("n") * (F.col("n") - 1) / 2)).cast("int")
    draws = sizes.where("n > 1").select("n_cols", "n", F.explode(F.sequence(F.lit(1), made)).alias("k"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("n_cols").cast("string"), F.col("k").cast("string"))), 1, 8)
    picks = draws.select(
        "n_cols", (F.conv(digits, 16, 10).cast("bigint") % F.col("n") + 1).alias("_pos")
    )
    numbered = with_position(tables.select("table_id", "n_cols"), ["table_id"], by=["n_cols"], name="_pos")
    positives = picks.join(numbered, ["n_cols", "_pos"]).select(
        "n_cols", F.col("table_id").alias("left_id"), F.col("table_id").alias("right_id"), F.lit("same").alias("kind")
    )
    return negatives.unionByName(positives)


def resolve_table_name(keys: DataFrame, names: DataFrame, scope: Sequence[str] = ("db_id",)) -> DataFrame:
    """keys(scope, key) to names(scope, name): an equal name first, else the first name holding the key.

    Names are cut at their first dot and case is ignored.  Names are cut into all pieces of the lengths that
    keys have, each piece keeps its first name, and keys meet pieces as a whole; `tier` is `equal`, `contains` or `missing`.
    """
    scope = list(scope)
    low = names.select(*scope, F.substring_index("name", ".", 1).alias("name")).withColumn("low", F.lower("name"))
    wanted = keys.select(*scope, "key").distinct().withColumn("low", F.lower("key"))
    equal = wanted.join(low, [*scope, "low"]).groupBy(*scope, "key").agg(F.min("name").alias("equal_name"))
    rest = wanted.join(equal, [*scope, "key"], "left_anti")
    # pieces of the lengths that keys have, so that a key meets the names that hold it and no others
    lengths = rest.groupBy(*scope).agg(F.collect_set(F.length("low")).alias("lengths"))
    of_length = lambda k: F.transform(
        F.when(F.length("low") >= k, F.sequence(F.lit(1), F.length("low") - k + 1)), lambda p: F.substr("low", p, k)
    )
    pieces = F.array_distinct(F.flatten(F.transform("lengths", lambda k: F.coalesce(of_length(k), F.array().cast("array<string>")))))
    parts = join_small(low, lengths, scope).select(*scope, "name", F.explode(pieces).alias("low"))
    first = parts.groupBy(*scope, "low").agg(F.min("name").alias("held_name"))
    held = rest.join(first, [*scope, "low"]).select(*scope, "key", "held_name")
    found = keys.join(equal, [*scope, "key"], "left").join(held, [*scope, "key"], "left")
    return found.select(
        *keys.columns,
        F.coalesce("equal_name", "held_name").alias("name"),
        F.when(F.col("equal_name").isNotNull(), "equal")
        .when(F.col("held_name").isNotNull(), "contains")
        .otherwise("missing")
        .alias("tier"),
    )
