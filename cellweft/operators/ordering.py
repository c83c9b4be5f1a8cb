"""Exact row numbers, cut points and first-n selections without a one-task sort.

Spark has no distributed ROW_NUMBER over a whole table: a window without partition keys, or with one
very large partition, sorts everything in one task.  These helpers cut the order into ranges whose
bounds come from a hash sample of the keys.  The sample only balances the work; results are exact and
do not depend on it.  Bounds are a scalar subquery.  Inputs that cost more than reading are written once, and then read
for each step with the columns that it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.session import evaluated_once

SAMPLE_PER_BUCKET = 20
HOT_SHARE = 1024  # fewer than this many groups can each hold 1/1024 of a table
HOT_ROWS = 1_000_000


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """Reproducible pseudo-random order of rows: md5 over the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def row_total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _bucket_count(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_range_bucket(df: DataFrame, keys: Sequence[str], name: str = "_bucket") -> DataFrame:
    """Add the number of the key range a row falls in: a lower key never has a higher number."""
    buckets = _bucket_count(df.sparkSession)
    wanted = buckets * SAMPLE_PER_BUCKET
    keep_one_in = F.greatest(F.lit(1), F.floor(row_total(df) / wanted).cast("bigint"))
    sample = (
        df.select(F.struct(*keys).alias("k"))
        .where(F.pmod(F.xxhash64("k"), keep_one_in) == 0)
        .agg(F.sort_array(F.collect_list("k")).alias("s"))
    )
    bounds = sample.select(
        F.transform(
            F.sequence(F.lit(1), F.lit(buckets - 1)),
            lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / buckets).cast("int")),
        ).alias("b")
    ).scalar()
    # binary search: jump by falling powers of two while the bound there is not above the key
    steps = [1 << p for p in range(buckets.bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(F.col("_bounds"), at + step - 1) <= F.col("_key"), at + step).otherwise(at),
    )
    return (
        df.withColumn("_bounds", bounds)
        .withColumn("_key", F.struct(*keys))
        .withColumn(name, found)
        .drop("_bounds", "_key")
    )


def with_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based row number within `by` (the whole table when empty) in a unique `order`.

    Groups are numbered by a window each, but for those of more than `hot_rows` rows, and the whole table, which are
    numbered range by range.
    """
    by = list(by)
    df = evaluated_once(df)
    if not by:
        return _position_by_range(df, order, by, name)
    hot = hot_keys(df, by, hot_rows)
    if hot is None:
        return _position_by_group(df, order, by, name)
    hot = F.broadcast(hot.withColumnsRenamed({c: f"_h_{c}" for c in by}))
    is_hot = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by])
    large = _position_by_range(df.join(hot, is_hot, "left_semi"), order, by, name)
    return large.unionByName(_position_by_group(df.join(hot, is_hot, "left_anti"), order, by, name))


def _position_by_group(df: DataFrame, order: Sequence[str], by: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def _position_by_range(df: DataFrame, order: Sequence[str], by: list[str], name: str) -> DataFrame:
    """A group may be any size: it is numbered range by range, and the ranges' starts are added back."""
    cut = with_range_bucket(df, [*by, *order])
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # each range border lies inside at most one group, so no more rows than ranges are left here
    starts = (
        counts.withColumn("_start", F.sum("_n").over(before))
        .where("_start > 0")
        .select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_bucket").alias("_s_bucket"), "_start")
    )
    match = F.col("_bucket") == F.col("_s_bucket")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    local = Window.partitionBy("_bucket", *by).orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(starts), match, "left")
        .withColumn(name, (F.col("_rn") + F.coalesce("_start", F.lit(0))).cast("bigint"))
        .select(*df.columns, name)
    )


def key_at(df: DataFrame, order: Sequence[str], rank: Callable[[Column], Column]) -> Column:
    """The order key (a struct) of the row at 1-based position rank(total); null when there is none.

    Only the keys are read.  Counting per range finds the one range that holds the position, and only
    that range is sorted.
    """
    df = evaluated_once(df.select(*order))
    keys = with_range_bucket(df, order)
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_rank", rank(row_total(df)).cast("bigint"))
        .where((F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto")))
        .select("_bucket", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    inside = keys.where(F.col("_bucket") == cut.select("_bucket").scalar())
    ranked = inside.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return ranked.where(F.col("_rn") == cut.select("_rank").scalar()).select(F.struct(*order)).scalar()


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The largest groups with more than `hot_rows` rows, or None.

    A small job reads the key columns only.  At most 1023 keys come back; any group left out is smaller
    than 1/1024 of the table, so it needs no special care.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    found = counts.orderBy(F.desc("_n")).limit(HOT_SHARE - 1).select(*by)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def first_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    name: str = "row_pos",
    bounded: bool = False,
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
) -> DataFrame:
    """First n rows of each group in a unique order, with their 1-based position.

    Spark cuts each map task's share to n rows per group before the shuffle (window group limit).  A hot
    group still brings n rows from every map task to one task, so hot groups are first cut in salted
    parts.  `bounded` says that no group is large, as after an earlier cut; then nothing is counted.
    """
    by = list(by)
    whole = Window.partitionBy(*by).orderBy(*order)

    def cut(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn(name, F.row_number().over(whole).cast("bigint"))
        return ranked.where(F.col(name) <= n).select(*df.columns, name)

    df = df if bounded else evaluated_once(df)
    hot = None if bounded else hot_keys(df, by, hot_rows)
    if hot is None:
        return cut(df)
    hot = F.broadcast(hot.withColumnsRenamed({c: f"_h_{c}" for c in by}))
    is_hot = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by])
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    salted = (
        df.join(hot, is_hot, "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        .withColumn("_part_pos", F.row_number().over(part))
        .where(F.col("_part_pos") <= n)
    )
    return cut(df.join(hot, is_hot, "left_anti")).unionByName(cut(salted))
