"""Column profiles, example values, key inference and mean imputation over a cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.column_states import COL, column_states
from cellweft.operators.joins import join_small
from cellweft.session import evaluated_once

SHORTEN_AT = 80
EXAMPLES = 3


def value_groups(cells: DataFrame) -> DataFrame:
    """One row per distinct value of a column, with its count and first row: all values are shuffled.

    column_states tells what profiles and examples need without that; this is for those who need the values.
    """
    return cells.groupBy(*COL, "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def profile_columns(found: DataFrame, columns: DataFrame) -> DataFrame:
    """Null and distinct counts per column, from column_states or value_groups.  A column without rows counts as unique and non-null."""
    stats = found
    if "value" in found.columns:
        stats = found.groupBy(*COL).agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
            F.count("value").alias("n_distinct"),
        )
    zero = F.lit(0).cast("bigint")
    counts = ("n_rows", "n_nulls", "n_distinct")
    return (
        columns.join(stats.select(*COL, *counts), COL, "left")
        .select(*columns.columns, *[F.coalesce(c, zero).alias(c) for c in counts])
        .withColumn("contains_null", F.col("n_nulls") > 0)
        .withColumn("is_unique", F.col("n_distinct") == F.col("n_rows"))
        .withColumn(
            "pandas_dtype",
            F.when((F.col("dtype") == "int64") & F.col("contains_null"), "float64").otherwise(F.col("dtype")),
        )
    )


def infer_primary_key(profiles: DataFrame) -> DataFrame:
    """First column, by position, that is unique and has no nulls; empty text if none is."""
    fits = F.col("is_unique") & ~F.col("contains_null")
    return profiles.groupBy("table_id").agg(
        F.coalesce(F.min_by(F.when(fits, F.col("col_name")), F.when(fits, F.col("col_idx"))), F.lit("")).alias("primary_key")
    )


def find_primary_key(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The same as infer_primary_key over full profiles, by a search for witnesses against each column.

    One scan: a task that meets a null or a value for the second time drops the column, so only columns that no task
    could refute by itself have their keys compared over all tasks.
    """
    return primary_key_of(column_states(cells, keys="unrepeated"), columns)


def primary_key_of(states: DataFrame, columns: DataFrame) -> DataFrame:
    """The key by states that were made with keys "unrepeated"."""
    marked = columns.join(states.select(*COL, "repeated"), COL, "left")
    whole = marked.withColumn("is_unique", ~F.coalesce("repeated", F.lit(False))).withColumn("contains_null", F.lit(False))
    return infer_primary_key(whole)


def shorten(text):
    return F.when(F.length(text) > SHORTEN_AT, F.concat(F.substring(text, 1, SHORTEN_AT), F.lit("...."))).otherwise(text)


def firsts_needed(valuecount: int | None = None, exclude: bool = False) -> int:
    """How many first values example_values reads: one more than it shows, to know that there are more, and the excluded one."""
    return (EXAMPLES if valuecount is None else valuecount) + 1 + exclude


def example_values(
    found: DataFrame, columns: DataFrame, exclude: DataFrame | None = None, valuecount: int | None = None
) -> DataFrame:
    """First distinct non-null values of each column in order of appearance, as array<string>.

    found are column_states with firsts_needed first values, or value_groups.  More than three values: three are kept (two for
    floats) and `...` is added.  With `valuecount` both limits are that number.  `exclude(table_id, col_idx, value)` leaves
    out one value of a column.
    """
    limit = EXAMPLES if valuecount is None else valuecount
    if "value" in found.columns:
        # one more than the limit, and the value that is left out, is enough to know that there are more
        order = Window.partitionBy(*COL).orderBy("first_row", "value")
        few = found.where("value is not null").withColumn("pos", F.row_number().over(order))
        few = few.where(F.col("pos") <= firsts_needed(valuecount, exclude is not None))
        found = few.groupBy(*COL).agg(F.array_sort(F.collect_list(F.struct("first_row", "value"))).alias("firsts"))
    lists = found.select(*COL, F.transform("firsts", lambda x: x["value"]).alias("v"))
    if exclude is not None:
        one = exclude.select(*COL, F.col("value").alias("_out"))
        lists = lists.join(one, COL, "left").withColumn("v", F.filter("v", lambda x: ~x.eqNullSafe(F.col("_out")))).drop("_out")
    texts = F.transform("v", shorten)
    keep = F.when((F.col("dtype") == "float64") & F.lit(valuecount is None), 2).otherwise(limit)
    return columns.join(lists, COL, "left").select(
        *columns.columns,
        F.coalesce(
            F.when(F.size("v") > limit, F.concat(F.slice(texts, F.lit(1), keep), F.array(F.lit("...")))).otherwise(texts),
            F.array().cast("array<string>"),
        ).alias("examples"),
    )


def attach_comments(columns: DataFrame, comments: DataFrame) -> DataFrame:
    """Add the comment of each column, empty where there is none: comments(table_id, col_name, comment)."""
    return columns.join(comments, ["table_id", "col_name"], "left").withColumn("comment", F.coalesce("comment", F.lit("")))


def impute_mean(cells: DataFrame, columns: DataFrame, bounded: bool = False) -> DataFrame:
    """Numeric nulls become the column mean, or 0 where all are null; adds `number DOUBLE`.

    Numbers are averaged as decimals, so the mean does not depend on the order of the rows.  A column may
    be any size: its mean is a partial aggregate joined back.  After a bounded scan (`bounded`) the mean is
    a window, which keeps the partitioning by table and needs no join.
    """
    numeric = columns.where(F.col("dtype").isin("int64", "float64")).select(*COL)
    numbers = join_small(cells, numeric, COL, "left_semi").withColumn("_d", F.col("value").try_cast("decimal(38,10)"))
    if bounded:
        numbers = numbers.withColumn("_mean", F.avg("_d").over(Window.partitionBy(*COL)))
    else:
        numbers = evaluated_once(numbers)
        numbers = join_small(numbers, numbers.groupBy(*COL).agg(F.avg("_d").alias("_mean")), COL)
    number = F.coalesce(F.col("value").try_cast("double"), F.col("_mean").cast("double"), F.lit(0.0))
    return numbers.withColumn("number", number).drop("_d", "_mean")
