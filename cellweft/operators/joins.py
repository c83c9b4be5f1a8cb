"""Joins of a large table with a dimension that is usually, but not surely, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.operators.ordering import HOT_ROWS, hot_keys
from cellweft.session import evaluated_once

SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a value: texts and nested values by their length, others eight."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(col)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def is_small(dim: DataFrame, small_rows: int = SMALL_ROWS, small_bytes: int = SMALL_BYTES) -> bool:
    """Whether a dimension is small in rows and in bytes; counting stops one row past the limit."""
    size = sum((_bytes(f) for f in dim.schema.fields), F.lit(0)).cast("bigint")
    n, total = dim.select(size.alias("b")).limit(small_rows + 1).agg(F.count("*"), F.sum("b")).first()
    return n <= small_rows and (total or 0) <= small_bytes


def join_small(df: DataFrame, dim: DataFrame, on: str | list[str], how: str = "inner", small_rows: int = SMALL_ROWS) -> DataFrame:
    """Join with a dimension that is broadcast only if it is found to be small.

    Few dimension keys mean few, very large groups on the other side, which a shuffle by that key would
    put into few tasks.  A larger dimension is joined by a shuffle, where adaptive execution splits skewed
    partitions.  The dimension is evaluated once, to measure and to join it.
    """
    dim = evaluated_once(dim, "dimension")
    return df.join(F.broadcast(dim) if is_small(dim, small_rows) else dim, on, how)


def join_hot(df: DataFrame, dim: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join with a dimension of unique keys, any of which may stand for a large part of the rows.

    The largest keys, 1023 at most, are joined by a broadcast of their few dimension rows; all other keys by a
    shuffle, where none of them is large.
    """
    df = evaluated_once(df)
    hot = hot_keys(df, [on], hot_rows)
    if hot is None:
        return df.join(dim, on)
    hot = F.broadcast(hot)
    few = F.broadcast(dim.join(hot, on, "left_semi"))
    rest = df.join(hot, on, "left_anti").join(dim, on)
    return rest.unionByName(df.join(few, on).select(*rest.columns))
