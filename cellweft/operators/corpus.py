"""The long cell form of a corpus of tables, its dimensions, and the filters on them.

    columns(table_id, col_idx, col_name, dtype)      one row per declared column
    cells(table_id, row_id, col_idx, value STRING)   one row per cell
    tables(table_id, n_rows, n_cols)                 one row per table
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.operators.joins import join_small
from cellweft.operators.ordering import first_rows, with_position

COLUMNS_SCHEMA = "table_id string, col_idx int, col_name string, dtype string"

# Shapes of a column name that says nothing about its content.
NON_SEMANTIC_NAMES = (
    "^[A-Za-z]+[0-9]+$",
    "^[0-9]+$",
    "^[a-zA-Z]{1,2}$",
    "^[a-zA-Z]+_[0-9]+$",
)


def dtype_name(data_type: T.DataType) -> str:
    """The pandas-style dtype text of a Spark type."""
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float64"
    return "bool" if isinstance(data_type, T.BooleanType) else "object"


def columns_of(spark: SparkSession, tables: dict[str, DataFrame], skip: Sequence[str] = ()) -> DataFrame:
    """The declared columns of named DataFrames; empty tables have rows here too."""
    rows = [
        (name, i, f.name, dtype_name(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(f for f in df.schema.fields if f.name not in skip)
    ]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def to_cells(
    df: DataFrame, table_id: str | Column, row_id: str | Column, values: Sequence[Column | str], numbers: Sequence[int] | None = None
) -> DataFrame:
    """Unpivot one wide table: a narrow step, no shuffle.  `numbers` gives the col_idx of each value, else 0, 1, ..."""
    table = F.lit(table_id) if isinstance(table_id, str) else table_id
    cells = F.array(
        *[
            F.struct(F.lit(numbers[i] if numbers else i).alias("col_idx"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value"))
            for i, v in enumerate(values)
        ]
    )
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    return df.select(
        table.alias("table_id"), row.cast("bigint").alias("row_id"), F.inline(cells)
    )


def union_cells(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each wide table, before any unpivot: no column is read.  Empty tables have no row here."""
    return union_cells(
        [df.select(F.lit(name).alias("table_id")).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    )


def table_sizes(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows and columns per table, from row counts and declared columns."""
    cols = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cols"))
    return cols.join(rows, "table_id", "left").select(
        "table_id", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.col("n_cols").cast("bigint").alias("n_cols")
    )


def filter_by_size(tables: DataFrame, min_rows: int = 10, min_cols: int = 3) -> DataFrame:
    """Tables with enough rows and columns."""
    return tables.where((F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols))


def is_non_semantic_name(name: str | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    test = F.lit(False)
    for pattern in NON_SEMANTIC_NAMES:
        test = test | col.rlike(pattern)
    return test


def classify_tables(columns: DataFrame) -> DataFrame:
    """`non_semantic` when at least half of the column names are, else `semantic`."""
    flag = is_non_semantic_name("col_name").cast("int")
    return (
        columns.groupBy("table_id")
        .agg(F.sum(flag).alias("n_non_semantic"), F.count(F.lit(1)).alias("n_cols"))
        .withColumn("cls", F.when(F.col("n_non_semantic") * 2 >= F.col("n_cols"), "non_semantic").otherwise("semantic"))
    )


def numeric_columns(columns: DataFrame) -> DataFrame:
    return columns.where(F.col("dtype").isin("int64", "float64"))


def convertible_columns(cells: DataFrame) -> DataFrame:
    """Does every non-null value of a column read as a number?"""
    ok = F.col("value").isNull() | F.col("value").try_cast("double").isNotNull()
    return cells.groupBy("table_id", "col_idx").agg(F.bool_and(ok).alias("is_convertible"))


def width_histogram(tables: DataFrame) -> DataFrame:
    return tables.groupBy("n_cols").agg(F.count(F.lit(1)).alias("n_tables"))


def number_in_width_group(tables: DataFrame) -> DataFrame:
    """Running number of each table among the tables of its width."""
    return with_position(tables, ["table_id"], by=["n_cols"], name="number")


def bounded_scan(df: DataFrame, table_id: Sequence[str], order: Sequence[str], n: int = 500, **kw) -> DataFrame:
    """First n rows of every table in file order, with the position in the table."""
    return first_rows(df, table_id, order, n, name="row_pos", **kw)


def stringify(cells: DataFrame, columns: DataFrame, pandas_compat: bool = False) -> DataFrame:
    """Every value as text, nulls as `nan`.

    With `pandas_compat` a table that has only numeric columns and at least one float column shows its
    integers as floats, as one common array type would.
    """
    if not pandas_compat:
        return cells.withColumn("value", F.coalesce("value", F.lit("nan")))
    kinds = columns.groupBy("table_id").agg(
        (F.bool_and(F.col("dtype").isin("int64", "float64")) & F.bool_or(F.col("dtype") == "float64")).alias("_upcast")
    )
    ints = columns.select("table_id", "col_idx", (F.col("dtype") == "int64").alias("_int"))
    traits = ints.join(kinds, "table_id")
    return (
        join_small(cells, traits, ["table_id", "col_idx"])
        .withColumn(
            "value",
            F.coalesce(F.when(F.col("_upcast") & F.col("_int"), F.concat("value", F.lit(".0"))).otherwise(F.col("value")), F.lit("nan")),
        )
        .drop("_upcast", "_int")
    )
