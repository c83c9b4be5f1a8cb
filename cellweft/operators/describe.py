"""Schema lines per table and schema text per database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker where a column's vector goes, and the shape of a schema line.
PLACEHOLDER = "<insert_embs>"
TABLE_LINE = "table %s, columns = [%s]"


def quote_identifier(name: str | Column, lower: bool = False) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    col = F.lower(col) if lower else col
    return F.when(F.contains(col, F.lit(" ")), F.concat(F.lit('"'), col, F.lit('"'))).otherwise(col)


def describe_table(
    profiles: DataFrame,
    keys: DataFrame,
    examples: DataFrame | None = None,
    mode: str = "novalue",
    lower: bool = False,
    placeholder: str = PLACEHOLDER,
) -> DataFrame:
    """One schema line per table: name, marker, dtype and key of each column, with values if asked.

    `novalue` shows none; `values` and `valuecount` show `examples` and differ in where the key mark is.
    """
    if mode not in ("novalue", "values", "valuecount"):
        raise ValueError(f"unknown mode {mode}")
    cols = profiles.join(keys, "table_id")
    is_key = F.col("col_name") == F.col("primary_key")
    tail = F.when(is_key, "|primary key").otherwise("")
    if mode != "novalue":
        cols = cols.join(examples.select("table_id", "col_idx", "examples"), ["table_id", "col_idx"])
        raw = F.col("pandas_dtype").isin("int64", "float64", "bool")
        shown = F.transform(
            "examples", lambda x: F.when(raw | (x == "..."), x).otherwise(F.concat(F.lit("'"), x, F.lit("'")))
        )
        values = F.concat(F.lit("values: "), F.array_join(shown, ", "))
        if mode == "values":
            tail = F.concat(F.lit("|"), F.when(is_key, "primary key|").otherwise(""), values)
        else:
            tail = F.concat(tail, F.lit("|"), values)
    part = F.concat(
        "table_id", F.lit("."), quote_identifier("col_name", lower), F.lit(f"({placeholder}|"), "pandas_dtype", tail, F.lit(")")
    )
    # a table's columns are few, so collecting them into one row is bounded
    parts = cols.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", part.alias("t")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), ", ")
    return parts.select("table_id", F.format_string(TABLE_LINE, F.col("table_id"), joined).alias("line"))


def zip_tables_keys(tables: DataFrame, keys: DataFrame, lines: DataFrame) -> DataFrame:
    return tables.join(keys, "table_id").join(lines, "table_id")


def describe_database(lines: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """Schema text per database: its tables' lines, then its foreign keys(db_id, fk) if it has any."""
    texts = lines.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    if foreign_keys is None:
        return texts.select("db_id", text.alias("schema_text"))
    return texts.join(key_suffix(foreign_keys), "db_id", "left").select(
        "db_id", F.concat(text, F.coalesce("suffix", F.lit(""))).alias("schema_text")
    )


def key_suffix(foreign_keys: DataFrame) -> DataFrame:
    """The foreign keys(db_id, fk) of each database as the end of its schema text: (db_id, suffix)."""
    keys = foreign_keys.groupBy("db_id").agg(F.array_sort(F.collect_list("fk")).alias("k"))
    return keys.select("db_id", F.concat(F.lit("\nForeign keys: ["), F.array_join("k", ", "), F.lit("]\n")).alias("suffix"))
