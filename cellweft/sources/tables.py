"""Reading corpora of tables: folders of CSV files, SQLite files and catalogue tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.functions.text import path_parts
from cellweft.sources.splits import csv_records, read_pieces

WRITES_AT_ONCE = 8
ROWS_SCHEMA = "db_id string, table_name string, row_id bigint, values array<string>"
# Words that stand for a missing value.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# one field and the comma after it; every line gets a closing comma first
_FIELD = '("(?:[^"]|"")*"|[^,]*),'


def extract_tables(tables: Mapping[tuple[str, str], DataFrame], out: str) -> None:
    """Write each named table as CSV with a header under <out>/<db_id>/<table>; tables are written side by side."""

    def write(item) -> None:
        (db_id, name), df = item
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/{db_id}/{name}")

    with ThreadPoolExecutor(WRITES_AT_ONCE) as pool:
        list(pool.map(write, tables.items()))


def catalogue_tables(spark: SparkSession, databases: Iterable[str]) -> dict[tuple[str, str], DataFrame]:
    """All tables of catalogue databases, as input of extract_tables."""
    return {
        (db, t.name): spark.table(f"`{db}`.`{t.name}`") for db in databases for t in spark.catalog.listTables(db) if not t.isTemporary
    }


def discover_tables(spark: SparkSession, root: str, extension: str = "csv") -> DataFrame:
    """Files with an extension anywhere below a folder: path, database and table from the path, size.

    The file contents are not read, since only the listing's columns are selected.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(root)
    )
    db_id, table = path_parts("path")
    return files.select("path", db_id.alias("db_id"), table.alias("table_name"), F.col("length").alias("n_bytes"))


def _fields(line: Column, null_words: Iterable[str] = ("",)) -> Column:
    """The fields of one CSV record; a null word is null."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_FIELD), F.lit(1))
    quoted = lambda x: F.startswith(x, F.lit('"'))
    bare = lambda x: F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(raw, lambda x: F.when(quoted(x), bare(x)).otherwise(x))
    return F.transform(plain, lambda x: F.when(~x.isin(*null_words), x))


def read_csv_corpus(
    spark: SparkSession, root: str, folder_is_table: bool = False, null_words: Iterable[str] = NULL_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All CSV files below a folder, whatever their columns: (rows, columns, rejects).

    rows(table_id, file_start, line_id, values) order by (file_start, line_id); columns has the inferred
    dtypes; a table with a record of more fields than its header, or with a quote that is never closed, is left out and
    listed in rejects.  A short record is filled with nulls, empty lines are skipped, and quotes may hold line breaks.  Lines
    are read as text, so a large file is split over many tasks.  With `folder_is_table` all files of a folder
    are one table, as Spark writes it, and the table's name is the folder's.
    """
    # a file's header is the first record of its first split
    lines, open_files = csv_records(read_pieces(spark, root, "*.csv"))
    lines = lines.where("value != ''")
    heads = (
        lines.where("file_start = 0").groupBy("path").agg(F.min("line_id").alias("head_id"), F.min_by("value", "line_id").alias("head"))
    )
    table = F.concat_ws("/", *path_parts("path")) if not folder_is_table else F.concat_ws("/", F.element_at(F.split("path", "/"), -3), F.element_at(F.split("path", "/"), -2))
    body = (
        lines.join(heads, "path")
        .where("NOT (file_start = 0 AND line_id = head_id)")
        .select(table.alias("table_id"), "file_start", "line_id", _fields(F.col("value"), null_words).alias("values"), F.size(_fields(F.col("head"))).alias("width"))
    )
    misfit = F.size("values") > F.col("width")
    filled = F.concat("values", F.transform(F.array_repeat(F.lit(0), F.col("width") - F.size("values")), lambda _: F.lit(None).cast("string")))
    bad = body.where(misfit).select("table_id", F.lit("line does not fit header").alias("reason"))
    bad = bad.unionByName(open_files.select(table.alias("table_id"), F.lit("quote left open").alias("reason")))
    rejects = bad.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_bad"), F.max("reason").alias("reason"))
    good = body.join(rejects.select("table_id"), "table_id", "left_anti").withColumn("values", filled)
    named = heads.select(table.alias("table_id"), F.posexplode(_fields(F.col("head"))).alias("col_idx", "col_name")).distinct()
    named = named.join(rejects.select("table_id"), "table_id", "left_anti")
    cells = good.select("table_id", F.posexplode("values").alias("col_idx", "value"))
    return good.select("table_id", "file_start", "line_id", "values"), _typed(named, cells), rejects


def _typed(named: DataFrame, cells: DataFrame) -> DataFrame:
    """Columns with the dtype that all their values read as; integers with gaps are floats."""
    fits = cells.groupBy("table_id", "col_idx").agg(
        F.bool_and(F.col("value").isNull() | F.rlike("value", F.lit("^[+-]?[0-9]+$"))).alias("ints"),
        F.bool_and(F.col("value").isNull() | F.col("value").try_cast("double").isNotNull()).alias("floats"),
        F.bool_and(F.coalesce(F.col("value").isin("True", "False", "true", "false"), F.lit(False))).alias("bools"),
        F.bool_or(F.col("value").isNull()).alias("gaps"),
    )
    dtype = (
        F.when(F.col("bools"), "bool")
        .when(F.col("ints") & ~F.col("gaps"), "int64")
        .when(F.col("floats"), "float64")
        .otherwise("object")
    )
    return named.join(fits, ["table_id", "col_idx"], "left").select("table_id", "col_idx", "col_name", dtype.alias("dtype"))


def sqlite_rows(spark: SparkSession, paths: list[str], rows_per_task: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """All rows of all tables of SQLite files on a shared path: (rows, rejects).

    Tables are cut by row id, so that a large table is read by many tasks; a file that cannot be read is
    listed in rejects and the others go on.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)), "path")

    def list_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                    for (table,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
                        try:
                            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
                        except sqlite3.OperationalError:  # a table without row ids is one part
                            low, high = None, None
                        if low is None:
                            found.append((path, table, None, None, None))
                        else:
                            found += [(path, table, a, min(a + rows_per_task - 1, high), None) for a in range(low, high + 1, rows_per_task)]
                    con.close()
                except sqlite3.Error as error:
                    found.append((path, None, None, None, str(error)))
            yield pd.DataFrame(found, columns=["path", "table_name", "low", "high", "error"]).astype({"low": "Int64", "high": "Int64"})

    parts = files.mapInPandas(list_parts, "path string, table_name string, low bigint, high bigint, error string")

    def read_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame.itertuples(index=False):
                con = sqlite3.connect(f"file:{part.path}?mode=ro", uri=True)
                if pd.isna(part.low):
                    cursor = con.execute(f'SELECT NULL, * FROM "{part.table_name}"')
                else:
                    cursor = con.execute(
                        f'SELECT rowid, * FROM "{part.table_name}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (int(part.low), int(part.high))
                    )
                db_id, at = part.path.rsplit("/", 2)[-2], 0
                while batch := cursor.fetchmany(10_000):
                    ids = [r[0] if r[0] is not None else at + i + 1 for i, r in enumerate(batch)]
                    at += len(batch)
                    texts = [[None if v is None else str(v) for v in r[1:]] for r in batch]
                    yield pd.DataFrame({"db_id": db_id, "table_name": part.table_name, "row_id": ids, "values": texts})
                con.close()

    cores = spark.sparkContext.defaultParallelism
    todo = parts.where("error IS NULL").repartition(cores * 4, "path", "table_name", "low")
    return todo.mapInPandas(read_parts, ROWS_SCHEMA), parts.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


def row_cells(rows: DataFrame) -> DataFrame:
    """Rows with a list of values as cells."""
    return rows.select("table_id", "row_id", F.posexplode("values").alias("col_idx", "value"))
