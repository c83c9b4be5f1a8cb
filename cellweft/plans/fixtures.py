"""The test tables seen as corpora of tables, in Spark and as the same SQL text.

Two corpora are used:

* the database: eight relational tables in long cell form.  Some columns are renamed to names that say
  nothing and some values are blanked, so that every branch of the operators is met;
* many small tables: the orders of each customer and the line items of each supplier are a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators.column_states import merged_states, table_states
from cellweft.operators.corpus import COLUMNS_SCHEMA, row_counts, to_cells, union_cells
from cellweft.operators.ordering import with_position
from cellweft.session import spread

# table: (db_id, row id, [(source column, kind, shown name, blank where)])
DATABASE = {
    "region": ("sales", "r_regionkey", [("r_regionkey", "int", "id", None), ("r_name", "text", "region name", None)]),
    "nation": (
        "sales",
        "n_nationkey",
        [("n_nationkey", "int", "col1", None), ("n_name", "text", "n_2", None), ("n_regionkey", "int", "id", None)],
    ),
    "customer": (
        "sales",
        "c_custkey",
        [
            ("c_custkey", "int", "c_custkey", None),
            ("c_name", "text", "c_name", None),
            ("c_nationkey", "int", "c_nationkey", "c_custkey % 7 = 0"),
            ("c_acctbal", "float", "c_acctbal", "c_custkey % 7 = 3"),
            ("c_mktsegment", "text", "c_mktsegment", None),
        ],
    ),
    "supplier": (
        "sales",
        "s_suppkey",
        [
            ("s_suppkey", "int", "s_suppkey", "s_suppkey % 7 = 2"),
            ("s_name", "text", "s_name", None),
            ("s_nationkey", "int", "col1", None),
            ("s_acctbal", "float", "12", "s_suppkey >= 0"),
        ],
    ),
    "part": (
        "sales",
        "p_partkey",
        [
            ("p_partkey", "int", "p_partkey", None),
            ("p_name", "text", "p_name", None),
            ("p_brand", "text", "p_brand", None),
            ("p_type", "text", "p_type", "p_partkey % 7 = 5"),
            ("p_size", "int", "p_size", None),
            ("p_retailprice", "float", "p_retailprice", None),
        ],
    ),
    "orders": (
        "sales",
        "o_orderkey",
        [
            ("o_orderkey", "int", "o_orderkey", None),
            ("o_custkey", "int", "o_custkey", None),
            ("o_orderstatus", "text", "o_orderstatus", None),
            ("o_totalprice", "float", "o_totalprice", "o_orderkey % 7 = 0"),
            ("o_orderdate", "time", "o_orderdate", None),
            ("o_orderpriority", "text", "o_orderpriority", None),
        ],
    ),
    "lineitem": (
        "sales",
        "l_orderkey * 8 + l_linenumber",
        [
            ("l_orderkey", "int", "l_orderkey", None),
            ("l_partkey", "int", "l_partkey", None),
            ("l_suppkey", "int", "l_suppkey", None),
            ("l_linenumber", "int", "l_linenumber", None),
            ("l_quantity", "float", "l_quantity", None),
            ("l_extendedprice", "float", "l_extendedprice", None),
            ("l_discount", "float", "l_discount", None),
            ("l_tax", "float", "l_tax", None),
            ("l_returnflag", "text", "l_returnflag", None),
            ("l_linestatus", "text", "l_linestatus", None),
            ("l_shipdate", "time", "l_shipdate", None),
        ],
    ),
    "events": (
        "web",
        "event_id",
        [
            ("event_id", "int", "event_id", None),
            ("user_id", "int", "user_id", None),
            ("event_type", "text", "event_type", None),
            ("value", "float", "value", None),
            ("props", "text", "props", None),
        ],
    ),
}
DTYPES = {"int": "int64", "float": "float64", "text": "object", "time": "object"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, the one large table; a small file is one split and is spread over the cores."""
    return spread(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, which cost much per row."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _spark_value(name: str, kind: str, blank: str | None) -> Column:
    col = F.col(name)
    if kind == "float":
        col = col.cast("decimal(18,2)")
    elif kind == "time":
        col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return F.when(~F.expr(blank), col) if blank else col


def _spark_text(name: str, kind: str, blank: str | None) -> Column:
    return _spark_value(name, kind, blank).cast("string")


def _sql_text(name: str, kind: str, blank: str | None) -> str:
    text = f"CAST({name} AS VARCHAR)"
    if kind == "float":
        text = f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"
    elif kind == "time":
        text = f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CASE WHEN NOT ({blank}) THEN {text} END" if blank else text


def database_columns(spark: SparkSession) -> DataFrame:
    rows = [
        (table, i, shown, DTYPES[kind])
        for table, (_, _, cols) in DATABASE.items()
        for i, (_, kind, shown, _) in enumerate(cols)
    ]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def database_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(db, t) for t, (db, _, _) in DATABASE.items()], "db_id string, table_id string")


def database_cells(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(DTYPES)) -> DataFrame:
    """Cells of all columns, or of those of some kinds, which are then the only ones read."""
    parts = []
    for t, (_, row, cols) in DATABASE.items():
        wanted = {i: _spark_text(n, k, b) for i, (n, k, _, b) in enumerate(cols) if k in kinds}
        if wanted:
            rows = lines(spark, sf_dir) if t == "lineitem" else load(spark, sf_dir, t)
            parts.append(to_cells(rows, t, F.expr(row), list(wanted.values()), list(wanted)))
    return union_cells(parts)


def database_states(spark: SparkSession, sf_dir: str, first: int = 0, keys: str | None = "all") -> DataFrame:
    """States of all columns, from the wide tables; values are those of database_cells."""
    parts = []
    for t, (_, row, cols) in DATABASE.items():
        rows = lines(spark, sf_dir) if t == "lineitem" else load(spark, sf_dir, t)
        values = {i: _spark_value(n, k, b) for i, (n, k, _, b) in enumerate(cols)}
        parts.append(table_states(rows, t, F.expr(row), values, first, keys))
    return merged_states(union_cells(parts), first)


def database_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: load(spark, sf_dir, t) for t in DATABASE})


def _columns_sql() -> str:
    rows = ", ".join(
        f"('{t}', {i}, '{shown}', '{DTYPES[kind]}')"
        for t, (_, _, cols) in DATABASE.items()
        for i, (_, kind, shown, _) in enumerate(cols)
    )
    return f"SELECT * FROM (VALUES {rows}) AS v(table_id, col_idx, col_name, dtype)"


def _cells_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_id, CAST({row} AS BIGINT) AS row_id, {i} AS col_idx, {_sql_text(n, k, b)} AS value FROM {t}"
        for t, (_, row, cols) in DATABASE.items()
        for i, (n, k, _, b) in enumerate(cols)
    )


def _tables_sql() -> str:
    rows = ", ".join(f"('{db}', '{t}')" for t, (db, _, _) in DATABASE.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(db_id, table_id)"


# CTEs that open the SQL of every query on the database corpus
DATABASE_SQL = f"""cols AS ({_columns_sql()}), dbs AS ({_tables_sql()}), cells AS MATERIALIZED ({_cells_sql()}),
groups AS MATERIALIZED (SELECT table_id, col_idx, value, count(*) AS n, min(row_id) AS first_row
  FROM cells GROUP BY ALL),
sizes AS (SELECT c.table_id, CAST(count(DISTINCT c.col_idx) AS BIGINT) AS n_cols,
  CAST(max((SELECT count(*) FROM cells x WHERE x.table_id = c.table_id AND x.col_idx = 0)) AS BIGINT) AS n_rows
  FROM cols c GROUP BY 1),
profiles AS (SELECT c.*, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(CASE WHEN g.value IS NULL THEN g.n ELSE 0 END), 0) AS BIGINT) AS n_nulls,
  CAST(count(g.value) AS BIGINT) AS n_distinct
  FROM cols c LEFT JOIN groups g USING (table_id, col_idx) GROUP BY ALL),
pk AS (SELECT table_id, coalesce(arg_min(col_name, col_idx) FILTER (WHERE n_distinct = n_rows AND n_nulls = 0), '')
  AS primary_key FROM profiles GROUP BY 1)"""

# --- many small tables -----------------------------------------------------------------------------

ITEM_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
ITEM_SHOWN = [
    ("l_partkey", "int", None),
    ("l_quantity", "float", "l_orderkey % 7 = 0"),
    ("l_extendedprice", "float", "l_suppkey % 7 = 0"),
    ("l_discount", "float", None),
    ("l_returnflag", "text", None),
    ("l_shipdate", "time", None),
]


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, where the items of one supplier are one table."""
    return lines(spark, sf_dir).withColumn("table_id", F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")))


def supplier_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplier rows with their position `row_pos` in the table."""
    return with_position(supplier_rows(spark, sf_dir), ITEM_ORDER, by=["table_id"], name="row_pos")


def supplier_columns(rows: DataFrame) -> DataFrame:
    """Declared columns of the supplier tables: every table of this corpus has the same ones."""
    declared = F.array(
        *[
            F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.lit(DTYPES[k]).alias("dtype"))
            for i, (n, k, _) in enumerate(ITEM_SHOWN)
        ]
    )
    return rows.select("table_id").distinct().select("table_id", F.inline(declared))


def supplier_cells(rows: DataFrame) -> DataFrame:
    """Cells of supplier rows that carry their position `row_pos` in the table."""
    return to_cells(rows, F.col("table_id"), "row_pos", [_spark_text(n, k, b) for n, k, b in ITEM_SHOWN])


_SHOWN_SQL = " UNION ALL ".join(
    f"SELECT table_id, row_pos AS row_id, {i} AS col_idx, '{n}' AS col_name, '{DTYPES[k]}' AS dtype, {_sql_text(n, k, b)} AS value FROM scanned"
    for i, (n, k, b) in enumerate(ITEM_SHOWN)
)
_NUMBERED_SQL = f"""SELECT 'supplier_' || CAST(l_suppkey AS VARCHAR) AS table_id, *,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ITEM_ORDER)}) AS row_pos FROM lineitem"""
# the first 500 rows of each table, for the queries whose feature is that bound
SUPPLIER_SQL = f"""scanned AS MATERIALIZED (SELECT * FROM ({_NUMBERED_SQL}) WHERE row_pos <= 500),
cells AS MATERIALIZED ({_SHOWN_SQL})"""
# whole tables
SUPPLIER_ALL_SQL = f"""scanned AS MATERIALIZED ({_NUMBERED_SQL}), cells AS MATERIALIZED ({_SHOWN_SQL})"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, where the orders of one customer are one table."""
    return load(spark, sf_dir, "orders").withColumn("table_id", F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of many tables: one per customer, its width between 3 and 11 columns."""
    return (
        order_rows(spark, sf_dir)
        .groupBy("table_id", "o_custkey")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("table_id", "n_rows", (F.col("o_custkey") % 9 + 3).alias("n_cols"))
    )


ORDER_TABLES_SQL = """tables AS MATERIALIZED (SELECT 'customer_' || CAST(o_custkey AS VARCHAR) AS table_id,
  count(*) AS n_rows, o_custkey % 9 + 3 AS n_cols FROM orders GROUP BY o_custkey)"""
