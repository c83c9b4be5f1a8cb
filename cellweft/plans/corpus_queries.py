"""Queries over the corpus: sizes, names, profiles, example values, schema lines, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import corpus, describe, ordering, profile
from cellweft.operators.joins import join_small
from cellweft.plans import fixtures as fx
from cellweft.plans.registry import Registry
from cellweft.session import kept

reg = Registry()
DB = "WITH " + fx.DATABASE_SQL


def _cells_columns(spark, sf):
    return fx.database_cells(spark, sf), fx.database_columns(spark)


def _sizes(spark, sf):
    return corpus.table_sizes(fx.database_counts(spark, sf), fx.database_columns(spark))


@reg.query("table_sizes", DB + " SELECT table_id, n_rows, n_cols FROM sizes")
def table_sizes(spark, sf):
    return _sizes(spark, sf)


@reg.query(
    "filter_by_size",
    DB + " SELECT table_id, n_rows, n_cols FROM sizes WHERE n_rows >= 10 AND n_cols >= 3",
)
def filter_by_size(spark, sf):
    return corpus.filter_by_size(_sizes(spark, sf))


_NON_SEM = " OR ".join(f"regexp_matches(col_name, '{p}')" for p in corpus.NON_SEMANTIC_NAMES)


@reg.query(
    "is_non_semantic_name",
    DB + f""" SELECT c.table_id, c.col_name, ({_NON_SEM}) AS non_semantic, s.n_rows FROM cols c JOIN sizes s USING (table_id)""",
)
def is_non_semantic_name(spark, sf):
    columns = fx.database_columns(spark).join(fx.database_counts(spark, sf), "table_id")
    return columns.select("table_id", "col_name", corpus.is_non_semantic_name("col_name").alias("non_semantic"), "n_rows")


@reg.query(
    "classify_tables",
    DB
    + f""" SELECT c.table_id, CAST(sum(CASE WHEN {_NON_SEM} THEN 1 ELSE 0 END) AS BIGINT) AS n_non_semantic,
    any_value(s.n_rows) AS n_rows,
    CASE WHEN 2 * sum(CASE WHEN {_NON_SEM} THEN 1 ELSE 0 END) >= count(*) THEN 'non_semantic' ELSE 'semantic' END AS cls
    FROM cols c JOIN sizes s USING (table_id) WHERE s.n_rows >= 10 AND s.n_cols >= 3 GROUP BY 1""",
)
def classify_tables(spark, sf):
    sized = corpus.filter_by_size(_sizes(spark, sf)).select("table_id", "n_rows")
    return corpus.classify_tables(fx.database_columns(spark)).join(sized, "table_id").select("table_id", "n_non_semantic", "n_rows", "cls")


@reg.query(
    "numeric_columns",
    DB
    + """ SELECT c.table_id, c.col_idx, c.col_name, CAST(count(x.value) AS BIGINT) AS n_values FROM cols c
    JOIN cells x USING (table_id, col_idx) WHERE c.dtype IN ('int64', 'float64') GROUP BY ALL""",
)
def numeric_columns(spark, sf):
    cells, columns = fx.database_cells(spark, sf, ("int", "float")), fx.database_columns(spark)
    numeric = corpus.numeric_columns(columns).select("table_id", "col_idx", "col_name")
    return join_small(cells, numeric, ["table_id", "col_idx"]).groupBy(*numeric.columns).agg(F.count("value").alias("n_values"))


@reg.query(
    "convertible_columns",
    DB
    + """ SELECT table_id, col_idx, bool_and(value IS NULL OR TRY_CAST(value AS DOUBLE) IS NOT NULL) AS is_convertible
    FROM cells GROUP BY 1, 2""",
)
def convertible_columns(spark, sf):
    return corpus.convertible_columns(fx.database_cells(spark, sf))


@reg.query(
    "profile_columns",
    DB
    + """ SELECT *, n_nulls > 0 AS contains_null, n_distinct = n_rows AS is_unique,
    CASE WHEN dtype = 'int64' AND n_nulls > 0 THEN 'float64' ELSE dtype END AS pandas_dtype FROM profiles""",
)
def profile_columns(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    return profile.profile_columns(fx.database_states(spark, sf), columns)


@reg.query("infer_primary_key", DB + " SELECT * FROM pk")
def infer_primary_key(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    return profile.primary_key_of(fx.database_states(spark, sf, keys="unrepeated"), columns)


def _examples_sql(limit: int, float_keep: int, exclude: str = "") -> str:
    return f"""ex AS (SELECT c.table_id, c.col_idx, c.col_name, c.dtype, coalesce(e.examples, []) AS examples FROM cols c LEFT JOIN (
    SELECT table_id, col_idx, CASE WHEN max(total) > {limit}
      THEN list(short ORDER BY pos) FILTER (WHERE pos <= CASE WHEN dtype = 'float64' THEN {float_keep} ELSE {limit} END) || ['...']
      ELSE list(short ORDER BY pos) END AS examples
    FROM (SELECT table_id, col_idx, dtype, CASE WHEN length(value) > 80 THEN left(value, 80) || '....' ELSE value END AS short,
        row_number() OVER (PARTITION BY table_id, col_idx ORDER BY first_row, value) AS pos,
        count(*) OVER (PARTITION BY table_id, col_idx) AS total
      FROM groups JOIN cols USING (table_id, col_idx) WHERE value IS NOT NULL {exclude})
    GROUP BY table_id, col_idx, dtype) e USING (table_id, col_idx))"""


_EX_OUT = " SELECT table_id, col_name, array_to_string(examples, ' ; ') AS examples FROM ex"


@reg.query("example_values", f"{DB}, {_examples_sql(3, 2)} {_EX_OUT}")
def example_values(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    found = profile.example_values(fx.database_states(spark, sf, profile.firsts_needed(), None), columns)
    return found.select("table_id", "col_name", F.array_join("examples", " ; ").alias("examples"))


@reg.query("example_values_counted", f"{DB}, {_examples_sql(5, 5)} {_EX_OUT}")
def example_values_counted(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    found = profile.example_values(fx.database_states(spark, sf, profile.firsts_needed(5), None), columns, valuecount=5)
    return found.select("table_id", "col_name", F.array_join("examples", " ; ").alias("examples"))


@reg.query(
    "example_values_excluding",
    f"""{DB}, tops AS (SELECT table_id, col_idx, max(value) AS top FROM groups GROUP BY 1, 2),
    {_examples_sql(3, 2, "AND NOT EXISTS (SELECT 1 FROM tops t WHERE t.table_id = groups.table_id AND t.col_idx = groups.col_idx AND t.top = groups.value)")}
    {_EX_OUT}""",
)
def example_values_excluding(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    top = cells.groupBy("table_id", "col_idx").agg(F.max("value").alias("value")).where("value is not null")
    states = fx.database_states(spark, sf, profile.firsts_needed(exclude=True), None)
    found = profile.example_values(states, columns, exclude=top)
    return found.select("table_id", "col_name", F.array_join("examples", " ; ").alias("examples"))


@reg.query(
    "shorten_value",
    "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '....' ELSE text END AS shown FROM documents",
)
def shorten_value(spark, sf):
    return fx.load(spark, sf, "documents").select("doc_id", profile.shorten(F.col("text")).alias("shown"))


@reg.query(
    "attach_comments",
    DB
    + """ SELECT p.table_id, p.col_name, p.n_distinct, CASE WHEN p.n_nulls > 0 THEN 'has gaps' ELSE '' END AS comment
    FROM profiles p""",
)
def attach_comments(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    profiles = profile.profile_columns(kept(fx.database_states(spark, sf), "states"), columns)
    comments = profiles.where("contains_null").select("table_id", "col_name", F.lit("has gaps").alias("comment"))
    return profile.attach_comments(profiles, comments).select("table_id", "col_name", "n_distinct", "comment")


def _line_sql(part: str) -> str:
    ident = "CASE WHEN contains(ex.col_name, ' ') THEN '\"' || ex.col_name || '\"' ELSE ex.col_name END"
    return f"""lines AS (SELECT table_id, 'table ' || table_id || ', columns = [' || string_agg(
      table_id || '.' || {ident} || '(<insert_embs>|' || pandas_dtype || {part} || ')', ', ' ORDER BY col_idx) || ']' AS line
      FROM (SELECT ex.*, CASE WHEN p.dtype = 'int64' AND p.n_nulls > 0 THEN 'float64' ELSE p.dtype END AS pandas_dtype, pk.primary_key
        FROM ex JOIN profiles p USING (table_id, col_idx) JOIN pk USING (table_id)) ex GROUP BY table_id)"""


_PK = "CASE WHEN col_name = primary_key THEN '|primary key' ELSE '' END"
_PK_VALUES = "'|' || CASE WHEN col_name = primary_key THEN 'primary key|' ELSE '' END"
_SHOW = """array_to_string(list_transform(examples, lambda x: CASE WHEN x = '...' OR pandas_dtype IN ('int64', 'float64') THEN x
 ELSE '''' || x || '''' END), ', ')"""
_LINES = {
    "novalue": _line_sql(_PK),
    "values": _line_sql(f"{_PK_VALUES} || 'values: ' || {_SHOW}"),
    "valuecount": _line_sql(f"{_PK} || '|values: ' || {_SHOW}"),
}


def schema_lines(spark, sf, mode="novalue", valuecount=None):
    """Cells to one schema line per table."""
    cells, columns = _cells_columns(spark, sf)
    first = 0 if mode == "novalue" else profile.firsts_needed(valuecount)
    states = kept(fx.database_states(spark, sf, first), "states")  # a row per column
    profiles = profile.profile_columns(states, columns)
    examples = None if mode == "novalue" else profile.example_values(states, columns, valuecount=valuecount)
    return describe.describe_table(profiles, profile.infer_primary_key(profiles), examples, mode)


@reg.query("describe_table", f"{DB}, {_examples_sql(3, 2)}, {_LINES['novalue']} SELECT * FROM lines")
def describe_table(spark, sf):
    return schema_lines(spark, sf)


@reg.query("describe_table_values", f"{DB}, {_examples_sql(3, 2)}, {_LINES['values']} SELECT * FROM lines")
def describe_table_values(spark, sf):
    return schema_lines(spark, sf, "values")


@reg.query("describe_table_valuecount", f"{DB}, {_examples_sql(2, 2)}, {_LINES['valuecount']} SELECT * FROM lines")
def describe_table_valuecount(spark, sf):
    return schema_lines(spark, sf, "valuecount", 2)


@reg.query(
    "zip_tables_keys",
    f"""{DB}, {_examples_sql(3, 2)}, {_LINES["novalue"]} SELECT d.db_id, d.table_id, pk.primary_key, lines.line
    FROM dbs d JOIN pk USING (table_id) JOIN lines USING (table_id)""",
)
def zip_tables_keys(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    profiles = profile.profile_columns(kept(fx.database_states(spark, sf), "states"), columns)
    keys = profile.infer_primary_key(profiles)
    lines = describe.describe_table(profiles, keys)
    return describe.zip_tables_keys(fx.database_tables(spark), keys, lines)


# the star schema's key pairs; the web database has none
FOREIGN_KEYS = [
    ("sales", "nation.id = region.id"),
    ("sales", "customer.c_nationkey = nation.col1"),
    ("sales", "orders.o_custkey = customer.c_custkey"),
]
_FK_SQL = "fk AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{k}')" for d, k in FOREIGN_KEYS) + ") AS v(db_id, fk))"
DATABASE_TEXT_SQL = f"""{_examples_sql(3, 2)}, {_LINES["novalue"]}, {_FK_SQL},
 described AS (SELECT d.db_id, string_agg(line, chr(10) ORDER BY d.table_id) || coalesce(any_value(f.t), '') AS schema_text
   FROM dbs d JOIN lines USING (table_id)
   LEFT JOIN (SELECT db_id, chr(10) || 'Foreign keys: [' || string_agg(fk, ', ' ORDER BY fk) || ']' || chr(10) AS t
     FROM fk GROUP BY 1) f USING (db_id) GROUP BY 1)"""


def foreign_keys(spark):
    return spark.createDataFrame(FOREIGN_KEYS, "db_id string, fk string")


def database_text(spark, sf):
    """Cells to one schema text per database."""
    return describe.describe_database(schema_lines(spark, sf).join(fx.database_tables(spark), "table_id"), foreign_keys(spark))


@reg.query("describe_database", f"{DB}, {DATABASE_TEXT_SQL} SELECT * FROM described")
def describe_database(spark, sf):
    return database_text(spark, sf)


@reg.query(
    "quote_identifier",
    DB
    + """ SELECT table_id, CASE WHEN contains(col_name, ' ') THEN '"' || lower(col_name) || '"' ELSE lower(col_name) END AS shown,
    n_distinct FROM profiles""",
)
def quote_identifier(spark, sf):
    cells, columns = _cells_columns(spark, sf)
    profiles = profile.profile_columns(fx.database_states(spark, sf), columns)
    return profiles.select("table_id", describe.quote_identifier(F.lower("col_name")).alias("shown"), "n_distinct")


# --- many small tables -----------------------------------------------------------------------------


@reg.query("width_histogram", f"WITH {fx.ORDER_TABLES_SQL} SELECT n_cols, count(*) AS n_tables FROM tables GROUP BY 1")
def width_histogram(spark, sf):
    return corpus.width_histogram(fx.order_tables(spark, sf))


@reg.query(
    "number_in_width_group",
    f"""WITH {fx.ORDER_TABLES_SQL} SELECT table_id, n_cols,
    row_number() OVER (PARTITION BY n_cols ORDER BY table_id) AS number FROM tables""",
)
def number_in_width_group(spark, sf):
    return corpus.number_in_width_group(fx.order_tables(spark, sf)).select("table_id", "n_cols", "number")


@reg.query(
    "bounded_scan",
    f"""WITH {fx.SUPPLIER_SQL} SELECT table_id, row_pos, l_orderkey, l_linenumber, l_partkey,
    CAST(l_quantity AS BIGINT) AS quantity FROM scanned""",
)
def bounded_scan(spark, sf):
    rows = corpus.bounded_scan(fx.supplier_rows(spark, sf), ["table_id"], fx.ITEM_ORDER, 500)
    return rows.select(
        "table_id", "row_pos", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity")
    )


@reg.query(
    "stringify_cells",
    f"WITH {fx.SUPPLIER_ALL_SQL} SELECT table_id, row_id, col_idx, coalesce(value, 'nan') AS value FROM cells",
)
def stringify_cells(spark, sf):
    rows = fx.supplier_numbered(spark, sf)
    return corpus.stringify(fx.supplier_cells(rows), fx.supplier_columns(fx.supplier_rows(spark, sf)))


@reg.query(
    "stringify_numeric_tables",
    f"""WITH {fx.SUPPLIER_ALL_SQL} SELECT table_id, row_id, col_idx,
    coalesce(CASE WHEN dtype = 'int64' THEN value || '.0' ELSE value END, 'nan') AS value FROM cells
    WHERE dtype IN ('int64', 'float64')""",
)
def stringify_numeric_tables(spark, sf):
    rows = fx.supplier_numbered(spark, sf)
    columns = corpus.numeric_columns(fx.supplier_columns(fx.supplier_rows(spark, sf)))
    cells = fx.supplier_cells(rows).join(columns.select("table_id", "col_idx"), ["table_id", "col_idx"], "left_semi")
    return corpus.stringify(cells, columns, pandas_compat=True).select("table_id", "row_id", "col_idx", "value")


@reg.query(
    "impute_mean",
    f"""WITH {fx.SUPPLIER_ALL_SQL} SELECT table_id, row_id, col_idx,
    round(coalesce(TRY_CAST(value AS DECIMAL(18,2)), CAST(avg(TRY_CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY table_id, col_idx) AS DOUBLE), 0), 4) AS number
    FROM cells WHERE dtype IN ('int64', 'float64')""",
)
def impute_mean(spark, sf):
    rows = fx.supplier_numbered(spark, sf)
    cells = profile.impute_mean(fx.supplier_cells(rows), fx.supplier_columns(fx.supplier_rows(spark, sf)))
    return cells.select("table_id", "row_id", "col_idx", F.round("number", 4).alias("number"))


@reg.query(
    "row_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders",
)
def row_numbers(spark, sf):
    orders = fx.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.with_position(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "position")
