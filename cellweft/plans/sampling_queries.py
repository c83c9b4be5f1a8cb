"""Queries over samples, splits, batches, pairs and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import corpus, grid, pairs, profile, sampling
from cellweft.plans import fixtures as fx
from cellweft.plans.registry import Registry

reg = Registry()
SUP = "WITH " + fx.SUPPLIER_SQL
ALL = "WITH " + fx.SUPPLIER_ALL_SQL


def _scanned(spark, sf):
    return corpus.bounded_scan(fx.supplier_rows(spark, sf), ["table_id"], fx.ITEM_ORDER, 500)


# sample of 200 rows per table, as (table_id, row_pos, sample_pos)
SAMPLED_SQL = """sampled AS MATERIALIZED (SELECT * FROM (SELECT table_id, row_pos, row_number() OVER (PARTITION BY table_id
  ORDER BY CASE WHEN n > 200 THEN md5('7|' || table_id || '|' || CAST(row_pos AS VARCHAR)) ELSE '' END, row_pos) AS sample_pos
  FROM (SELECT table_id, row_pos, count(*) OVER (PARTITION BY table_id) AS n FROM scanned)) WHERE sample_pos <= 200)"""


@reg.query("sample_rows", f"{ALL}, {SAMPLED_SQL} SELECT * FROM sampled")
def sample_rows(spark, sf):
    return sampling.sample_rows(fx.supplier_numbered(spark, sf), 200, 7).select("table_id", "row_pos", "sample_pos")


def _ranked_sql(seed: int) -> str:
    return f"""(SELECT table_id, col_idx, col_name, dtype, count(*) OVER (PARTITION BY table_id) AS n,
      row_number() OVER (PARTITION BY table_id ORDER BY md5('{seed}|' || table_id || '|' || CAST(col_idx AS VARCHAR)), col_idx) - 1 AS rnk
      FROM (SELECT DISTINCT table_id, col_idx, col_name, dtype FROM cells))"""


PICKED_SQL = f"""picked AS MATERIALIZED (SELECT table_id, col_idx, col_name, CAST(rnk AS INTEGER) AS col_pos FROM {_ranked_sql(11)} WHERE rnk < 4)"""
PERMUTED_SQL = f"permuted AS MATERIALIZED (SELECT table_id, CAST(rnk AS INTEGER) AS pos, col_idx AS src_idx FROM {_ranked_sql(3)})"


@reg.query("sample_columns", f"{SUP}, {PICKED_SQL} SELECT * FROM picked")
def sample_columns(spark, sf):
    columns = fx.supplier_columns(fx.supplier_rows(spark, sf))
    return sampling.sample_columns(columns, 4, 11).select("table_id", "col_idx", "col_name", "col_pos")


@reg.query("permute_columns", f"{SUP}, {PERMUTED_SQL} SELECT * FROM permuted")
def permute_columns(spark, sf):
    return sampling.permute_columns(fx.supplier_columns(fx.supplier_rows(spark, sf)), 3)


@reg.query(
    "truncate_random",
    f"""{ALL}, {PERMUTED_SQL}, kept AS (SELECT * FROM (SELECT table_id, row_pos, row_number() OVER (PARTITION BY table_id
      ORDER BY md5('3|' || table_id || '|' || CAST(row_pos AS VARCHAR)), row_pos) AS new_row FROM scanned) WHERE new_row <= 50)
    SELECT table_id, k.row_pos, k.new_row, p.src_idx AS col_idx, p.pos AS new_col, c.value FROM kept k JOIN permuted p USING (table_id)
    JOIN cells c ON c.table_id = k.table_id AND c.row_id = k.row_pos AND c.col_idx = p.src_idx WHERE p.pos < 4""",
)
def truncate_random(spark, sf):
    rows, cols = sampling.truncate_random(fx.supplier_numbered(spark, sf), fx.supplier_columns(fx.supplier_rows(spark, sf)), 50, 4, 3)
    places = rows.select("table_id", F.col("row_pos"), "new_row")
    cells = fx.supplier_cells(rows).withColumnRenamed("row_id", "row_pos")
    return cells.join(places, ["table_id", "row_pos"]).join(cols, ["table_id", "col_idx"]).select(
        "table_id", "row_pos", "new_row", "col_idx", "new_col", "value"
    )


@reg.query(
    "split_train_valid",
    """SELECT o_orderkey, CASE WHEN rn <= n - n // 20 THEN 'train' ELSE 'valid' END AS split FROM (
    SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('5|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders)""",
)
def split_train_valid(spark, sf):
    return sampling.split_train_valid(fx.load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@reg.query(
    "split_ordered",
    """SELECT event_id, CASE WHEN rn <= n - CAST(ceil(n / 10.0) AS BIGINT) THEN 'train' ELSE 'eval' END AS split FROM (
    SELECT event_id, count(*) OVER () AS n, row_number() OVER (ORDER BY event_id) AS rn FROM events)""",
)
def split_ordered(spark, sf):
    return sampling.split_ordered(fx.load(spark, sf, "events").select("event_id"), "event_id")


@reg.query("head_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def head_sample(spark, sf):
    orders = fx.load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.head_sample(orders, ["o_custkey", "o_orderkey"], 100)


@reg.query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return sampling.seeded_sample(fx.load(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@reg.query(
    "inspect_samples",
    "SELECT item_id, text FROM benchmark ORDER BY md5('0|' || CAST(item_id AS VARCHAR)), item_id LIMIT 3",
)
def inspect_samples(spark, sf):
    return sampling.inspect_samples(fx.load(spark, sf, "benchmark"), "item_id")


@reg.query(
    "assign_batch",
    """SELECT event_id, (rn - 1) // 64 AS batch_id, (rn - 1) % 64 + 1 AS batch_pos FROM (
    SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS rn FROM events)""",
)
def assign_batch(spark, sf):
    events = fx.load(spark, sf, "events").select("event_id", "user_id")
    return sampling.assign_batch(events, ["user_id", "event_id"], 64).select("event_id", "batch_id", "batch_pos")


@reg.query(
    "assign_chunk",
    """SELECT c_custkey, (rn - 1) // (n // 7 + 1) AS chunk_id FROM (
    SELECT c_custkey, count(*) OVER () AS n, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)""",
)
def assign_chunk(spark, sf):
    return sampling.assign_chunk(fx.load(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 7)


@reg.query(
    "shard_by_rank",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY md5('9|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 8 AS shard FROM orders""",
)
def shard_by_rank(spark, sf):
    return sampling.shard_by_rank(fx.load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 8, 9)


@reg.query(
    "turn_label",
    """SELECT conv_id, turn, CASE WHEN rn <= 4 THEN 'turn ' || CAST(rn AS VARCHAR) ELSE 'turn > 4' END AS turn_id FROM (
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)""",
)
def turn_label(spark, sf):
    turns = fx.load(spark, sf, "conversations").select("conv_id", "turn")
    return sampling.label_turns(turns, ["conv_id"], ["turn"])


@reg.query("every_n_steps", "SELECT event_id, event_type FROM events WHERE event_id % 20 = 0")
def every_n_steps(spark, sf):
    return sampling.every_n_steps(fx.load(spark, sf, "events").select("event_id", "event_type"), "event_id", 20)


@reg.query(
    "limited_eval",
    """SELECT round(CAST(avg(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 4) AS mean_value, count(*) AS n_items FROM (
    SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS b FROM events) WHERE b <= 10""",
)
def limited_eval(spark, sf):
    events = fx.load(spark, sf, "events").select("event_id", F.col("value").cast("decimal(18,2)").alias("value"))
    means = sampling.limited_eval(sampling.assign_batch(events, ["event_id"], 64), "batch_id", "value")
    return means.select(F.round(F.col("mean_value").cast("double"), 4).alias("mean_value"), "n_items")


@reg.query(
    "split_anchor_shuffled",
    f"""{ALL}, {SAMPLED_SQL} SELECT table_id, row_pos, CASE WHEN sample_pos <= h THEN 'anchor' ELSE 'shuffled' END AS half,
    CASE WHEN sample_pos <= h THEN sample_pos ELSE sample_pos - h END AS half_pos FROM (
    SELECT *, max(sample_pos) OVER (PARTITION BY table_id) // 2 AS h FROM sampled)""",
)
def split_anchor_shuffled(spark, sf):
    rows = sampling.sample_rows(fx.supplier_numbered(spark, sf), 200, 7)
    return sampling.split_anchor_shuffled(rows).select("table_id", "row_pos", "half", "half_pos")


# --- pairs -----------------------------------------------------------------------------------------


@reg.query(
    "pair_all",
    f"""WITH {fx.ORDER_TABLES_SQL}, r AS (SELECT table_id, row_number() OVER (ORDER BY table_id) - 1 AS i FROM tables)
    SELECT a.table_id AS left_id, b.table_id AS right_id FROM r a JOIN r b ON a.i <= b.i ORDER BY a.i, b.i LIMIT 3000""",
)
def pair_all(spark, sf):
    return pairs.pair_all(fx.order_tables(spark, sf), "table_id", 3000)


@reg.query(
    "pair_same_width",
    f"""WITH {fx.ORDER_TABLES_SQL}, r AS (SELECT table_id, n_cols, row_number() OVER (PARTITION BY n_cols ORDER BY table_id) AS i,
      count(*) OVER (PARTITION BY n_cols) AS n FROM tables),
    neg AS (SELECT * FROM (SELECT a.n_cols, a.table_id AS left_id, b.table_id AS right_id, a.n,
      row_number() OVER (PARTITION BY a.n_cols ORDER BY a.i, b.i) AS k FROM r a JOIN r b ON a.n_cols = b.n_cols AND a.i < b.i AND b.i <= 21) WHERE k <= 20)
    SELECT n_cols, left_id, right_id, 'different' AS kind FROM neg UNION ALL
    SELECT n.n_cols, r.table_id, r.table_id, 'same' FROM neg n JOIN r ON r.n_cols = n.n_cols AND
      r.i = CAST('0x' || substr(md5('17|' || CAST(n.n_cols AS VARCHAR) || '|' || CAST(n.k AS VARCHAR)), 1, 8) AS BIGINT) % n.n + 1""",
)
def pair_same_width(spark, sf):
    return pairs.pair_same_width(fx.order_tables(spark, sf), 17, 20)


@reg.query(
    "resolve_table_name",
    """WITH names AS (SELECT c_mktsegment AS db_id, c_name || '.csv' AS name FROM customer),
    keys AS (SELECT c_mktsegment AS db_id, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name)
      WHEN c_custkey % 3 = 1 THEN 'ER#' || substr(c_name, 10, 8) ELSE 'X' || c_name END AS key FROM customer),
    low AS (SELECT db_id, split_part(name, '.', 1) AS name FROM names),
    hit AS (SELECT k.db_id, k.c_custkey, k.key,
      (SELECT min(name) FROM low l WHERE l.db_id = k.db_id AND lower(l.name) = lower(k.key)) AS e,
      (SELECT min(name) FROM low l WHERE l.db_id = k.db_id AND contains(lower(l.name), lower(k.key))) AS c FROM keys k)
    SELECT db_id, c_custkey, key, coalesce(e, c) AS name,
      CASE WHEN e IS NOT NULL THEN 'equal' WHEN c IS NOT NULL THEN 'contains' ELSE 'missing' END AS tier FROM hit""",
)
def resolve_table_name(spark, sf):
    customer = fx.load(spark, sf, "customer")
    names = customer.select(F.col("c_mktsegment").alias("db_id"), F.concat("c_name", F.lit(".csv")).alias("name"))
    loose = (
        F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name"))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("ER#"), F.substring("c_name", 10, 8)))
        .otherwise(F.concat(F.lit("X"), "c_name"))
    )
    keys = customer.select(F.col("c_mktsegment").alias("db_id"), "c_custkey", loose.alias("key"))
    return pairs.resolve_table_name(keys, names)


# --- grids -----------------------------------------------------------------------------------------

MAX_ROW, MAX_COL = 24, 8
ORDER_COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def _order_grid(spark, sf):
    """The orders of each customer on a fixed grid."""
    rows = fx.order_rows(spark, sf)
    kept = corpus.bounded_scan(rows, ["table_id"], ["o_orderkey"], MAX_ROW)
    cells = corpus.to_cells(kept, F.col("table_id"), F.col("row_pos") - 1, ORDER_COLS).withColumnsRenamed(
        {"row_id": "row_pos", "col_idx": "col_pos"}
    )
    sizes = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(3))
    return cells, sizes


_CELL_SQL = " UNION ALL ".join(
    f"SELECT table_id, row_pos, {i} AS col_pos, CAST({c} AS VARCHAR) AS value FROM ranked" for i, c in enumerate(ORDER_COLS)
)
GRID_SQL = f"""ranked AS (SELECT 'customer_' || CAST(o_custkey AS VARCHAR) AS table_id, *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_pos FROM orders),
 real AS ({_CELL_SQL}),
 grid AS MATERIALIZED (SELECT t.table_id, r.row_pos, c.col_pos, coalesce(x.value, '1') AS value, CASE WHEN x.table_id IS NULL THEN 0 ELSE 1 END AS mask
   FROM (SELECT DISTINCT table_id FROM ranked) t CROSS JOIN (SELECT range AS row_pos FROM range({MAX_ROW})) r
   CROSS JOIN (SELECT CAST(range AS INTEGER) AS col_pos FROM range({MAX_COL})) c LEFT JOIN real x USING (table_id, row_pos, col_pos))"""


@reg.query("pad_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def pad_grid(spark, sf):
    return grid.pad_grid(*_order_grid(spark, sf), MAX_ROW, MAX_COL)


@reg.query(
    "select_masked",
    f"WITH {GRID_SQL} SELECT table_id, col_pos, count(*) AS n_cells, max(value) AS top FROM grid WHERE mask = 1 GROUP BY 1, 2",
)
def select_masked(spark, sf):
    padded = grid.pad_grid(*_order_grid(spark, sf), MAX_ROW, MAX_COL)
    return grid.select_masked(padded).groupBy("table_id", "col_pos").agg(F.count(F.lit(1)).alias("n_cells"), F.max("value").alias("top"))


def _pair_sql(line: str, item: str) -> str:
    return f"""WITH {GRID_SQL} SELECT a.table_id, a.{item} AS a, b.{item} AS b, count(*) AS n_joint FROM grid a JOIN grid b
    ON a.table_id = b.table_id AND a.{line} = b.{line} WHERE a.mask = 1 AND b.mask = 1 GROUP BY 1, 2, 3"""


@reg.query("pair_masks_columns", _pair_sql("row_pos", "col_pos"))
def pair_masks_columns(spark, sf):
    return grid.pair_masks(grid.pad_grid(*_order_grid(spark, sf), MAX_ROW, MAX_COL))[0]


@reg.query("pair_masks_rows", _pair_sql("col_pos", "row_pos"))
def pair_masks_rows(spark, sf):
    return grid.pair_masks(grid.pad_grid(*_order_grid(spark, sf), MAX_ROW, MAX_COL))[1]


@reg.query(
    "row_padding_mask",
    f"""WITH {GRID_SQL} SELECT table_id, col_pos, string_agg(CAST(1 - mask AS VARCHAR), '' ORDER BY row_pos) AS padding
    FROM grid WHERE col_pos < 3 GROUP BY 1, 2""",
)
def row_padding_mask(spark, sf):
    _, sizes = _order_grid(spark, sf)
    bits = F.transform(grid.row_padding_mask("n_rows", MAX_ROW), lambda x: x.cast("int").cast("string"))
    return sizes.select(
        "table_id", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_pos"), F.array_join(bits, "").alias("padding")
    )


@reg.query(
    "pad_permutation",
    f"""{SUP}, {PERMUTED_SQL} SELECT table_id, string_agg(CAST(src_idx AS VARCHAR), ' ' ORDER BY pos) || ' -1 -1' AS padded,
    string_agg(CAST(src_idx AS VARCHAR), ' ' ORDER BY pos) || ' 6 7' AS resolved FROM permuted GROUP BY 1""",
)
def pad_permutation(spark, sf):
    arrays = grid.permutation_arrays(sampling.permute_columns(fx.supplier_columns(fx.supplier_rows(spark, sf)), 3))
    padded = grid.pad_permutation("perm", 8)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return arrays.select("table_id", text(padded).alias("padded"), text(grid.resolve_padding(padded)).alias("resolved"))


@reg.query(
    "align_permuted_columns",
    f"""{ALL}, {PERMUTED_SQL}, anchor AS (SELECT table_id, col_idx, max(value) AS top FROM cells GROUP BY 1, 2)
    SELECT p.table_id, p.pos, p.src_idx AS col_idx, a.top FROM permuted p JOIN anchor a ON a.table_id = p.table_id AND a.col_idx = p.src_idx""",
)
def align_permuted_columns(spark, sf):
    rows = fx.supplier_numbered(spark, sf)
    anchor = fx.supplier_cells(rows).groupBy("table_id", "col_idx").agg(F.max("value").alias("top"))
    permuted = sampling.permute_columns(fx.supplier_columns(fx.supplier_rows(spark, sf)), 3)
    return grid.align_permuted_columns(anchor, permuted).select("table_id", "pos", "col_idx", "top")


# --- the whole preparation of a table for a contrastive pair ---------------------------------------


@reg.query(
    "contrastive_halves",
    f"""{SUP}, {SAMPLED_SQL}, {PICKED_SQL}, perm AS (SELECT table_id, col_pos AS src_pos, row_number() OVER (PARTITION BY table_id
        ORDER BY md5('13|' || table_id || '|' || CAST(col_pos AS VARCHAR)), col_pos) - 1 AS pos FROM picked),
      filled AS (SELECT table_id, row_id, col_idx, coalesce(CASE WHEN dtype IN ('int64', 'float64') THEN CAST(CAST(round(coalesce(TRY_CAST(value AS DECIMAL(18,2)),
        CAST(avg(TRY_CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY table_id, col_idx) AS DOUBLE), 0), 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE value END, 'nan') AS value FROM cells),
      halves AS (SELECT table_id, row_pos, CASE WHEN sample_pos <= h THEN 'anchor' ELSE 'shuffled' END AS half,
        CASE WHEN sample_pos <= h THEN sample_pos ELSE sample_pos - h END AS half_pos FROM (
        SELECT *, max(sample_pos) OVER (PARTITION BY table_id) // 2 AS h FROM sampled))
    SELECT h.table_id, h.half, h.half_pos, CAST(CASE WHEN h.half = 'anchor' THEN k.col_pos ELSE p.pos END AS INTEGER) AS col_pos, f.value
    FROM halves h JOIN picked k USING (table_id) JOIN perm p ON p.table_id = h.table_id AND p.src_pos = k.col_pos
    JOIN filled f ON f.table_id = h.table_id AND f.row_id = h.row_pos AND f.col_idx = k.col_idx""",
)
def contrastive_halves(spark, sf):
    """Scan bound, column cap, mean imputation, row cap, text form, halves, column permutation."""
    rows = _scanned(spark, sf)
    columns = fx.supplier_columns(fx.supplier_rows(spark, sf))
    picked = sampling.sample_columns(columns, 4, 11)
    cells = fx.supplier_cells(rows).join(picked.select("table_id", "col_idx", "col_pos", "dtype"), ["table_id", "col_idx"])
    numeric = F.col("dtype").isin("int64", "float64")
    means = (
        cells.where(numeric).groupBy("table_id", "col_idx").agg(F.avg(F.col("value").try_cast("decimal(18,2)")).alias("mean"))
    )
    number = F.coalesce(F.col("value").try_cast("double"), F.col("mean").cast("double"), F.lit(0.0))
    filled = cells.join(means, ["table_id", "col_idx"], "left").withColumn(
        "value",
        F.coalesce(
            F.when(numeric, F.round(number, 2).cast("decimal(18,2)").cast("string")).otherwise(F.col("value")), F.lit("nan")
        ),
    )
    halves = sampling.split_anchor_shuffled(sampling.sample_rows(rows.select("table_id", "row_pos"), 200, 7, bounded=True))
    moved = sampling.permute_columns(picked.select("table_id", F.col("col_pos").alias("col_idx")), 13).select(
        "table_id", F.col("src_idx").alias("col_pos"), "pos"
    )
    return (
        filled.withColumnRenamed("row_id", "row_pos")
        .join(halves, ["table_id", "row_pos"])
        .join(moved, ["table_id", "col_pos"])
        .select(
            "table_id",
            "half",
            "half_pos",
            F.when(F.col("half") == "anchor", F.col("col_pos")).otherwise(F.col("pos")).alias("col_pos"),
            "value",
        )
    )
