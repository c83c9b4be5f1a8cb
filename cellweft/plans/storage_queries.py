"""Queries that write tables, files or results and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from cellweft.functions import text as tx
from cellweft.operators import corpus
from cellweft.plans import fixtures as fx
from cellweft.plans import text_queries as tq
from cellweft.plans.registry import Registry
from cellweft.session import work_folder
from cellweft.sources import stores, tables

reg = Registry()


def _written(spark, sf):
    """Two databases of CSV tables."""
    out = work_folder(spark)
    cust = fx.load(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    gaps = cust.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))
    part = fx.load(spark, sf, "part").withColumn("p_name", F.concat("p_name", F.lit(', "x"'))).drop("p_retailprice")
    orders = fx.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    tables.extract_tables({("sales", "customer"): gaps, ("sales", "orders"): orders, ("stock", "part"): part}, out)
    return out


@reg.query(
    "extract_tables",
    """SELECT 'sales/customer' AS table_id, c_custkey AS first_value, CAST(c_custkey AS VARCHAR) || ';' || c_name || ';' ||
      CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END || ';' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ';' || c_mktsegment AS row_text FROM customer
    UNION ALL SELECT 'sales/orders', o_orderkey, CAST(o_orderkey AS VARCHAR) || ';' || CAST(o_custkey AS VARCHAR) || ';' || o_orderstatus || ';' || o_orderpriority FROM orders
    UNION ALL SELECT 'stock/part', p_partkey, CAST(p_partkey AS VARCHAR) || ';' || p_name || ', "x"' || ';' || p_brand || ';' || p_type || ';' || CAST(p_size AS VARCHAR) FROM part""",
)
def extract_tables(spark, sf):
    rows, _, _ = tables.read_csv_corpus(spark, _written(spark, sf), folder_is_table=True)
    text = F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(""))), ";")
    return rows.select("table_id", F.get("values", F.lit(0)).cast("bigint").alias("first_value"), text.alias("row_text"))


@reg.query(
    "inferred_columns",
    """SELECT * FROM (VALUES ('sales/customer', 0, 'c_custkey', 'int64'), ('sales/customer', 1, 'c_name', 'object'), ('sales/customer', 2, 'c_nationkey', 'float64'),
      ('sales/customer', 3, 'c_acctbal', 'float64'), ('sales/customer', 4, 'c_mktsegment', 'object'), ('sales/orders', 0, 'o_orderkey', 'int64'),
      ('sales/orders', 1, 'o_custkey', 'int64'), ('sales/orders', 2, 'o_orderstatus', 'object'), ('sales/orders', 3, 'o_orderpriority', 'object'),
      ('stock/part', 0, 'p_partkey', 'int64'), ('stock/part', 1, 'p_name', 'object'), ('stock/part', 2, 'p_brand', 'object'), ('stock/part', 3, 'p_type', 'object'),
      ('stock/part', 4, 'p_size', 'int64')) AS v(table_id, col_idx, col_name, dtype)""",
)
def inferred_columns(spark, sf):
    return tables.read_csv_corpus(spark, _written(spark, sf), folder_is_table=True)[1]


@reg.query(
    "discover_tables",
    "SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS table_name, 'tree' AS db_id, true AS has_bytes FROM customer GROUP BY c_nationkey",
)
def discover_tables(spark, sf):
    out = work_folder(spark)
    names = fx.load(spark, sf, "customer").select(F.concat(F.lit("nation_"), "c_nationkey").alias("table_name"), "c_name", "c_mktsegment")
    names.write.mode("overwrite").partitionBy("table_name").option("header", True).csv(f"{out}/tree")
    found = tables.discover_tables(spark, out)
    folder = F.regexp_replace("db_id", "^table_name=", "")
    return found.select(folder.alias("table_name"), F.element_at(F.split("path", "/"), -3).alias("db_id"), (F.col("n_bytes") > 0).alias("has_bytes")).distinct()


@reg.query(
    "quarantine",
    """SELECT 'bad' AS kind, 'odd/pages' AS table_id, count(*) AS n FROM pages WHERE page_id % 10 = 3
    UNION ALL SELECT 'good', 'odd/labels', count(*) FROM labels""",
)
def quarantine(spark, sf):
    out = work_folder(spark)
    extra = F.when(F.col("page_id") % 10 == 3, ",again").otherwise("")
    pages = fx.load(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(",x"), extra).alias("page_id,note"))
    # the quote option is off, so that a line with too many fields is written as it is
    pages.write.mode("overwrite").option("header", True).option("quote", "\u0000").csv(f"{out}/odd/pages")
    fx.load(spark, sf, "labels").write.mode("overwrite").option("header", True).csv(f"{out}/odd/labels")
    rows, _, rejects = tables.read_csv_corpus(spark, out, folder_is_table=True)
    return rejects.select(F.lit("bad").alias("kind"), "table_id", F.col("n_bad").alias("n")).unionByName(
        rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "table_id", "n")
    )


@reg.query(
    "manifest",
    f"""WITH {fx.ORDER_TABLES_SQL}, s AS (SELECT table_id, n_cols, CASE WHEN n_cols % 2 = 0 THEN 'semantic' ELSE 'non_semantic' END AS cls FROM tables)
    SELECT table_id, n_cols, position FROM (SELECT *, row_number() OVER (ORDER BY table_id) - 1 AS position FROM s WHERE cls = 'semantic')
    WHERE position IN (SELECT c_custkey * 3 FROM customer)""",
)
def manifest(spark, sf):
    out = work_folder(spark)
    sized = fx.order_tables(spark, sf).withColumn("path", F.col("table_id"))
    stores.write_manifest(sized.withColumn("cls", F.when(F.col("n_cols") % 2 == 0, "semantic").otherwise("non_semantic")), out)
    idx = fx.load(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("position"))
    return stores.read_manifest(spark, out, "semantic", idx).select("table_id", "n_cols", "position")


def _listed(batches):
    """JSON texts as the lines of one list."""
    mark = "["
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            yield pa.RecordBatch.from_pydict({"value": [mark + texts[0], *("," + t for t in texts[1:])]})
            mark = ","
    yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})


@reg.query(
    "read_examples",
    f"""WITH {tq.QA_SQL} SELECT question AS instruction, answer, db_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id FROM qa""",
)
def read_examples(spark, sf):
    out = work_folder(spark)
    qa = tq.question_answers(spark, sf)
    rows = qa.select(
        F.col("question").alias("instruction"), "answer", F.array(F.lit("a.csv")).alias("path_csvs"), "db_id", F.concat_ws("-", "conv_id", "turn").alias("question_id")
    )
    # every file is one JSON list
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_listed, "value string").write.mode("overwrite").text(out)
    return stores.read_examples(spark, out).select("instruction", "answer", "db_id", "question_id")


@reg.query(
    "read_json_lines",
    f"""WITH {tq.QA_SQL} SELECT question AS instruction, db_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id FROM qa""",
)
def read_json_lines(spark, sf):
    out = work_folder(spark)
    rows = tq.question_answers(spark, sf).select(F.col("question").alias("instruction"), "db_id", F.concat_ws("-", "conv_id", "turn").alias("question_id"))
    rows.write.mode("overwrite").json(out)
    return stores.read_examples(spark, out, json_list=False).select("instruction", "db_id", "question_id")


@reg.query(
    "vector_store",
    """SELECT vec_id, label % 2 AS db_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(round(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT) AS head FROM embeddings WHERE label % 2 = 1""",
)
def vector_store(spark, sf):
    out = work_folder(spark)
    v = fx.load(spark, sf, "embeddings").select(
        (F.col("label") % 2).alias("db_id"), F.col("label").alias("table_id"), "vec_id", F.lit(0).alias("col_idx"), F.col("embedding").alias("vector")
    )
    stores.write_vectors(v, out)
    head = F.round(F.get("vector", F.lit(0)).cast("double") * 10000).cast("bigint")
    return stores.read_vectors(spark, out, 1).select("vec_id", "db_id", F.size("vector").alias("dim"), head.alias("head"))


@reg.query(
    "write_predictions",
    f"""WITH {tq.OUT_SQL}, p AS (SELECT {tq._extract_sql("model_output")} AS pred, gold, db_id FROM outs)
    SELECT 'pred' AS file, {tq._ONE.format("pred")} AS line, count(*) AS n FROM p WHERE pred NOT LIKE '%' || chr(13) || '%' GROUP BY 2
    UNION ALL SELECT 'gold', gold || chr(9) || db_id, count(*) FROM p GROUP BY 2""",
)
def write_predictions(spark, sf):
    out = work_folder(spark)
    rows = tq.outputs(spark, sf).withColumn("pred", tx.extract_sql("model_output")).withColumn("question_id", F.col("conv_id") * 100 + F.col("turn"))
    stores.write_predictions(rows, out)
    parts = [
        spark.read.text(f"{out}/{name}").select(F.lit(name).alias("file"), F.col("value").alias("line")) for name in ("pred", "gold")
    ]
    return corpus.union_cells(parts).groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))


@reg.query(
    "resume_or_compute",
    "SELECT doc_id, n_chars * 2 AS doubled, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM documents",
)
def resume_or_compute(spark, sf):
    store = work_folder(spark) + "/results"
    docs = fx.load(spark, sf, "documents").select("doc_id", "n_chars")

    def compute(label):
        return lambda missing: missing.select("doc_id", (F.col("n_chars") * 2).alias("doubled"), F.lit(label).alias("run"))

    stores.resume_or_compute(docs.where("doc_id % 3 = 0"), store, "doc_id", compute("first"))
    return stores.resume_or_compute(docs, store, "doc_id", compute("second"))


@reg.query("drop_source_columns", "SELECT doc_id, length(text) AS n FROM documents")
def drop_source_columns(spark, sf):
    return fx.load(spark, sf, "documents").withColumn("n", F.length("text").cast("bigint")).select("doc_id", "n")
