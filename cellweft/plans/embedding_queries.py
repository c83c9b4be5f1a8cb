"""Queries over vectors.

A vector belongs to a column of a table: blocks of twelve vectors are tables of three, four and five columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.functions import vectors as vec
from cellweft.operators import embeddings as emb
from cellweft.operators import examples, sampling
from cellweft.plans import fixtures as fx
from cellweft.plans.registry import Registry

reg = Registry()
DIM = 64

_TABLE = "CAST((vec_id - vec_id % 12) / 12 * 3 + CASE WHEN vec_id % 12 < 3 THEN 0 WHEN vec_id % 12 < 7 THEN 1 ELSE 2 END AS BIGINT)"
_COLUMN = "CAST(CASE WHEN vec_id % 12 < 3 THEN vec_id % 12 WHEN vec_id % 12 < 7 THEN vec_id % 12 - 3 ELSE vec_id % 12 - 7 END AS INT)"
_SCALED = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3))"
BASE = f"v AS MATERIALIZED (SELECT vec_id, label, {_TABLE} AS table_id, {_COLUMN} AS col_idx, {_SCALED} AS vector FROM embeddings)"
_TEXT = "array_to_string(list_transform({}, lambda x: CAST(round(x * 10000) AS BIGINT)), ' ')"


def vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    return fx.load(spark, sf, "embeddings").select(
        "vec_id", "label", F.expr(_TABLE).alias("table_id"), F.expr(_COLUMN).alias("col_idx"), scaled.alias("vector")
    )


_NORM = "sqrt(list_sum(list_transform({0}, lambda y: y * y)))"


@reg.query(
    "l2_normalize",
    f"""WITH {BASE}, n AS (SELECT vec_id, vector, greatest({_NORM.format("vector")}, 1e-12) AS n FROM v)
    SELECT vec_id, {_TEXT.format("list_transform(vector, lambda z: z / n)")} AS unit FROM n""",
)
def l2_normalize(spark, sf):
    return vectors(spark, sf).select("vec_id", vec.rounded_text(vec.l2_normalize("vector")).alias("unit"))


@reg.query(
    "cosine_similarity",
    f"""WITH {BASE} SELECT a.vec_id, round(list_inner_product(a.vector, b.vector) / greatest({_NORM.format("a.vector")} * {_NORM.format("b.vector")}, 1e-6), 6) AS similarity
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(spark, sf):
    v = vectors(spark, sf)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(vec.cosine_similarity("vector", "next"), 6).alias("similarity"))


@reg.query("drop_zero_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 0")
def drop_zero_vectors(spark, sf):
    zeroed = F.transform("vector", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x))
    return emb.drop_zero_vectors(vectors(spark, sf).withColumn("vector", zeroed)).select("vec_id", "label")


def _mean_sql(by: str, where: str = "true", source: str = "v") -> str:
    return f"""SELECT {by}, string_agg(CAST(CAST(round(m * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY d) AS pooled FROM (
      SELECT {by}, d, sum(x) / greatest(count(*), 1e-9) AS m FROM (SELECT {by}, unnest(vector) AS x, unnest(range({DIM})) AS d FROM {source} WHERE {where}) GROUP BY ALL) GROUP BY {by}"""


@reg.query("mean_pool", f"WITH {BASE} {_mean_sql('label', 'vec_id % 3 <> 0')}")
def mean_pool(spark, sf):
    tokens = vectors(spark, sf).withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return emb.mean_pool(tokens, ["label"], DIM).select("label", vec.rounded_text("vector").alias("pooled"))


_GRID = "g AS (SELECT label AS table_id, vec_id // 4 AS row_pos, CAST(vec_id % 4 AS INT) AS col_idx, vector, CASE WHEN vec_id // 4 % 5 = 0 THEN 0 ELSE 1 END AS mask FROM v)"


@reg.query(
    "pool_rows",
    f"""WITH {BASE}, {_GRID}, ok AS (SELECT x.* FROM g x JOIN (SELECT DISTINCT table_id, row_pos FROM g WHERE col_idx = 0 AND mask = 1) y USING (table_id, row_pos))
    {_mean_sql("table_id, col_idx", source="ok")}""",
)
def pool_rows(spark, sf):
    row = F.floor(F.col("vec_id") / 4)
    cells = vectors(spark, sf).select(
        F.col("label").alias("table_id"),
        row.alias("row_pos"),
        (F.col("vec_id") % 4).cast("int").alias("col_idx"),
        "vector",
        F.when(row % 5 == 0, 0).otherwise(1).alias("mask"),
    )
    return emb.pool_rows(cells, DIM).select("table_id", "col_idx", vec.rounded_text("vector").alias("pooled"))


@reg.query(
    "add_name_vector",
    f"""WITH {BASE}, names AS (SELECT table_id, col_idx, list_transform(vector, lambda x: x / 2) AS nv FROM v)
    SELECT vec_id, {_TEXT.format("list_transform(vector, lambda x, i: x + nv[i])")} AS summed FROM v JOIN names USING (table_id, col_idx)""",
)
def add_name_vector(spark, sf):
    v = vectors(spark, sf)
    names = v.select("table_id", "col_idx", F.transform("vector", lambda x: x / 2).alias("name_vector"))
    return emb.add_name_vector(v, names).select("vec_id", vec.rounded_text("vector").alias("summed"))


_ISO = f"iso AS (SELECT table_id, col_idx, list_transform(vector, lambda x, i: x + ((i - 1) % 3) * 0.05) AS iso FROM v)"
_SIMS = f"""{BASE}, {_ISO}, sims AS (SELECT table_id, col_idx, list_inner_product(vector, iso) / ({_NORM.format("vector")} * {_NORM.format("iso")}) AS similarity
  FROM v JOIN iso USING (table_id, col_idx))"""


def _similarities(spark, sf):
    v = vectors(spark, sf)
    isolated = v.select("table_id", "col_idx", F.transform("vector", lambda x, i: x + (i % 3) * 0.05).alias("vector"))
    return emb.semantic_vs_isolated(v, isolated)


@reg.query("semantic_vs_isolated", f"WITH {_SIMS} SELECT table_id, col_idx, round(similarity, 6) AS similarity FROM sims")
def semantic_vs_isolated(spark, sf):
    return _similarities(spark, sf).withColumn("similarity", F.round("similarity", 6))


@reg.query(
    "cosine_by_width",
    f"""WITH {_SIMS}, t AS (SELECT table_id, avg(similarity) AS m, count(*) AS n_cols FROM sims GROUP BY 1), w AS (SELECT n_cols, sum(m) / count(*) AS s FROM t WHERE m <> 0 GROUP BY 1)
    SELECT CAST(r.range AS BIGINT) AS n_cols, CAST(round(coalesce(s, 0), 6) AS DOUBLE) AS similarity FROM range(100) r LEFT JOIN w ON w.n_cols = r.range""",
)
def cosine_by_width(spark, sf):
    return emb.cosine_by_width(_similarities(spark, sf)).withColumn("similarity", F.round("similarity", 6))


_BATCHED = f"""{BASE}, b AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch_id,
  list_transform(vector, lambda x: x / {_NORM.format("vector")}) AS anchor FROM v),
 c AS MATERIALIZED (SELECT *, list_transform(anchor, lambda x, i: x + ((i - 1) % 2) * 0.02) AS shuffled FROM b)"""


def _batches(spark, sf, size=16):
    unit = vectors(spark, sf).select(F.col("vec_id").alias("item"), vec.l2_normalize("vector").alias("anchor"))
    both = unit.withColumn("shuffled", F.transform("anchor", lambda x, i: x + (i % 2) * 0.02))
    return sampling.assign_batch(both, ["item"], size)


@reg.query(
    "pairwise_similarity",
    f"""WITH {_BATCHED} SELECT q.batch_id, q.vec_id AS query_item, k.vec_id AS key_item, round(list_inner_product(q.anchor, k.shuffled) / 0.07, 6) AS similarity
    FROM c q JOIN c k USING (batch_id)""",
)
def pairwise_similarity(spark, sf):
    batches = _batches(spark, sf).withColumnsRenamed({"anchor": "query", "shuffled": "key"})
    return emb.pairwise_similarity(batches).withColumn("similarity", F.round("similarity", 6))


@reg.query(
    "contrastive_loss",
    f"""WITH {_BATCHED}, s AS (SELECT q.batch_id, q.vec_id AS q, k.vec_id AS k, list_inner_product(q.anchor, k.shuffled) / 0.07 AS cross_sim,
      list_inner_product(q.anchor, k.anchor) / 0.07 AS self_sim FROM c q JOIN c k USING (batch_id)),
    l AS (SELECT batch_id, q, ln(sum(exp(cross_sim) + CASE WHEN q = k THEN 0 ELSE exp(self_sim) END)) - max(CASE WHEN q = k THEN cross_sim END) AS loss FROM s GROUP BY 1, 2)
    SELECT batch_id, count(*) AS n_items, round(avg(loss), 6) AS loss FROM l GROUP BY 1""",
)
def contrastive_loss(spark, sf):
    return emb.contrastive_loss(_batches(spark, sf)).withColumn("loss", F.round("loss", 6))


_LARGE = 512


@reg.query(
    "contrastive_loss_tiled",
    f"""WITH {_BATCHED.replace("// 16", f"// {_LARGE}")}, s AS (SELECT q.batch_id, q.vec_id AS q, k.vec_id AS k, list_inner_product(q.anchor, k.shuffled) / 0.07 AS cross_sim,
      list_inner_product(q.anchor, k.anchor) / 0.07 AS self_sim FROM c q JOIN c k USING (batch_id)),
    l AS (SELECT batch_id, q, ln(sum(exp(cross_sim) + CASE WHEN q = k THEN 0 ELSE exp(self_sim) END)) - max(CASE WHEN q = k THEN cross_sim END) AS loss FROM s GROUP BY 1, 2)
    SELECT batch_id, count(*) AS n_items, round(avg(loss), 6) AS loss FROM l GROUP BY 1""",
)
def contrastive_loss_tiled(spark, sf):
    return emb.contrastive_loss_tiled(_batches(spark, sf, _LARGE), tile=100).withColumn("loss", F.round("loss", 6))


@reg.query(
    "running_loss_mean",
    """SELECT event_id // 50 AS block, round(CAST(avg(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 4) AS mean_value FROM events GROUP BY 1 HAVING count(*) = 50""",
)
def running_loss_mean(spark, sf):
    metrics = fx.load(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").cast("decimal(18,2)").alias("value"))
    means = emb.running_loss_mean(metrics, "step", "value", 50)
    return means.select("block", F.round(F.col("mean_value").cast("double"), 4).alias("mean_value"))


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_EMBED_SQL = f"""WITH {fx.DATABASE_SQL}, d AS (SELECT DISTINCT coalesce(value, 'nan') AS value FROM cells),
 h AS (SELECT value, list_transform(list_filter(regexp_split_to_array(value, '[ \\t\\r\\n\\f]+'), lambda w: w <> ''),
   lambda w: {{'at': {_HASH.format("w")} % 8, 'sign': CASE WHEN {_HASH.format("w || '#'")} % 2 = 0 THEN 1 ELSE -1 END}}) AS h FROM d),
 e AS (SELECT value, array_to_string(list_transform(range(8), lambda i: CAST(coalesce(list_sum(list_transform(list_filter(h, lambda x: x.at = i), lambda x: x.sign)), 0) AS BIGINT) * 10000), ' ') AS vector FROM h)
 SELECT table_id, col_idx, vector, count(*) AS n_cells FROM (SELECT table_id, col_idx, coalesce(value, 'nan') AS value FROM cells) JOIN e USING (value) GROUP BY ALL"""


def _embedded(spark, sf, distinct):
    cells = emb.embed_cells(emb.counted_cells(fx.database_cells(spark, sf)), emb.native_vector(8), distinct)
    return cells.groupBy("table_id", "col_idx", vec.rounded_text("vector").alias("vector")).agg(F.sum("n_cells").alias("n_cells"))


@reg.query("embed_distinct_values", _EMBED_SQL)
def embed_distinct_values(spark, sf):
    return _embedded(spark, sf, True)


def _length_vector(values):
    return values.map(lambda t: [float(len(t)), float(t.count(" "))])


@reg.query(
    "embed_cells_hook",
    f"""WITH {fx.DATABASE_SQL} SELECT table_id, col_idx, CAST(sum(length(coalesce(value, 'nan'))) AS BIGINT) AS total_length FROM cells GROUP BY 1, 2""",
)
def embed_cells_hook(spark, sf):
    cells = emb.embed_cells(emb.counted_cells(fx.database_cells(spark, sf)), emb.model_hook(_length_vector), distinct=True)
    length = F.get("vector", F.lit(0)).cast("bigint") * F.col("n_cells")
    return cells.groupBy("table_id", "col_idx").agg(F.sum(length).alias("total_length"))


@reg.query(
    "special_token_rows",
    """WITH words AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')) AS word FROM documents),
    vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS id FROM words GROUP BY 1)
    SELECT 0 AS id, '[CLS]' AS word UNION ALL SELECT 1, '[SEP]' UNION ALL SELECT CAST(range + 2 AS INTEGER), '[unused' || CAST(range AS VARCHAR) || ']' FROM range(100)
    UNION ALL SELECT CAST(id + 102 AS INTEGER), word FROM vocab""",
)
def special_token_rows(spark, sf):
    return emb.special_token_rows(spark, examples.vocabulary(fx.documents(spark, sf), "text"))
