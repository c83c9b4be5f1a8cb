"""Queries over generated text, names, prompts and token sequences."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cellweft.functions import sequences as seq
from cellweft.functions import text as tx
from cellweft.operators import corpus, examples, prompts, sampling
from cellweft.operators.describe import PLACEHOLDER
from cellweft.operators.ordering import first_rows, hash_key
from cellweft.plans import corpus_queries as cq
from cellweft.plans import fixtures as fx
from cellweft.plans.registry import Registry

reg = Registry()

# --- generated text --------------------------------------------------------------------------------
# Both engines read this expression: a turn's text with a query in it, in one of eight shapes.
_Q = "'SELECT c' || CAST(turn AS STRING) || ' FROM t' || CAST(conv_id AS STRING)"
OUTPUT = f"""CASE (conv_id * 3 + turn) % 8
 WHEN 0 THEN text || chr(10) || '```sql' || chr(10) || {_Q} || ';' || chr(10) || '```'
 WHEN 1 THEN text || ' ```sql ' || {_Q} || chr(9) || 'WHERE a = 1 ``` and more ```x```'
 WHEN 2 THEN '```' || {_Q} || ' ```' || text
 WHEN 3 THEN text || ' ' || {_Q} || chr(10) || 'LIMIT 3; ' || text
 WHEN 4 THEN {_Q} || ' ``` ' || text
 WHEN 5 THEN text
 WHEN 6 THEN ' ```sql select 1 ' || chr(10) || ' ``` ' || text
 ELSE text || '```sql' || chr(9) || {_Q} || ' ```' || chr(10) || '```' || {_Q} || '```' END"""
_DB_ID = "CASE WHEN conv_id % 2 = 0 THEN 'sales' ELSE 'web' END"


def outputs(spark, sf):
    turns = fx.load(spark, sf, "conversations")
    return turns.select(
        "conv_id", "turn", F.expr(OUTPUT).alias("model_output"), F.expr(_Q).alias("gold"), F.expr(_DB_ID).alias("db_id")
    )


OUT_SQL = f"outs AS (SELECT conv_id, turn, {OUTPUT} AS model_output, {_Q} AS gold, {_DB_ID} AS db_id FROM conversations)"
_ONE = "translate({}, chr(10) || chr(9), '  ')"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _fence_sql(t: str, mark: str) -> str:
    found = _TRIM.format(_ONE.format(f"regexp_extract({t}, '{mark}([^\\n]*?)```', 1)"))
    return f"CASE WHEN regexp_matches({t}, '{mark}([^\\n]*?)```') THEN {found} END"


_TAIL = "split_part(split_part(substr({t}, strpos({t}, 'SELECT')), '```', 1), ';', 1)"


def _extract_sql(t: str) -> str:
    tail = _ONE.format(_TAIL.format(t=t))
    return f"""coalesce(CASE WHEN contains({t}, '```sql') THEN {_fence_sql(t, "```sql")} ELSE {_fence_sql(t, "```")} END,
      CASE WHEN contains({t}, 'SELECT') THEN {tail} END, {t})"""


@reg.query("extract_sql", f"WITH {OUT_SQL} SELECT conv_id, turn, {_extract_sql('model_output')} AS pred FROM outs")
def extract_sql(spark, sf):
    return outputs(spark, sf).select("conv_id", "turn", tx.extract_sql("model_output").alias("pred"))


_FLAT = "translate(model_output, chr(10), ' ')"


@reg.query(
    "extract_fenced",
    f"""WITH {OUT_SQL} SELECT conv_id, turn, coalesce({_fence_sql(_FLAT, "```sql")}, {_fence_sql(_FLAT, "```")}, {_FLAT}) AS pred,
    coalesce({_fence_sql(_FLAT, "```sql")}, {_FLAT}) AS sql_only FROM outs""",
)
def extract_fenced(spark, sf):
    return outputs(spark, sf).select(
        "conv_id",
        "turn",
        tx.extract_fenced("model_output").alias("pred"),
        tx.extract_fenced("model_output", plain_fence=False).alias("sql_only"),
    )


_QUERY = """'SELECT col1, t1.col2, ''col1'' FROM t1 JOIN col1x ON t1.id = col1x.id WHERE Count > ' || CAST(conv_id AS STRING) || ' -- ' || text"""


def _mapping(*pairs):
    return F.array(*[F.struct(F.expr(k).alias("k"), F.expr(v).alias("v")) for k, v in pairs])


_COLS = (("'col1'", "'col2_' || CAST(conv_id AS STRING)"), ("'col2'", "'age'"), ("'Count'", "'n'"), ("'id'", "'key'"))
_TABS = (("'t1'", "'people'"), ("'col1x'", "'places'"))


def _mapping_sql(pairs) -> str:
    return "[" + ", ".join(f"{{'k': {k}, 'v': {v}}}" for k, v in pairs) + "]"


@reg.query(
    "restore_names",
    f"""SELECT conv_id, turn, replace(replace(replace(replace({_QUERY}, 'col1', 'col2_' || CAST(conv_id AS STRING)), 'col2', 'age'), 'Count', 'n'), 'id', 'key') AS restored
    FROM conversations""",
)
def restore_names(spark, sf):
    turns = fx.load(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.restore_names(F.expr(_QUERY), _mapping(*_COLS)).alias("restored"))


_TOKEN_SQL = tx.TOKEN.replace("'", "''")


def _lookup_sql(m: str) -> str:
    return f"coalesce(list_filter({m}, lambda e: e.k = w)[1].v, w)"


@reg.query(
    "rename_identifiers",
    f"""WITH q AS (SELECT conv_id, turn, regexp_extract_all({_QUERY}, '{_TOKEN_SQL}') AS ts, {_mapping_sql(_COLS)} AS cm, {_mapping_sql(_TABS)} AS tm FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(ts, lambda w, i: CASE WHEN lower(w) IN ({", ".join(f"'{k}'" for k in tx.KEYWORDS)}) THEN w
      WHEN coalesce(ts[i + 1] = '.', false) THEN {_lookup_sql("tm")} ELSE {_lookup_sql("cm")} END), '') AS renamed FROM q""",
)
def rename_identifiers(spark, sf):
    turns = fx.load(spark, sf, "conversations").withColumn("q", F.expr(_QUERY))
    renamed = tx.rename_identifiers("q", _mapping(*_TABS), _mapping(*_COLS))
    return turns.select("conv_id", "turn", renamed.alias("renamed"))


_DUP = (("'a' || CAST(turn AS STRING)", "'x'"), ("'b'", "'y' || CAST(conv_id % 2 AS STRING)"), ("'c'", "'x'"), ("'d'", "'y1'"))


@reg.query(
    "invert_mapping",
    """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN 'x=c y1=d' ELSE 'x=c y0=b y1=d' END AS inverted, role FROM conversations""",
)
def invert_mapping(spark, sf):
    turns = fx.load(spark, sf, "conversations").withColumn("m", _mapping(*_DUP))
    text = F.array_join(F.transform(tx.invert_mapping("m"), lambda e: F.concat(e["k"], F.lit("="), e["v"])), " ")
    return turns.select("conv_id", "turn", text.alias("inverted"), "role")


@reg.query(
    "format_gold_line",
    f"""SELECT conv_id, turn, {_ONE.format(_TRIM.format("text"))} || chr(9) || {_DB_ID} AS line FROM conversations""",
)
def format_gold_line(spark, sf):
    turns = fx.load(spark, sf, "conversations").withColumn("db_id", F.expr(_DB_ID))
    return turns.select("conv_id", "turn", tx.format_gold_line("text", "db_id").alias("line"))


@reg.query(
    "clean_prediction",
    f"""WITH {OUT_SQL} SELECT conv_id, turn, split_part({_TRIM.format(_FLAT)}, chr(9), 1) AS pred FROM outs""",
)
def clean_prediction(spark, sf):
    return outputs(spark, sf).select("conv_id", "turn", tx.clean_prediction("model_output").alias("pred"))


@reg.query(
    "strip_qualifier",
    """SELECT page_id, coalesce(nullif(split_part(url, '.', 2), ''), url) AS second_part, n_parts FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page' || CAST(page_id AS STRING) ELSE 't.c' || CAST(page_id AS STRING) END AS url, length(html) AS n_parts FROM pages)""",
)
def strip_qualifier(spark, sf):
    name = "CASE WHEN page_id % 3 = 0 THEN 'page' || CAST(page_id AS STRING) ELSE 't.c' || CAST(page_id AS STRING) END"
    pages = fx.load(spark, sf, "pages")
    return pages.select(
        "page_id", tx.strip_qualifier(F.expr(name)).alias("second_part"), F.length("html").cast("bigint").alias("n_parts")
    )


@reg.query(
    "path_parts",
    """SELECT page_id, split_part(u, '/', -2) AS db_id, regexp_replace(split_part(u, '/', -1), '\\.[^.]*$', '') AS table_name,
    split_part(u, '/', -2) || '_' || regexp_replace(split_part(u, '/', -1), '\\.[^.]*$', '') || '.csv' AS flat_name
    FROM (SELECT page_id, split_part(url, '?', 1) || '/t' || CAST(page_id AS STRING) || '.part.csv' AS u FROM pages)""",
)
def path_parts(spark, sf):
    path = F.expr("substring_index(url, '?', 1) || '/t' || CAST(page_id AS STRING) || '.part.csv'")
    db_id, table = tx.path_parts("u")
    return fx.load(spark, sf, "pages").withColumn("u", path).select(
        "page_id", db_id.alias("db_id"), table.alias("table_name"), tx.flatten_name(db_id, table).alias("flat_name")
    )


@reg.query(
    "column_key",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '__all__' ELSE lower('__' || ['Part', 'BRAND', 'type'][p_size % 4] || '.' || p_name || '__') END AS col_key FROM part""",
)
def column_key(spark, sf):
    names = F.array(F.lit("Part"), F.lit("BRAND"), F.lit("type"))
    key = tx.column_key(F.col("p_size") % 4 - 1, names, F.col("p_name"))
    return fx.load(spark, sf, "part").select("p_partkey", key.alias("col_key"))


_MARKED = "text || ' t.a(<insert><insert_embs></insert>|int64), t.b(<insert_embs>|object) <insert>' || role || '</insert>'"


@reg.query(
    "strip_placeholders",
    "SELECT conv_id, turn, text || ' t.a(int64), t.b(object) <insert>' || role || '</insert>' AS plain, text || ' t.a(<insert_embs>|int64), t.b(<insert_embs>|object) ' || role AS bare FROM conversations",
)
def strip_placeholders(spark, sf):
    turns = fx.load(spark, sf, "conversations").withColumn("m", F.expr(_MARKED))
    return turns.select("conv_id", "turn", tx.strip_placeholders("m").alias("plain"), tx.strip_markers("m").alias("bare"))


# --- prompts ---------------------------------------------------------------------------------------

QA_SQL = f"""qa AS (SELECT q.conv_id, q.turn, {_DB_ID.replace("conv_id", "q.conv_id")} AS db_id, q.text AS question,
  CASE WHEN q.conv_id % 3 = 0 THEN '```sql ' || a.text || ' ```' ELSE a.text END AS answer
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def question_answers(spark, sf):
    """Each user turn with the assistant turn after it, joined on the unique (conversation, turn)."""
    turns = fx.load(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    answer = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```sql "), "text", F.lit(" ```"))).otherwise(F.col("text"))
    return asked.join(told, ["conv_id", "turn"]).select("conv_id", "turn", F.expr(_DB_ID).alias("db_id"), "question", answer.alias("answer"))


def _pick_sql(seed: int, key: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) % {n})"


def _template_sql(task: str, fields: dict[str, str], key: str, seed: int | None) -> str:
    """The same filling in SQL: nested replace would read braces in values, so parts are joined."""

    def filled(t: str) -> str:
        out = ["'" + (prompts.HEADER + t).replace("'", "''") + "'"]
        for name, expr in {"schema": "schema_text", **fields}.items():
            out = [p for o in out for p in _split_literal(o, "{" + name + "}", expr)]
        return " || ".join(out)

    ts = prompts.TEMPLATES[task]
    if seed is None:
        return filled(ts[0])
    return f"CASE {_pick_sql(seed, key, len(ts))} " + " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(ts)) + " END"


def _split_literal(part: str, mark: str, expr: str) -> list[str]:
    if not part.startswith("'") or mark not in part:
        return [part]
    out: list[str] = []
    for i, piece in enumerate(part[1:-1].split(mark)):
        out += ([expr] if i else []) + (["'" + piece + "'"] if piece else [])
    return out


_DESC = f"WITH {fx.DATABASE_SQL}, {cq.DATABASE_TEXT_SQL}, {QA_SQL}"
_KEY = "CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)"
KEYS = ["conv_id", "turn"]


def _qa_query(name: str, task: str, fields: dict[str, str]) -> None:
    sql = _template_sql(task, fields, _KEY, 21)

    @reg.query(name, f"{_DESC} SELECT conv_id, turn, {sql} AS instruction FROM qa JOIN described USING (db_id)")
    def run(spark, sf):
        qa = question_answers(spark, sf)
        out = prompts.build_prompt(qa, task, fields, KEYS, 21, cq.database_text(spark, sf))
        return out.select(*KEYS, "instruction")


_qa_query("build_question_generation", "question_generation", {"answer": "answer"})
_qa_query("build_code_generation", "code_generation", {"question": "question"})

_BARE = "regexp_replace(regexp_replace(answer, '^```sql', ''), '```$', '')"


# the tables an example names, in its own order
_NAMED = """CASE conv_id % 4 WHEN 0 THEN {a}'customer', 'orders'{b} WHEN 2 THEN {a}'orders', 'nation', 'customer'{b}
  WHEN 1 THEN {a}'events'{b} ELSE {a}'events', 'events'{b} END"""


def named_examples(spark, sf):
    return question_answers(spark, sf).withColumn("path_csvs", F.expr(_NAMED.format(a="array(", b=")")))


def _named_sql(examples: str, lines: str) -> str:
    """Schema texts of the tables that examples name, as `named`, a row per example."""
    return f"""WITH {fx.DATABASE_SQL}, {examples}, {lines}, {cq._FK_SQL}, {QA_SQL}, asked AS (SELECT *, {_NAMED.format(a="[", b="]")} AS path_csvs FROM qa),
    keys AS (SELECT db_id, chr(10) || 'Foreign keys: [' || string_agg(fk, ', ' ORDER BY fk) || ']' || chr(10) AS t FROM fk GROUP BY 1),
    texts AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
      SELECT conv_id, turn, unnest(path_csvs) AS table_id, unnest(range(len(path_csvs))) AS pos FROM asked) JOIN lines USING (table_id) GROUP BY 1, 2),
    named AS (SELECT asked.*, text || coalesce(t, '') AS schema_text FROM asked JOIN texts USING (conv_id, turn) LEFT JOIN keys USING (db_id))"""


_PLAIN_NAMED = _named_sql(cq._examples_sql(3, 2), cq._LINES["novalue"])
_COUNTED_NAMED = _named_sql(cq._examples_sql(2, 2), cq._LINES["valuecount"])
_TEXT2SQL = f"""SELECT conv_id, turn, {_template_sql("text2sql", {"question": "question"}, _KEY, 21)} AS instruction, {_TRIM.format(_BARE)} AS answer FROM named"""


def _text2sql(spark, sf, *lines):
    named = named_examples(spark, sf)
    schema = prompts.schema_texts(named, cq.schema_lines(spark, sf, *lines), cq.foreign_keys(spark))
    return prompts.build_text2sql(named, schema, KEYS, 21).select(*KEYS, "instruction", "answer")


@reg.query("build_text2sql", f"{_PLAIN_NAMED} {_TEXT2SQL}")
def build_text2sql(spark, sf):
    return _text2sql(spark, sf)


@reg.query("build_text2sql_valuecount", f"{_COUNTED_NAMED} {_TEXT2SQL}")
def build_text2sql_valuecount(spark, sf):
    return _text2sql(spark, sf, "valuecount", 2)


@reg.query(
    "choose_template",
    f"""{_DESC} SELECT conv_id, turn, {_template_sql("text2sql", {"question": "question"}, _KEY, None)} AS fixed_first,
    {_pick_sql(4, _KEY, 3)} AS variant FROM qa JOIN described USING (db_id)""",
)
def choose_template(spark, sf):
    qa = question_answers(spark, sf).join(cq.database_text(spark, sf), "db_id")
    fields = {"question": F.col("question"), "schema": F.col("schema_text")}
    return qa.select(
        *KEYS, prompts.choose_template("text2sql", fields, KEYS).alias("fixed_first"), tx.pick(4, KEYS, 3).cast("bigint").alias("variant")
    )


_PATHS = "CASE WHEN conv_id % 2 = 0 THEN {a}'customer', 'orders'{b} ELSE {a}'events'{b} END"


@reg.query(
    "build_recall",
    f"""{_PLAIN_NAMED} SELECT conv_id, turn, CASE WHEN len(path_csvs) = 1 THEN {_template_sql("recall_one_table", {"question": "question"}, _KEY, 8)}
    ELSE {_template_sql("recall", {"question": "question"}, _KEY, 8)} END AS instruction FROM named""",
)
def build_recall(spark, sf):
    named = named_examples(spark, sf)
    schema = prompts.schema_texts(named, cq.schema_lines(spark, sf), cq.foreign_keys(spark))
    return prompts.build_recall(named, schema, KEYS, 8).select(*KEYS, "instruction")


@reg.query(
    "build_title",
    f"""WITH {fx.DATABASE_SQL}, {cq.DATABASE_TEXT_SQL} SELECT table_id, {_template_sql("title", {}, "table_id", 2)} AS instruction
    FROM (SELECT table_id, line AS schema_text FROM lines)""",
)
def build_title(spark, sf):
    lines = cq.schema_lines(spark, sf).withColumnRenamed("line", "schema_text")
    return prompts.build_prompt(lines, "title", {}, ["table_id"], 2).select("table_id", "instruction")


# one random row of each supplier table, its values as a list, and one of its columns
ROW_PICK_SQL = f"""{fx.SUPPLIER_ALL_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id
    ORDER BY md5('31|' || table_id || '|' || CAST(row_pos AS VARCHAR)), row_pos) AS k FROM (SELECT DISTINCT table_id, row_pos FROM scanned)) WHERE k = 1),
  picked AS (SELECT table_id, '[' || string_agg(coalesce(value, 'nan'), ', ' ORDER BY col_idx) || ']' AS row_text,
    max(CASE WHEN col_idx = want THEN coalesce(value, 'nan') END) AS cell_value, max(CASE WHEN col_idx = want THEN col_name END) AS col_name,
    'table ' || table_id AS schema_text FROM (SELECT c.*, {_pick_sql(5, "c.table_id", len(fx.ITEM_SHOWN))} AS want FROM one o JOIN cells c
    ON c.table_id = o.table_id AND c.row_id = o.row_pos) GROUP BY table_id)"""


def _row_pick(spark, sf):
    scanned = fx.supplier_numbered(spark, sf).withColumn("_rnd", hash_key(31, "table_id", "row_pos"))
    one = first_rows(scanned, ["table_id"], ["_rnd", "row_pos"], 1, name="_k")
    values = F.array(*[F.coalesce(fx._spark_text(n, k, b), F.lit("nan")) for n, k, b in fx.ITEM_SHOWN])
    names = F.array(*[F.lit(n) for n, _, _ in fx.ITEM_SHOWN])
    want = tx.pick(5, ["table_id"], len(fx.ITEM_SHOWN))
    return one.select(
        "table_id",
        F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")).alias("row_text"),
        F.get(values, want).alias("cell_value"),
        F.get(names, want).alias("col_name"),
        F.concat(F.lit("table "), "table_id").alias("schema_text"),
    )


_CP = {"row": "row_text", "cell_value": "cell_value"}


@reg.query(
    "build_column_prediction",
    f"""WITH {ROW_PICK_SQL} SELECT table_id, {_template_sql("column_prediction", _CP, "table_id", 6)} AS instruction, col_name AS answer,
    {_template_sql("columns_prediction", _CP, "table_id", 6)} AS multi_instruction FROM picked""",
)
def build_column_prediction(spark, sf):
    picked = _row_pick(spark, sf)
    one = prompts.build_prompt(picked, "column_prediction", _CP, ["table_id"], 6)
    both = prompts.build_prompt(one.withColumnRenamed("instruction", "single"), "columns_prediction", _CP, ["table_id"], 6)
    return both.select(
        "table_id", F.col("single").alias("instruction"), F.col("col_name").alias("answer"), F.col("instruction").alias("multi_instruction")
    )


_CELL = {"cell_value": "row_text", "col_name": "col_name"}


@reg.query(
    "build_cell_prediction",
    f"""WITH {ROW_PICK_SQL} SELECT table_id, {_template_sql("cell_prediction", _CELL, "table_id", 6)} AS instruction, cell_value AS answer FROM picked""",
)
def build_cell_prediction(spark, sf):
    out = prompts.build_prompt(_row_pick(spark, sf), "cell_prediction", _CELL, ["table_id"], 6)
    return out.select("table_id", "instruction", F.col("cell_value").alias("answer"))


_ROW = "CAST(o_orderkey AS STRING) || ', ' || o_orderstatus || ', ' || o_orderpriority"


_SUMMED = 5


@reg.query(
    "build_row_summary",
    f"""WITH r AS (SELECT o_custkey, (k - 1) // {_SUMMED} AS part, string_agg({_ROW}, '; ' ORDER BY o_orderkey) AS rows_text, 'table customer_' || CAST(o_custkey AS STRING) AS schema_text
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1, 2)
    SELECT o_custkey, part, {_template_sql("row_summary", {"rows": "rows_text"}, "CAST(o_custkey AS STRING) || '|' || CAST(part AS STRING)", 12)} AS instruction FROM r""",
)
def build_row_summary(spark, sf):
    orders = fx.load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(_ROW).alias("t"))
    schema = F.concat(F.lit("table customer_"), F.col("o_custkey").cast("string"))
    return prompts.build_row_summaries(orders, ["o_custkey"], ["o_orderkey"], "t", _SUMMED, 12, schema)


@reg.query(
    "wrap_chat",
    "SELECT conv_id, turn, '<user>' || text || '</user><assistant>' AS prompt, text || chr(10) || '</s>' AS target FROM conversations",
)
def wrap_chat(spark, sf):
    return fx.load(spark, sf, "conversations").select(
        "conv_id", "turn", tx.wrap_chat("text", "<user>", "</user><assistant>").alias("prompt"), tx.build_target("text", "</s>").alias("target")
    )


# --- examples and their tables ---------------------------------------------------------------------


def listed_examples(spark, sf):
    """Turns that name tables; some carry one placeholder per column, some fewer, some none."""
    marks = "CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 2 = 0 THEN repeat('<insert_embs>', 11) ELSE repeat('<insert_embs>', 5 - CAST(turn AS INT) % 2) END"
    return fx.load(spark, sf, "conversations").select(
        F.expr("conv_id * 100 + turn").alias("example_id"),
        F.expr(f"text || {marks}").alias("instruction"),
        F.expr(_PATHS.format(a="array(", b=")")).alias("path_csvs"),
    )


LISTED_SQL = f"""ex AS (SELECT conv_id * 100 + turn AS example_id, text || CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 2 = 0 THEN repeat('<insert_embs>', 11)
  ELSE repeat('<insert_embs>', CAST(5 - turn % 2 AS INTEGER)) END AS instruction, {_PATHS.format(a="[", b="]")} AS path_csvs FROM conversations)"""


@reg.query(
    "example_tables",
    f"""WITH {fx.DATABASE_SQL}, {LISTED_SQL} SELECT example_id, table_pos, e.table_id, col_idx, col_name FROM (
    SELECT example_id, unnest(path_csvs) AS table_id, CAST(unnest(range(len(path_csvs))) AS INTEGER) AS table_pos FROM ex) e JOIN cols USING (table_id)""",
)
def example_tables(spark, sf):
    listed = examples.example_columns(listed_examples(spark, sf), fx.database_columns(spark), "example_id")
    return listed.select("example_id", "table_pos", "table_id", "col_idx", "col_name")


@reg.query(
    "concat_columns",
    f"""WITH {fx.DATABASE_SQL}, {LISTED_SQL} SELECT example_id, string_agg(e.table_id || '.' || col_name, ' ' ORDER BY table_pos, col_idx) AS columns FROM (
    SELECT example_id, unnest(path_csvs) AS table_id, unnest(range(len(path_csvs))) AS table_pos FROM ex) e JOIN cols USING (table_id) GROUP BY 1""",
)
def concat_columns(spark, sf):
    listed = examples.example_columns(listed_examples(spark, sf), fx.database_columns(spark), "example_id")
    return examples.column_sequence(listed, "example_id").select("example_id", F.array_join("columns", " ").alias("columns"))


@reg.query(
    "filter_examples_with_placeholder",
    f"""WITH {LISTED_SQL} SELECT example_id, CASE WHEN contains(instruction, '<insert_embs>') THEN 'kept' ELSE 'no placeholder' END AS outcome FROM ex""",
)
def filter_examples_with_placeholder(spark, sf):
    kept, rejected = examples.split_by_placeholder(listed_examples(spark, sf), PLACEHOLDER)
    return kept.select("example_id", F.lit("kept").alias("outcome")).unionByName(
        rejected.select("example_id", F.col("reason").alias("outcome"))
    )


@reg.query(
    "placeholder_column_check",
    f"""WITH {fx.DATABASE_SQL}, {LISTED_SQL}, n AS (SELECT example_id, CAST(len(string_split(instruction, '<insert_embs>')) - 1 AS BIGINT) AS n_placeholders,
    CASE WHEN len(path_csvs) = 2 THEN 11 ELSE 5 END AS n_columns FROM ex)
    SELECT example_id, n_placeholders, CAST(n_columns AS BIGINT) AS n_columns FROM n WHERE n_placeholders <> n_columns""",
)
def placeholder_column_check(spark, sf):
    widths = fx.database_columns(spark).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cols"))
    return examples.placeholder_column_check(listed_examples(spark, sf), widths, "example_id", PLACEHOLDER)


# --- token sequences -------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')"
_VOCAB, _FIRST, _PAD, _STOP = 5000, 10, 0, (11, 42, 99)


def _ids_sql(text: str) -> str:
    return f"list_transform({_WORDS.format(text)}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {_VOCAB} + {_FIRST})"


def _encode(text):
    return seq.hashed_ids(seq.words(text), _VOCAB, _FIRST)


_SUP_SQL = f"""{QA_SQL}, sup AS (SELECT conv_id, turn, {_ids_sql("question || ' ' || answer")} AS ids, len({_ids_sql("question || ' '")}) AS n FROM qa)"""
_LABELS = "list_transform(ids, lambda x, i: CASE WHEN i <= n THEN -100 ELSE x END)"


def _supervised(spark, sf):
    qa = question_answers(spark, sf).withColumn("source", F.concat("question", F.lit(" ")))
    return examples.supervised_ids(qa, _encode, "source", "answer")


@reg.query(
    "hashed_ids",
    f"SELECT doc_id, array_to_string({_ids_sql('text')}, ' ') AS ids, len({_WORDS.format('text')}) AS n_ids FROM documents",
)
def hashed_ids(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", _encode(F.col("text")).alias("ids"))
    return docs.select("doc_id", seq.id_text("ids").alias("ids"), F.size("ids").cast("bigint").alias("n_ids"))


@reg.query(
    "mask_prompt_labels",
    f"WITH {_SUP_SQL} SELECT conv_id, turn, array_to_string(ids, ' ') AS input_ids, array_to_string({_LABELS}, ' ') AS labels FROM sup",
)
def mask_prompt_labels(spark, sf):
    return _supervised(spark, sf).select(*KEYS, seq.id_text("input_ids").alias("input_ids"), seq.id_text("labels").alias("labels"))


@reg.query(
    "truncate_ids",
    f"WITH {_SUP_SQL} SELECT conv_id, turn, array_to_string(ids[1:64], ' ') AS input_ids, array_to_string(({_LABELS})[1:64], ' ') AS labels FROM sup",
)
def truncate_ids(spark, sf):
    rows = _supervised(spark, sf)
    return rows.select(
        *KEYS, seq.id_text(seq.truncate_ids("input_ids", 64)).alias("input_ids"), seq.id_text(seq.truncate_ids("labels", 64)).alias("labels")
    )


def _collate_sql(left: bool) -> str:
    ids = f"list_concat({{f}}, ids)" if left else "list_concat(ids, {f})"
    labels = f"list_concat({{f}}, {_LABELS})" if left else f"list_concat({_LABELS}, {{f}})"
    fill = "list_transform(range(longest - len(ids)), lambda z: CAST({} AS BIGINT))"
    return f"""WITH {_SUP_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch_id FROM sup),
    l AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM b),
    p AS (SELECT conv_id, turn, batch_id, {ids.format(f=fill.format(_PAD))} AS input_ids, {labels.format(f=fill.format(-100))} AS labels FROM l)
    SELECT conv_id, turn, batch_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels,
    array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> {_PAD} THEN 1 ELSE 0 END), '') AS attention,
    CAST(len(list_filter(input_ids, lambda x: x <> {_PAD})) AS BIGINT) AS n_real FROM p"""


def _collated(spark, sf, left):
    batches = sampling.assign_batch(_supervised(spark, sf).select(*KEYS, "input_ids", "labels"), KEYS, 16)
    padded = examples.collate_pad(batches, _PAD, left)
    return padded.select(
        *KEYS,
        "batch_id",
        seq.id_text("input_ids").alias("input_ids"),
        seq.id_text("labels").alias("labels"),
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), "").alias("attention"),
        seq.non_pad_length("input_ids", _PAD).cast("bigint").alias("n_real"),
    )


@reg.query("collate_pad", _collate_sql(False))
def collate_pad(spark, sf):
    return _collated(spark, sf, False)


@reg.query("collate_pad_left", _collate_sql(True))
def collate_pad_left(spark, sf):
    return _collated(spark, sf, True)


_PROMPTED = "'begin ' || replace(text, '.', ' <insert_embs> begin ')"


_BEGIN_ID = f"CAST('0x' || substr(md5('begin'), 1, 8) AS BIGINT) % {_VOCAB} + {_FIRST}"
_PIECES_SQL = f"""flatten(list_transform(string_split({_PROMPTED}, '<insert_embs>'), lambda p, j: list_concat(
  CASE WHEN j > 1 THEN [CAST(-114 AS BIGINT)] ELSE CAST([] AS BIGINT[]) END, ({_ids_sql("p")})[2:])))"""


def _interleaved(spark, sf):
    turns = fx.load(spark, sf, "conversations").withColumn("p", F.expr(_PROMPTED))
    pieces = F.transform(F.split("p", PLACEHOLDER), _encode)
    begin = int(hashlib.md5(b"begin").hexdigest()[:8], 16) % _VOCAB + _FIRST
    return turns.withColumn("ids", seq.interleave_placeholder(pieces, begin))


@reg.query(
    "interleave_placeholder",
    f"SELECT conv_id, turn, array_to_string(list_concat([{_BEGIN_ID}], {_PIECES_SQL}), ' ') AS ids FROM conversations",
)
def interleave_placeholder(spark, sf):
    return _interleaved(spark, sf).select(*KEYS, seq.id_text("ids").alias("ids"))


@reg.query(
    "splice_placeholders",
    f"""SELECT conv_id, turn, array_to_string(flatten(list_transform(list_concat([{_BEGIN_ID}], {_PIECES_SQL}),
      lambda x: CASE WHEN x = -114 THEN [-100, -100, -100] ELSE [x] END)), ' ') AS labels FROM conversations""",
)
def splice_placeholders(spark, sf):
    return _interleaved(spark, sf).select(*KEYS, seq.id_text(seq.splice_placeholders("ids", "ids", 3)).alias("labels"))


_CUT = f"list_filter(list_transform([{', '.join(map(str, _STOP))}], lambda s: list_position(ids, s)), lambda p: p > 0)"


@reg.query(
    "cut_at_stop",
    f"""WITH d AS (SELECT doc_id, {_ids_sql("text")} AS ids FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len({_CUT}) > 0 THEN ids[1:list_min({_CUT}) - 1] ELSE ids END, ' ') AS ids FROM d""",
)
def cut_at_stop(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", _encode(F.col("text")).alias("ids"))
    return docs.select("doc_id", seq.id_text(seq.cut_at_stop("ids", _STOP)).alias("ids"))


_VOCAB_SQL = f"""words AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS word, unnest(range(len({_WORDS.format("text")}))) AS pos FROM documents),
 vocab AS (SELECT word, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS INTEGER) AS id FROM words GROUP BY 1)"""


@reg.query("vocabulary", f"WITH {_VOCAB_SQL} SELECT * FROM vocab")
def vocabulary(spark, sf):
    return examples.vocabulary(fx.documents(spark, sf), "text")


@reg.query(
    "tokenise_by_vocabulary",
    f"""WITH {_VOCAB_SQL} SELECT d.doc_id, coalesce(ids, '') AS ids FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM words JOIN vocab USING (word) GROUP BY 1) t USING (doc_id)""",
)
def tokenise_by_vocabulary(spark, sf):
    docs = fx.documents(spark, sf)
    ids = examples.tokenise_by_vocabulary(docs, "doc_id", "text", examples.vocabulary(docs, "text"))
    return ids.select("doc_id", seq.id_text("ids").alias("ids"))


def _word_lengths(texts):
    return texts.map(lambda t: [len(w) for w in t.split(" ")])


@reg.query(
    "tokenise_hook",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS ids FROM documents",
)
def tokenise_hook(spark, sf):
    docs = fx.documents(spark, sf)
    return examples.tokenise(docs, "text", _word_lengths).select("doc_id", seq.id_text("ids").alias("ids"))


@reg.query(
    "token_stats",
    f"""WITH {fx.DATABASE_SQL}, t AS (SELECT table_id, col_idx, CASE WHEN dtype IN ('int64', 'float64') THEN 1
      ELSE len({_WORDS.format("coalesce(value, 'nan')")}) END AS k FROM cells JOIN cols USING (table_id, col_idx))
    SELECT table_id, col_idx, CAST(max(k) AS INTEGER) AS max_tokens, CAST(sum(k) AS BIGINT) AS n_tokens FROM t GROUP BY 1, 2""",
)
def token_stats(spark, sf):
    return examples.token_stats(fx.database_cells(spark, sf), fx.database_columns(spark))


def _lengths(frame):
    # counted, not split: the words of a batch of texts take many times its memory
    return frame.assign(n_words=frame["text"].str.count(" ") + 1)[["doc_id", "n_words"]]


_WORD_SQL = "SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents"


@reg.query("batched_map", _WORD_SQL)
def batched_map(spark, sf):
    docs = fx.documents(spark, sf)
    return examples.batched_map(docs, _lengths, "doc_id bigint, n_words bigint")


@reg.query("chunked_apply", _WORD_SQL)
def chunked_apply(spark, sf):
    docs = fx.documents(spark, sf)
    return examples.chunked_apply(docs, _lengths, "doc_id bigint, n_words bigint", 16)


@reg.query("flatten_results", f"SELECT doc_id, unnest({_WORDS.format('text')}) AS result FROM documents")
def flatten_results(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", seq.words("text").alias("w"))
    return examples.flatten_results(docs, "w", ["doc_id"])
