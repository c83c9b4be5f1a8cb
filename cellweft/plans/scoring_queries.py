"""Queries over predictions and gold.

Every order stands for one item: its key decides, by plain arithmetic, which clauses the gold query has and
how the prediction differs.  Spark gets both as parsed-query JSON; the SQL works on the same arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cellweft.operators import sampling, scoring
from cellweft.plans import fixtures as fx
from cellweft.plans.registry import Registry
from cellweft.session import kept, spread

reg = Registry()

ITEM = "question_id"
# a key per side; `al` lets the prediction name a column by its foreign-key partner
BASE = """SELECT o_orderkey AS question_id, o_custkey AS session, CASE WHEN o_orderkey % 2 = 0 THEN 'sales' ELSE 'web' END AS db_id,
 o_orderkey AS kg, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 12 WHEN o_orderkey % 5 = 3 THEN o_orderkey + 1 ELSE o_orderkey END AS kp,
 CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS al, CASE WHEN o_orderkey % 5 = 1 THEN 'except' ELSE 'union' END AS plink,
 o_orderkey % 13 = 0 AS lost FROM orders"""


def _list(n: str, body: str) -> str:
    return f"list_transform(list_filter([0, 1, 2, 3], lambda i: i < {n}), lambda i: {body})"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# counts and contents of the clauses for key k
def _n(k: str) -> dict[str, str]:
    return {
        "select": f"({k} % 3 + 1)",
        "tables": f"({k} % 2 + 1)",
        "where": f"({k} % 4)",
        "links": f"greatest({k} % 4 - 1, 0)",
        "group": f"({k} % 3)",
        "having": f"(CASE WHEN {k} % 3 > 0 AND {k} % 5 = 0 THEN 2 ELSE 0 END)",
        "having_links": f"(CASE WHEN {k} % 3 > 0 AND {k} % 5 = 0 THEN 1 ELSE 0 END)",
        "order": f"(CASE WHEN {k} % 4 = 1 THEN 1 ELSE 0 END)",
    }


def _agg(k: str) -> str:
    return f"CASE ({k} + i) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'max' ELSE 'count' END"


def _op(k: str) -> str:
    return f"CASE ({k} + i) % 4 WHEN 0 THEN '=' WHEN 1 THEN 'like' WHEN 2 THEN 'in' ELSE '>' END"


def _link(k: str) -> str:
    return f"CASE WHEN ({k} + i) % 3 = 0 THEN 'or' ELSE 'and' END"


def _neg(k: str) -> str:
    return f"({k} + i) % 5 = 0"


def _json_col(x: str, al: str) -> str:
    return f"(CASE WHEN {x} = 2 AND {al} = 1 THEN '__customer.c2__' ELSE '__orders.c' || {_s(x)} || '__' END)"


def _at(body: str, i: int) -> str:
    return re.sub(r"\bi\b", str(i), body)


def _json_list(n: str, texts: list[str], start: str = "1", flip: bool = False) -> str:
    """n of some constant texts, beginning with one of them, as a JSON list.

    What a clause holds depends on small remainders of the key only, so its texts are made once, when the query is planned.
    """
    part = f"slice(array({', '.join(texts)}), CAST(coalesce({start}, 1) AS INT), CAST(greatest({n}, 0) AS INT))"
    return f"'[' || array_join({f'reverse({part})' if flip else part}, ',') || ']'"


def _by_alias(al: str, made) -> str:
    """What `made` makes of the value of `al`, which is 0 or 1."""
    return made(al) if al.isdigit() else f"CASE WHEN {al} = 1 THEN {made('1')} ELSE {made('0')} END"


def _json_val(col: str) -> str:
    return f"""'{{"op":"none","u1":{{"agg":"none","col":"' || {col} || '","distinct":false}}}}'"""


def _json_query(k: str, al: str, lit: str, link: str, flip: bool) -> str:
    n = _n(k)
    col = lambda x: _json_col(x, al)

    # aggregate and column of place i follow from (k + i) % 12; a key below 0 has one column at most
    def select(a: str) -> str:
        made = [f"""'{{"agg":"' || {_at(_agg(str(r)), 0)} || '","val":' || {_json_val(_json_col(f"{r} % 4", a))} || '}}'""" for r in range(-11, 15)]
        return _json_list(n["select"], made, f"{k} % 12 + 12", flip)

    # the prediction has another number, another field order and spaces
    inner = '{{"where" : {{"conds":[{{"val1" : 6, "op":"="}}]}}}}' if flip else '{{"where":{{"conds":[{{"op":"=","val1":5}}]}}}}'
    inner = inner.replace("{{", "{").replace("}}", "}")
    colon = " : " if flip else ":"

    def cond(r: int, i: int, a: str, nested: bool) -> str:
        end = f""",\"sub1\":{inner}""" if nested and i == 0 else f',"val1":"{lit}"'
        return f"""'{{"neg":' || {_s(_at(_neg(str(r)), i))} || ',"op":"' || {_at(_op(str(r)), i)} || '","val":' || {_json_val(_json_col(str(i), a))} || '{end}}}'"""

    # flag and operator follow from k % 20 and the place, of which there are 3
    def where(a: str) -> str:
        made = [_json_list(n["where"], [cond(r, i, a, nested) for r in range(20) for i in range(3)], f"pmod({k}, 20) * 3 + 1") for nested in (True, False)]
        return f"CASE WHEN {k} % 7 = 0 THEN {made[0]} ELSE {made[1]} END"

    def links(clause: str) -> str:
        return _json_list(n[clause], [f"""'"' || {_at(_link(str(r)), 0)} || '"'""" for r in range(6)], f"pmod({k}, 3) + 1")

    unit = lambda a: f"""'{{"agg":"none","col":"' || {_json_col("i", a)} || '","distinct":false}}'"""
    having = lambda a: f"""'{{"neg":false,"op":">","val":' || {_json_val(_json_col("i", a))} || ',"val1":"{lit}"}}'"""
    lists = lambda clause, body: _by_alias(al, lambda a: _json_list(n[clause], [_at(body(a), i) for i in range(4)]))
    deep = f"""CASE WHEN {k} % 33 = 0 THEN ',"intersect":{{"select":[{{"agg":"none","val":' || {_json_val(f"'__orders.c' || {_s(f'{k} % 3')} || '__'")} || '}}]}}' ELSE '' END"""
    nested = f"""CASE WHEN {k} % 11 = 0 THEN ',"' || {link} || '"{colon}{{"select":[{{"agg":"none","val":' || {_json_val(f"'__orders.c' || {_s(f'{k} % 4')} || '__'")} || '}}],"tables":[{{"kind":"table_unit","id":"__orders__"}}]' || {deep} || '}}' ELSE '' END"""
    kinds = ["'__orders__'", "'__customer__'", "'__customer__'", "'__customer__'"]
    tables = _json_list(n["tables"], [f"""'{{"kind":"table_unit","id":"' || {t} || '"}}'""" for t in kinds])
    return f"""'{{"distinct":false,"select":' || {_by_alias(al, select)}
     || ',"tables":' || {tables}
     || ',"where":{{"conds":' || {_by_alias(al, where)} || ',"links":' || {links("links")} || '}}'
     || ',"group_by":' || {lists("group", unit)}
     || ',"having":{{"conds":' || {lists("having", having)} || ',"links":' || {links("having_links")} || '}}'
     || CASE WHEN {k} % 4 = 1 THEN ',"order_dir":"' || CASE WHEN {k} % 3 = 0 THEN 'asc' ELSE 'desc' END || '"' ELSE '' END
     || ',"order_by":' || CASE WHEN {n["order"]} = 1 THEN '[' || {_json_val(col(f"{k} % 3"))} || ']' ELSE '[]' END
     || CASE WHEN {k} % 8 = 1 THEN ',"limit_rows":' || {_s(f"{k} % 9")} ELSE '' END || {nested} || '}}'"""


GOLD_JSON = _json_query("kg", "0", "g", "'union'", False)
PRED_JSON = f"CASE WHEN NOT lost THEN {_json_query('kp', 'al', 'p', 'plink', True)} END"


def items(spark, sf, keys=None, key=None):
    """The items, with both queries as JSON; with a frame of keys those of the items named there."""
    orders = spread(fx.load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    if keys is not None:
        orders = orders.join(keys, F.col("o_orderkey").eqNullSafe(F.col(key)), "left_semi")
    base = spark.sql(BASE.replace("FROM orders", "FROM {orders}"), orders=orders)
    return base.select(
        ITEM, "session", "db_id", F.expr(GOLD_JSON).alias("gold"), F.expr(PRED_JSON).alias("pred"), (F.col(ITEM) % 4 != 0).cast("int").alias("exec")
    )


def parsed(spark, sf):
    """Both queries of the items, parsed once: an expression that stands for a parsed query is evaluated wherever it is used."""
    rows = scoring.empty_query_default(items(spark, sf), "pred")
    return rows.select(ITEM, scoring.parse_query("gold").alias("gold"), scoring.parse_query("pred").alias("pred"))


def kmaps(spark):
    """Foreign-key map of the sales database, made from its catalogue entry."""
    entry = spark.createDataFrame(
        [("sales", ["customer", "orders"], [(-1, "*"), (0, "C2"), (1, "C0"), (1, "C2")], [[3, 1]])],
        "db_id string, tables array<string>, columns array<struct<tbl:int,name:string>>, keys array<array<int>>",
    )
    return entry.select("db_id", scoring.foreign_key_map("tables", "columns", "keys").alias("kmap"))


def nodes(rows):
    """All places of rows with both queries."""
    return scoring.with_key_map(scoring.paired_nodes(rows), kmaps(rows.sparkSession))


def leveled_nodes(rows):
    """All places, with the difficulty of the outermost query."""
    return nodes(rows).withColumn("hardness", F.when(F.col("path") == "", scoring.hardness_level("gold")))


def trees(spark, sf, places=nodes, keep=(), top=()):
    """Items, and the parts of their trees: each different pair of queries is parsed and compared once."""
    rows = lambda *keys: scoring.empty_query_default(items(spark, sf, *keys), "pred")
    return scoring.paired_trees(rows(), places, ITEM, keep, top, rows)


def leveled_trees(spark, sf):
    """The same with the difficulty."""
    return trees(spark, sf, leveled_nodes, ("session", "exec"), ("hardness",))


def turns(scored):
    """Item scores with the turn; the trees do not go through its shuffle."""
    return sampling.label_turns(scored.drop("tree"), ["session"], [ITEM])


# --- the same in SQL -------------------------------------------------------------------------------


def _sql_col(x: str, al: str) -> str:
    return f"(CASE WHEN {x} = 2 AND ({al} = 1 OR db_id = 'sales') THEN '__customer.c2__' ELSE '__orders.c' || {_s(x)} || '__' END)"


def _sql_side(p: str, k: str, al: str, link: str) -> str:
    n = _n(k)
    col = lambda x: _sql_col(x, al)
    live = "NOT lost" if p == "p" else "true"

    def lst(count: str, body: str) -> str:
        return f"CASE WHEN {live} THEN {_list(count, body)} ELSE [] END"

    sub = f"CASE WHEN {k} % 7 = 0 AND i = 0 THEN 'sub' ELSE '' END"
    return f"""{lst(n["select"], f"{_agg(k)} || {col(f'({k} + i) % 4')}")} AS {p}_sel, {lst(n["select"], col(f"({k} + i) % 4"))} AS {p}_selp,
    {lst(n["tables"], _s("i"))} AS {p}_tab, {lst(n["where"], f"{_s(_neg(k))} || {_op(k)} || {col('i')} || {sub}")} AS {p}_whr,
    {lst(n["where"], col("i"))} AS {p}_whrp, {lst(n["links"], _link(k))} AS {p}_lnk, {lst(n["group"], col("i"))} AS {p}_grp,
    {lst(n["group"], "'c' || " + _s("i"))} AS {p}_grpb, {lst(n["having"], col("i"))} AS {p}_hav, {lst(n["having_links"], _link(k))} AS {p}_havl,
    {lst(n["order"], f"CASE WHEN {k} % 3 = 0 THEN 'asc' ELSE 'desc' END || {col(f'{k} % 3')}")} AS {p}_ord, ({live}) AND {k} % 8 = 1 AS {p}_lim,
    CASE WHEN ({live}) AND {k} % 11 = 0 THEN {link} END AS {p}_set, {k} % 4 AS {p}_n1, CASE WHEN {k} % 33 = 0 THEN {k} % 3 END AS {p}_n2,
    list_distinct(list_filter([CASE WHEN {k} % 4 > 0 THEN 'where' END, CASE WHEN {k} % 3 > 0 THEN 'group' END, CASE WHEN {n["having"]} > 0 THEN 'having' END,
      CASE WHEN {k} % 4 = 1 THEN 'order' END, CASE WHEN {k} % 4 = 1 THEN CASE WHEN {k} % 3 = 0 THEN 'asc' ELSE 'desc' END END, CASE WHEN {k} % 8 = 1 THEN 'limit' END,
      CASE WHEN {k} % 11 = 0 THEN {link} END,
      CASE WHEN list_contains(list_concat({_list(n["links"], _link(k))}, {_list(n["having_links"], _link(k))}), 'or') THEN 'or' END,
      CASE WHEN list_contains({_list(n["where"], _s(_neg(k)))}, 'true') THEN 'not' END,
      CASE WHEN list_contains({_list(n["where"], _op(k))}, 'in') THEN 'in' END,
      CASE WHEN list_contains({_list(n["where"], _op(k))}, 'like') THEN 'like' END], lambda w: w IS NOT NULL AND ({live}))) AS {p}_key"""


def _match_sql(p: str, g: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({g}, lambda y: y = x))))), 0)"
    )


def _row_sql(name: str, lt: str, pt: str, cnt: str) -> str:
    return f"SELECT question_id, db_id, '{name}' AS component, CAST({lt} AS INTEGER) AS label_total, CAST({pt} AS INTEGER) AS pred_total, CAST({cnt} AS INTEGER) AS cnt FROM sides"


def _units_sql(name: str, c: str) -> str:
    return _row_sql(name, f"len(g_{c})", f"len(p_{c})", _match_sql(f"p_{c}", f"g_{c}"))


_SAME_LNK = "list_sort(list_distinct(p_lnk)) = list_sort(list_distinct(g_lnk))"
_NEST = "p_set IS NOT NULL AND g_set = p_set AND g_n1 = p_n1 AND g_n2 IS NOT DISTINCT FROM p_n2"
SCORE_SQL = f"""base AS ({BASE}), sides AS MATERIALIZED (SELECT question_id, session, db_id, {_sql_side("g", "kg", "0", "'union'")}, {_sql_side("p", "kp", "al", "plink")} FROM base),
parts AS MATERIALIZED ({
    " UNION ALL ".join([
        _units_sql("select", "sel"), _units_sql("select(no AGG)", "selp"), _units_sql("where", "whr"), _units_sql("where(no OP)", "whrp"),
        _units_sql("group(no Having)", "grpb"),
        _row_sql("group", "CASE WHEN len(g_grp) > 0 THEN 1 ELSE 0 END", "CASE WHEN len(p_grp) > 0 THEN 1 ELSE 0 END",
                 "CASE WHEN len(p_grp) > 0 AND p_grp = g_grp AND p_hav = g_hav AND p_havl = g_havl THEN 1 ELSE 0 END"),
        _row_sql("order", "len(g_ord)", "len(p_ord)", "CASE WHEN len(g_ord) > 0 AND g_ord = p_ord AND g_lim = p_lim THEN 1 ELSE 0 END"),
        _row_sql("and/or", f"CASE WHEN {_SAME_LNK} THEN 1 ELSE len(list_distinct(p_lnk)) END", f"CASE WHEN {_SAME_LNK} THEN 1 ELSE len(list_distinct(g_lnk)) END",
                 f"CASE WHEN {_SAME_LNK} THEN 1 ELSE 0 END"),
        _row_sql("IUEN", "CASE WHEN g_set IS NULL THEN 0 ELSE 1 END", "CASE WHEN p_set IS NULL THEN 0 ELSE 1 END", f"CASE WHEN {_NEST} THEN 1 ELSE 0 END"),
        _row_sql("keywords", "len(g_key)", "len(p_key)", "len(list_intersect(p_key, g_key))"),
    ])
}),
graded AS MATERIALIZED (SELECT *, CASE WHEN label_total = pred_total AND cnt = pred_total THEN 1 ELSE 0 END AS f1 FROM parts),
exact AS MATERIALIZED (SELECT g.question_id, CAST(CASE WHEN min(f1) = 1 AND bool_and(p_tab = g_tab) THEN 1 ELSE 0 END AS INTEGER) AS exact FROM graded g JOIN sides s ON g.question_id = s.question_id GROUP BY 1),
counted AS (SELECT question_id, session, (CASE WHEN kg % 4 > 0 THEN 1 ELSE 0 END) + (CASE WHEN kg % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN kg % 4 = 1 THEN 1 ELSE 0 END)
   + (CASE WHEN kg % 8 = 1 THEN 1 ELSE 0 END) + len(g_tab) - 1 + len(list_filter(list_concat(g_lnk, g_havl), lambda x: x = 'or'))
   + len(list_filter({_list(_n("kg")["where"], _op("kg"))}, lambda x: x = 'like')) AS c1,
   (CASE WHEN g_set IS NULL THEN 0 ELSE 1 END) + (CASE WHEN kg % 7 = 0 AND kg % 4 > 0 THEN 1 ELSE 0 END) AS c2,
   (CASE WHEN len(list_filter({_list(_n("kg")["select"], _agg("kg"))}, lambda x: x <> 'none')) + len(list_filter({_list(_n("kg")["where"], _s(_neg("kg")))}, lambda x: x = 'true'))
     + len(g_havl) > 1 THEN 1 ELSE 0 END) + (CASE WHEN len(g_sel) > 1 THEN 1 ELSE 0 END) + (CASE WHEN len(g_whr) + len(g_lnk) > 1 THEN 1 ELSE 0 END)
   + (CASE WHEN len(g_grp) > 1 THEN 1 ELSE 0 END) AS o FROM sides JOIN base USING (question_id, session)),
leveled AS MATERIALIZED (SELECT question_id, session, c1, c2, o, CASE WHEN question_id % 4 <> 0 THEN 1 ELSE 0 END AS exec,
   CASE WHEN c1 <= 1 AND o = 0 AND c2 = 0 THEN 'easy' WHEN c2 = 0 AND ((o <= 2 AND c1 <= 1) OR (c1 <= 2 AND o < 2)) THEN 'medium'
   WHEN (c2 = 0 AND ((o > 2 AND c1 <= 2) OR (c1 > 2 AND c1 <= 3 AND o <= 2))) OR (c1 <= 1 AND o = 0 AND c2 <= 1) THEN 'hard' ELSE 'extra' END AS hardness,
   CASE WHEN rn <= 4 THEN 'turn ' || CAST(rn AS VARCHAR) ELSE 'turn > 4' END AS turn_id
   FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY question_id) AS rn FROM counted)),
whole AS (SELECT l.*, e.exact FROM leveled l JOIN exact e USING (question_id))"""
SC = "WITH " + SCORE_SQL


@reg.query("component_suite", SC + " SELECT question_id, component, label_total, pred_total, cnt, f1 AS acc, f1 AS rec, f1 FROM graded")
def component_suite(spark, sf):
    rows, parts = trees(spark, sf)
    return scoring.component_suite(rows.join(parts, "tree").drop("tree", "exact"))


@reg.query("exact_match", SC + " SELECT * FROM exact")
def exact_match(spark, sf):
    return trees(spark, sf)[0].select(ITEM, "exact")


@reg.query("hardness_level", SC + " SELECT question_id, c1 AS clauses, c2 AS nested, o AS others, hardness FROM leveled")
def hardness_level(spark, sf):
    q = items(spark, sf).select(ITEM, scoring.parse_query("gold").alias("q"))
    clauses, nested, others = scoring.hardness_counts("q")
    return q.select(
        ITEM,
        clauses.cast("bigint").alias("clauses"),
        nested.cast("int").alias("nested"),
        others.cast("int").alias("others"),
        scoring.hardness_level("q").alias("hardness"),
    )


@reg.query("keyword_set", SC + " SELECT question_id, array_to_string(list_sort(g_key), ' ') AS gold_words FROM sides")
def keyword_set(spark, sf):
    q = items(spark, sf).select(ITEM, scoring.parse_query("gold").alias("q"))
    return q.select(ITEM, F.array_join(F.array_sort(scoring.keyword_set("q")), " ").alias("gold_words"))


@reg.query(
    "keyword_overlap",
    SC + " SELECT question_id, label_total, pred_total, cnt FROM graded WHERE component = 'keywords'",
)
def keyword_overlap(spark, sf):
    q = parsed(spark, sf).select(ITEM, scoring.keyword_set("gold").alias("g"), scoring.keyword_set("pred").alias("p"))
    lt, pt, n = scoring.keyword_overlap(F.col("p"), F.col("g"))
    return q.select(ITEM, lt.alias("label_total"), pt.alias("pred_total"), n.alias("cnt"))


@reg.query(
    "connector_set_equal",
    SC + " SELECT question_id, label_total, pred_total, cnt FROM graded WHERE component = 'and/or'",
)
def connector_set_equal(spark, sf):
    q = parsed(spark, sf).select(ITEM, scoring._links(F.col("gold"), "where").alias("g"), scoring._links(F.col("pred"), "where").alias("p"))
    lt, pt, n = scoring.connector_set_equal(F.col("p"), F.col("g"))
    return q.select(ITEM, lt.alias("label_total"), pt.alias("pred_total"), n.alias("cnt"))


@reg.query(
    "sorted_list_equality",
    SC + " SELECT question_id, list_sort(p_tab) = list_sort(g_tab) AS same_tables FROM sides",
)
def sorted_list_equality(spark, sf):
    q = parsed(spark, sf).select(ITEM, scoring.table_ids("gold").alias("g"), scoring.table_ids("pred").alias("p"))
    return q.select(ITEM, scoring.sorted_list_equality(F.col("p"), F.col("g")).alias("same_tables"))


@reg.query(
    "condition_flags",
    SC
    + f""" SELECT question_id, list_contains(list_concat(g_lnk, g_havl), 'or') AS has_or,
    list_contains({_list(_n("kg")["where"], _op("kg"))}, 'like') AS has_like, kg % 7 = 0 AND kg % 4 > 0 AS has_sql, kg % 9 = 0 AS has_op,
    len(list_filter({_list(_n("kg")["select"], _agg("kg"))}, lambda x: x <> 'none')) > 0 AS has_agg FROM sides JOIN base USING (question_id)""",
)
def condition_flags(spark, sf):
    # every ninth gold query has arithmetic where its values stand
    sums = F.when(F.col(ITEM) % 9 == 0, F.replace("gold", F.lit('"val":{"op":"none"'), F.lit('"val":{"op":"-"'))).otherwise(F.col("gold"))
    q = items(spark, sf).withColumn("gold", sums).select(ITEM, scoring.parse_query("gold").alias("q"))
    return q.select(ITEM, *[c.alias(k) for k, c in scoring.condition_flags("q").items()])


@reg.query(
    "sql_node_tree",
    f"""WITH base AS ({BASE}) SELECT question_id, '' AS path, true AS gold_here, true AS pred_here FROM base
    UNION ALL SELECT question_id, '/union', kg % 11 = 0, NOT lost AND kp % 11 = 0 AND plink = 'union' FROM base WHERE kg % 11 = 0 OR (NOT lost AND kp % 11 = 0 AND plink = 'union')
    UNION ALL SELECT question_id, '/except', false, true FROM base WHERE NOT lost AND kp % 11 = 0 AND plink = 'except'
    UNION ALL SELECT question_id, '/union/intersect', kg % 33 = 0, NOT lost AND kp % 33 = 0 AND plink = 'union' FROM base WHERE kg % 33 = 0 OR (NOT lost AND kp % 33 = 0 AND plink = 'union')
    UNION ALL SELECT question_id, '/except/intersect', false, true FROM base WHERE NOT lost AND kp % 33 = 0 AND plink = 'except'""",
)
def sql_node_tree(spark, sf):
    paired = scoring.paired_nodes(scoring.empty_query_default(items(spark, sf), "pred").select(ITEM, "gold", "pred"))
    return scoring.with_presence(paired).select(ITEM, "path", "gold_here", "pred_here")


@reg.query(
    "nested_queries",
    SC + " SELECT question_id, c2 AS n_nested FROM leveled",
)
def nested_queries(spark, sf):
    q = items(spark, sf).select(ITEM, scoring.parse_query("gold").alias("q"))
    return q.select(ITEM, F.size(scoring.nested_queries("q")).alias("n_nested"))


@reg.query(
    "json_example_parse",
    f"""WITH base AS ({BASE}) SELECT question_id, CAST({_n("kg")["select"]} AS INTEGER) AS n_select, CAST({_n("kg")["where"]} AS INTEGER) AS n_where,
    CASE WHEN kg % 8 = 1 THEN kg % 9 END AS limit_rows FROM base""",
)
def json_example_parse(spark, sf):
    q = items(spark, sf).select(ITEM, scoring.parse_query("gold").alias("q"))
    return q.select(ITEM, F.size("q.select").alias("n_select"), F.size("q.where.conds").alias("n_where"), "q.limit_rows")


@reg.query(
    "blank_values",
    f"""WITH base AS ({BASE}) SELECT question_id, CAST(kg % 4 + CASE WHEN kg % 3 > 0 AND kg % 5 = 0 THEN 2 ELSE 0 END - CASE WHEN kg % 7 = 0 AND kg % 4 > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_before,
    CAST(0 AS INTEGER) AS n_literals, CASE WHEN kg % 7 = 0 AND kg % 4 > 0 THEN '{{"where":{{"conds":[{{"op":"="}}]}}}}' ELSE '' END AS sub FROM base""",
)
def blank_values(spark, sf):
    parsed = items(spark, sf).select(ITEM, scoring.parse_query("gold").alias("raw"))
    q = parsed.withColumn("q", scoring.blank_values("raw"))

    def literals(side):
        conds = F.concat(f"{side}.where.conds", f"{side}.having.conds")
        return F.size(F.filter(conds, lambda c: c["val1"].isNotNull() | c["val2"].isNotNull()))

    subs = F.array_join(F.transform("q.where.conds", lambda c: F.coalesce(c["sub1"], F.lit(""))), "")
    return q.select(ITEM, literals("raw").alias("n_before"), literals("q").alias("n_literals"), subs.alias("sub"))


@reg.query(
    "empty_query_default",
    f"""WITH base AS ({BASE}) SELECT question_id, CAST(CASE WHEN lost THEN 0 ELSE kp % 3 + 1 END AS INTEGER) AS n_select, lost FROM base""",
)
def empty_query_default(spark, sf):
    rows = items(spark, sf).withColumn("lost", F.col("pred").isNull())
    q = scoring.empty_query_default(rows, "pred").select(ITEM, "lost", scoring.parse_query("pred").alias("q"))
    return q.select(ITEM, F.coalesce(F.size("q.select"), F.lit(0)).alias("n_select"), "lost")


_SEL_COLS = "array_to_string(list_reverse(p_selp), ' ')"


@reg.query("canonicalise_keys", SC + f" SELECT question_id, {_SEL_COLS} AS pred_columns FROM sides")
def canonicalise_keys(spark, sf):
    rows = scoring.empty_query_default(items(spark, sf).select(ITEM, "db_id", "gold", "pred"), "pred")
    top = scoring.normalise(scoring.paired_nodes(rows), kmaps(spark)).where("path = ''")
    cols = F.coalesce(F.transform("pred.select", lambda s: s["val"]["u1"]["col"]), F.array().cast("array<string>"))
    return top.select(ITEM, F.array_join(cols, " ").alias("pred_columns"))


# a catalogue of three columns per item; only tables in FROM count
_CATALOGUE = [
    "'__orders.c' || CAST(question_id % 5 AS STRING) || '__'",
    "'__customer.c' || CAST(question_id % 7 AS STRING) || '__'",
    "CASE WHEN question_id % 3 = 0 THEN '__all__' ELSE '__nation.c1__' END",
]


@reg.query(
    "valid_columns",
    f"""WITH base AS ({BASE}) SELECT question_id, {_CATALOGUE[0]} || CASE WHEN kg % 2 = 1 THEN ' ' || {_CATALOGUE[1]} ELSE '' END AS valid FROM base""",
)
def valid_columns(spark, sf):
    catalogue = F.array(*[F.expr(c) for c in _CATALOGUE])
    q = items(spark, sf).select(ITEM, catalogue.alias("keys"), scoring.parse_query("gold").alias("q"))
    return q.select(ITEM, F.array_join(scoring.valid_columns("keys", scoring.table_ids("q")), " ").alias("valid"))


# catalogue entries made from orders: 12 columns of 3 tables and 6 foreign keys in file order
_N_KEYS = 6
_ENDS = [f"[CAST((o_orderkey * {i + 3}) % 11 + 1 AS INTEGER), CAST((o_custkey * {i + 2} + o_orderkey) % 11 + 1 AS INTEGER)]" for i in range(_N_KEYS)]


def _fold_sql() -> str:
    steps = ["e0 AS (SELECT o_orderkey, o_custkey, CAST([] AS INTEGER[][]) AS gs FROM orders)"]
    for i, pair in enumerate(_ENDS):
        hit = "list_position(list_transform(gs, lambda g: list_has_any(g, pr)), true)"
        steps.append(
            f"""f{i} AS (SELECT *, {pair} AS pr FROM e{i}), h{i} AS (SELECT *, coalesce({hit}, 0) AS spot FROM f{i}),
            e{i + 1} AS (SELECT o_orderkey, o_custkey, CASE WHEN spot > 0 THEN list_transform(gs, lambda g, j: CASE WHEN j = spot THEN list_sort(list_distinct(list_concat(g, pr))) ELSE g END)
              ELSE list_append(gs, pr) END AS gs FROM h{i})"""
        )
    return ", ".join(steps)


_NAME = "CASE WHEN {0} = 0 THEN '__all__' ELSE '__t' || CAST({0} % 3 AS STRING) || '.c' || CAST({0} AS STRING) || '__' END"


@reg.query(
    "foreign_key_map",
    f"""WITH {_fold_sql()}, g AS (SELECT o_orderkey, unnest(gs) AS grp FROM e{_N_KEYS}), m AS (SELECT o_orderkey, unnest(list_sort(list_distinct(grp))) AS c, list_min(grp) AS r,
      unnest(range(len(list_distinct(grp)))) AS j FROM g)
    SELECT o_orderkey, {_NAME.format("c")} AS col_key, {_NAME.format("r")} AS representative, count(*) AS n FROM m GROUP BY 1, 2, 3""",
)
def foreign_key_map(spark, sf):
    keys = F.array(
        *[
            F.expr(f"array(CAST((o_orderkey * {i + 3}) % 11 + 1 AS INTEGER), CAST((o_custkey * {i + 2} + o_orderkey) % 11 + 1 AS INTEGER))")
            for i in range(_N_KEYS)
        ]
    )
    columns = F.array(*[F.struct(F.lit(-1 if i == 0 else i % 3).alias("tbl"), F.lit(f"C{i}").alias("name")) for i in range(12)])
    entries = fx.load(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit("T0"), F.lit("T1"), F.lit("T2")).alias("tables"), columns.alias("columns"), keys.alias("keys")
    )
    mapped = entries.select("o_orderkey", F.explode(scoring.foreign_key_map("tables", "columns", "keys")).alias("e"))
    return mapped.groupBy("o_orderkey", F.col("e.k").alias("col_key"), F.col("e.v").alias("representative")).agg(F.count(F.lit(1)).alias("n"))


# databases of some hundred key pairs, one to a row
_PAIRS = """SELECT o_custkey % 40 AS db_id, o_orderkey AS pos, (o_orderkey * 7 + o_custkey) % 90 AS a, (o_custkey * 5 + o_orderkey * 3) % 97 AS b
  FROM orders WHERE o_orderkey % 4 = 1"""


@reg.query(
    "foreign_key_groups",
    f"""WITH RECURSIVE pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY pos) AS i FROM ({_PAIRS})),
    walk AS (SELECT DISTINCT db_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[][]) AS gs FROM pairs
      UNION ALL SELECT db_id, i, CASE WHEN spot > 0 THEN list_transform(gs, lambda g, j: CASE WHEN j = spot THEN list_distinct(list_concat(g, pr)) ELSE g END) ELSE list_append(gs, pr) END
      FROM (SELECT w.db_id, p.i, gs, [p.a, p.b] AS pr, coalesce(list_position(list_transform(gs, lambda g: list_has_any(g, [p.a, p.b])), true), 0) AS spot
        FROM walk w JOIN pairs p ON p.db_id = w.db_id AND p.i = w.i + 1)),
    done AS (SELECT db_id, arg_max(gs, i) AS gs FROM walk GROUP BY 1),
    grp AS (SELECT db_id, unnest(gs) AS g, unnest(range(len(gs))) AS k FROM done),
    m AS (SELECT db_id, k, unnest(list_distinct(g)) AS col, list_min(g) AS representative FROM grp)
    SELECT db_id, col, arg_max(representative, k) AS representative FROM m GROUP BY 1, 2""",
)
def foreign_key_groups(spark, sf):
    return scoring.foreign_key_groups(spark.sql(_PAIRS.replace("FROM orders", "FROM {orders}"), orders=fx.load(spark, sf, "orders")))


# --- units in rows: items of any size --------------------------------------------------------------

UNIT = "l_returnflag || '|' || l_linestatus"
GUESS = "CASE WHEN l_orderkey % 5 = 0 THEN 'N' ELSE l_returnflag END || '|' || l_linestatus"
MATCH_SQL = f"""u AS (SELECT l_orderkey AS item, {GUESS} AS unit, 1 AS p, 0 AS g FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_linenumber = 1)
  UNION ALL SELECT l_orderkey, {UNIT}, 0, 1 FROM lineitem),
 m AS (SELECT item, CAST(sum(g) AS BIGINT) AS label_total, CAST(sum(p) AS BIGINT) AS pred_total, CAST(sum(least(p, g)) AS BIGINT) AS cnt FROM (
   SELECT item, unit, sum(p) AS p, sum(g) AS g FROM u GROUP BY 1, 2) GROUP BY 1)"""


def _matched(spark, sf):
    lines = fx.load(spark, sf, "lineitem")
    gold = lines.select(F.col("l_orderkey").alias("item"), F.expr(UNIT).alias("unit"))
    pred = lines.where("NOT (l_orderkey % 7 = 0 AND l_linenumber = 1)").select(F.col("l_orderkey").alias("item"), F.expr(GUESS).alias("unit"))
    return scoring.multiset_match_rows(pred, gold, "item", "unit")


@reg.query("multiset_match", f"WITH {MATCH_SQL} SELECT * FROM m")
def multiset_match(spark, sf):
    return _matched(spark, sf)


@reg.query(
    "component_score",
    f"WITH {MATCH_SQL} SELECT item, CASE WHEN label_total = pred_total AND cnt = pred_total THEN 1 ELSE 0 END AS score FROM m",
)
def component_score(spark, sf):
    m = _matched(spark, sf)
    return m.select("item", scoring.component_score(F.col("cnt"), F.col("pred_total"), F.col("label_total")).alias("score"))


@reg.query(
    "align_pred_gold",
    """WITH g AS (SELECT o_orderkey AS item, o_orderstatus AS gold FROM orders), p AS (SELECT l_orderkey AS item, max(l_linestatus) AS pred FROM lineitem GROUP BY 1)
    SELECT item, gold, pred, CASE WHEN gold IS NULL THEN 'no gold' WHEN pred IS NULL THEN 'no prediction' ELSE 'both' END AS aligned FROM g FULL JOIN p USING (item)""",
)
def align_pred_gold(spark, sf):
    gold = fx.load(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("gold"))
    pred = fx.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.max("l_linestatus").alias("pred"))
    return scoring.align_pred_gold(pred, gold, "item")


# --- roll-up ---------------------------------------------------------------------------------------

COUNTS_SQL = """counts AS (SELECT coalesce(hardness, turn_id, 'all') AS level, count(*) AS n, sum(exec) / count(*) AS exec, sum(exact) / count(*) AS exact
  FROM whole GROUP BY GROUPING SETS ((hardness), (turn_id), ())
  UNION ALL SELECT 'joint_all', count(*), sum(a) / count(*), sum(b) / count(*) FROM (SELECT session, min(exec) AS a, min(exact) AS b FROM whole GROUP BY 1))"""
PARTIAL_SQL = """means AS (SELECT coalesce(l.hardness, 'all') AS level, component, coalesce(avg(f1) FILTER (WHERE pred_total > 0), 0) AS acc,
   coalesce(avg(f1) FILTER (WHERE label_total > 0), 0) AS rec FROM graded g JOIN leveled l USING (question_id) GROUP BY GROUPING SETS ((component, l.hardness), (component))),
 partials AS (SELECT *, CASE WHEN acc + rec = 0 THEN 1.0 ELSE 2 * acc * rec / (acc + rec) END AS f1 FROM means)"""


def _counts(spark, sf):
    # levels and sessions are two summaries of the item scores
    return scoring.score_counts(kept(turns(leveled_trees(spark, sf)[0]), "scores"))


def _partials(spark, sf):
    return scoring.partial_averages(scoring.component_suite(scoring.alike_trees(*leveled_trees(spark, sf))))


@reg.query("score_counts", f"{SC}, {COUNTS_SQL} SELECT level, n, round(exec, 6) AS exec, round(exact, 6) AS exact FROM counts")
def score_counts(spark, sf):
    return _counts(spark, sf).select("level", "n", F.round("exec", 6).alias("exec"), F.round("exact", 6).alias("exact"))


@reg.query(
    "partial_averages",
    f"{SC}, {PARTIAL_SQL} SELECT level, component, round(acc, 6) AS acc, round(rec, 6) AS rec, CAST(round(f1, 6) AS DOUBLE) AS f1 FROM partials",
)
def partial_averages(spark, sf):
    return _partials(spark, sf).select("level", "component", *[F.round(c, 6).alias(c) for c in ("acc", "rec", "f1")])


_LONG = """long AS (SELECT level, 'count' AS metric, CAST(n AS DOUBLE) AS value FROM counts UNION ALL SELECT level, 'execution', exec FROM counts
  UNION ALL SELECT level, 'exact match', exact FROM counts UNION ALL SELECT level, component || ' acc', acc FROM partials
  UNION ALL SELECT level, component || ' rec', rec FROM partials UNION ALL SELECT level, component || ' f1', f1 FROM partials)"""


@reg.query(
    "score_report",
    f"{SC}, {COUNTS_SQL}, {PARTIAL_SQL}, {_LONG} SELECT metric, "
    + ", ".join(f"CAST(round(coalesce(max(value) FILTER (WHERE level = '{c}'), 0), 6) AS DOUBLE) AS \"{c}\"" for c in scoring.LEVELS if c != "joint_all")
    + """, CAST(round(coalesce(max(value) FILTER (WHERE level = 'joint_all'), CASE WHEN metric LIKE '% f1' THEN 1 ELSE 0 END), 6) AS DOUBLE) AS joint_all, """
    + ", ".join(f"""CASE WHEN metric IN ('count', 'execution', 'exact match') THEN CAST(round(coalesce(max(value) FILTER (WHERE level = '{c}'), 0), 6) AS DOUBLE) END AS "{c}\"""" for c in scoring.TURNS)
    + " FROM long GROUP BY 1",
)
def score_report(spark, sf):
    # two summaries read the item scores
    rows, parts = leveled_trees(spark, sf)
    rows = kept(rows, "scores")
    report = scoring.score_report(scoring.score_counts(kept(turns(rows), "turns")), scoring.partial_averages(scoring.component_suite(scoring.alike_trees(rows, parts))))
    return report.select("metric", *[F.round(f"`{c}`", 6).alias(c) for c in (*scoring.LEVELS, *scoring.TURNS)])


_GOLD_Q = "SELECT o_custkey, o_orderpriority FROM orders"


@reg.query(
    "result_set_match",
    """SELECT 'bag' AS rule, (SELECT count(*) FROM orders WHERE o_totalprice > 0) AS n_pred, (SELECT count(*) FROM orders) AS n_gold,
      NOT EXISTS ((SELECT o_custkey, o_orderpriority FROM orders EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 0)) AS matches
    UNION ALL SELECT 'set', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)), (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer)),
      (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) = (SELECT count(*) FROM customer)
    UNION ALL SELECT 'list', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), false
    UNION ALL SELECT 'shuffled', count(*), count(*), true FROM lineitem
    UNION ALL SELECT 'near miss', count(*), count(*), false FROM lineitem
    UNION ALL SELECT 'swapped values', count(*), count(*), false FROM lineitem""",
)
def result_set_match(spark, sf):
    orders = fx.load(spark, sf, "orders")
    pair = orders.select("o_custkey", "o_orderpriority")
    bag = scoring.result_set_match(orders.where("o_totalprice > 0").select(*pair.columns), pair)
    sets = scoring.result_set_match(orders.select("o_custkey"), fx.load(spark, sf, "customer").select("c_custkey"), keep_distinct=False)
    one = orders.select("o_orderkey", "o_orderstatus")
    other = orders.select("o_orderkey", F.when(F.col("o_orderkey") == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    listed = scoring.result_set_match(one, other, order=["o_orderkey"])
    lines = fx.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", F.col("l_quantity").alias("again"))
    turned = lines.select("again", "l_linestatus", "l_partkey", "l_quantity", "l_orderkey", "l_returnflag")
    last = F.col("l_orderkey") == lines.agg(F.max("l_orderkey")).scalar()
    one_off = F.when(last, F.lower("l_linestatus")).otherwise(F.col("l_linestatus"))
    # every column keeps its values, but two of them part from each other
    parted = turned.select(*[F.when(F.col("l_orderkey") % 2 == 0, -F.col(c)).otherwise(F.col(c)).alias(c) if c == "again" else F.col(c) for c in turned.columns])
    own = lines.select(*[F.when(F.col("l_partkey") % 2 == 0, -F.col(c)).otherwise(F.col(c)).alias(c) if c == "again" else F.col(c) for c in lines.columns])
    shuffled = scoring.result_set_match(turned, lines, any_column_order=True)
    near = scoring.result_set_match(turned.withColumn("l_linestatus", one_off), lines, any_column_order=True)
    swapped = scoring.result_set_match(parted, own, any_column_order=True)
    out = None
    for rule, df in (("bag", bag), ("set", sets), ("list", listed), ("shuffled", shuffled), ("near miss", near), ("swapped values", swapped)):
        row = df.select(F.lit(rule).alias("rule"), "n_pred", "n_gold", "matches")
        out = row if out is None else out.unionByName(row)
    return out
