"""Prediction scoring: component match, exact match, difficulty, and the roll-up of all items.

A parsed query is a JSON object of the shape QUERY_SCHEMA; nested queries stay JSON text inside it.
Gold and predicted query of an item sit in one row, and so do the queries nested at the same place, so
components are row expressions and nothing is joined to compare two queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.joins import join_small
from cellweft.operators.ordering import with_position, with_range_bucket
from cellweft.session import evaluated_once, kept, small_methods

_U = "struct<agg:string,col:string,distinct:boolean>"
_V = f"struct<op:string,u1:{_U},u2:{_U}>"
_C = f"struct<neg:boolean,op:string,val:{_V},val1:string,val2:string,sub1:string,sub2:string>"
_CONDS = f"struct<conds:array<{_C}>,links:array<string>>"
# `sub1` and `sub2` hold a condition's operand where it is a query, `val1` and `val2` where it is a literal
QUERY_SCHEMA = (
    f"struct<distinct:boolean,select:array<struct<agg:string,val:{_V}>>,tables:array<struct<kind:string,id:string>>,"
    f"joined:{_CONDS},where:{_CONDS},group_by:array<{_U}>,having:{_CONDS},order_dir:string,order_by:array<{_V}>,"
    "limit_rows:bigint,intersect:string,except:string,union:string>"
)

# Names in the report, and the nesting links that count as set operations.
COMPONENTS = (
    "select", "select(no AGG)", "where", "where(no OP)", "group(no Having)",
    "group", "order", "and/or", "IUEN", "keywords",
)
LEVELS = ("easy", "medium", "hard", "extra", "all", "joint_all")
TURNS = ("turn 1", "turn 2", "turn 3", "turn 4", "turn > 4")
SET_LINKS = ("intersect", "except", "union")


# --- parsed queries --------------------------------------------------------------------------------


def parse_query(text: str) -> Column:
    return F.from_json(text, QUERY_SCHEMA)


def empty_query_default(df: DataFrame, query: str) -> DataFrame:
    """A query that could not be parsed counts as one without any clause."""
    return df.withColumn(query, F.coalesce(query, F.lit("{}")))


def paired_nodes(items: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per place in the tree of set operations of an item: path, `linked` (may the item have more than
    one place), and both parsed queries.

    The walk is one expression over a row: a list of places to which each adds its children, the pairs under the same
    link.  A text has no more places than names of links, so that many steps reach any depth.  Each query is parsed once.
    `gold_from` and `pred_from` are the tables of the outermost queries: they decide about foreign keys in the
    nested ones, too.
    """
    keep = [c for c in items.columns if c not in (gold, pred)]
    sides = (gold, pred)

    def below(text: Column, link: str) -> Column:
        # most texts do not hold the name, and need not be read as JSON; a name may be written with escapes
        return F.when(F.contains(text, F.lit(link)) | F.contains(text, F.lit("\\")), F.get_json_object(text, f"$.{link}"))

    linked = reduce(lambda a, b: a | b, [below(F.col(c), k).isNotNull() for c in sides for k in SET_LINKS])
    name = "\"(" + "|".join(SET_LINKS) + ")\"\\s*:\\s*\\{"
    most = sum((F.coalesce(F.regexp_count(c, F.lit(name)), F.lit(0)) for c in sides), F.lit(0))

    def child(place: Column, link: str) -> Column:
        path = F.concat(place["path"], F.lit(f"/{link}"))
        return F.struct(path.alias("path"), *[below(place[side], link).alias(side) for side in ("g", "p")])

    def walked(places: Column, i: Column) -> Column:
        children = F.array(*[child(F.get(places, i), link) for link in SET_LINKS])
        return F.concat(places, F.filter(children, lambda c: c["g"].isNotNull() | c["p"].isNotNull()))

    # either side of a place may be missing, whatever the root's columns are
    root = F.array(F.struct(F.lit("").alias("path"), F.col(gold).alias("g"), F.col(pred).alias("p"))).cast("array<struct<path:string,g:string,p:string>>")
    places = F.when(linked, F.aggregate(F.sequence(F.lit(0), most), root, walked)).otherwise(root)
    nodes = items.select(*keep, linked.alias("linked"), F.col(gold).alias("_g"), F.col(pred).alias("_p"), F.explode(places).alias("n"))
    parsed = nodes.select(*keep, "linked", "_g", "_p", "n.path", parse_query("n.g").alias("gold"), parse_query("n.p").alias("pred"))
    outer = [F.when(F.col("path") == "", table_ids(side)).otherwise(table_ids(parse_query(text))) for side, text in (("gold", "_g"), ("pred", "_p"))]
    return parsed.select(*keep, outer[0].alias("gold_from"), outer[1].alias("pred_from"), "linked", "path", "gold", "pred")


def _conds(q: Column, clause: str) -> Column:
    return F.coalesce(q[clause]["conds"], F.array().cast(f"array<{_C}>"))


def _links(q: Column, clause: str) -> Column:
    return F.coalesce(q[clause]["links"], F.array().cast("array<string>"))


def _all_conds(q: Column) -> Column:
    return F.concat(*[_conds(q, c) for c in ("joined", "where", "having")])


def _all_links(q: Column) -> Column:
    return F.concat(*[_links(q, c) for c in ("joined", "where", "having")])


def _n(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def condition_flags(q: str) -> dict[str, Column]:
    """Per query: does it use OR, LIKE, a sub-query operand, arithmetic, an aggregate?

    Arithmetic and aggregates count wherever a value stands: SELECT, conditions, GROUP BY and ORDER BY.
    """
    c = F.col(q)
    conds = _all_conds(c)
    values = F.array_compact(
        F.concat(
            F.coalesce(F.transform(c["select"], lambda s: s["val"]), F.array().cast(f"array<{_V}>")),
            F.transform(conds, lambda x: x["val"]),
            F.coalesce(c["order_by"], F.array().cast(f"array<{_V}>")),
        )
    )
    units = F.array_compact(
        F.concat(F.flatten(F.transform(values, lambda v: F.array(v["u1"], v["u2"]))), F.coalesce(c["group_by"], F.array().cast(f"array<{_U}>")))
    )
    flags = {
        "has_or": F.array_contains(_all_links(c), "or"),
        "has_like": F.exists(conds, lambda x: x["op"] == "like"),
        "has_sql": F.exists(conds, lambda x: x["sub1"].isNotNull() | x["sub2"].isNotNull()),
        "has_op": F.exists(values, lambda v: v["op"] != "none"),
        "has_agg": F.exists(c["select"], lambda x: x["agg"] != "none") | F.exists(units, lambda u: u["agg"] != "none"),
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def nested_queries(q: str) -> Column:
    """Texts of the queries nested directly in one: condition operands, then set operations."""
    c = F.col(q)
    subs = F.flatten(F.transform(_all_conds(c), lambda x: F.array(x["sub1"], x["sub2"])))
    return F.array_compact(F.concat(subs, F.array(*[c[k] for k in SET_LINKS])))


# --- normal form -----------------------------------------------------------------------------------

_LITERAL = r'"val[12]":(?:"(?:\\.|[^"\\])*"|-?[0-9][0-9.eE+-]*|true|false)'
_NOTHING = r'"[a-z_0-9]+":(?:null|\[\]|\{\})'
# a clause holds lists in a list: what is empty in them makes them empty
_LEVELS = 3


def normal_text(query: Column) -> Column:
    """A nested query as canonical JSON: fields in one order, no spaces, no literals, no empty fields.

    Equal text means an equal query; an empty list or object counts as a missing field.  Inside a text value a quote is
    escaped, so the patterns meet fields only.
    """
    text = F.to_json(F.try_parse_json(query))
    for field in (_LITERAL, *[_NOTHING] * _LEVELS):
        text = F.regexp_replace(F.regexp_replace(text, "," + field, ""), field + ",?", "")
    return F.coalesce(text, query)


def representative(name: Column, mapping: Column, tables: Column) -> Column:
    """The representative of a column's foreign-key group, if the column's table is in FROM; else the column."""
    in_from = F.array_contains(tables, F.concat(F.substring_index(name, ".", 1), F.lit("__")))
    other = F.try_element_at(mapping, name)
    # few columns have another name, and only for these FROM is searched
    return F.when(other.isNotNull() & in_from, other).otherwise(name)


def blank_values(q: str | Column) -> Column:
    """Literal operands become null, also inside nested queries; sub-queries stay."""
    c = F.col(q) if isinstance(q, str) else q
    nothing = F.lit(None).cast("string")

    def blank(x: Column) -> Column:
        subs = [F.when(x[k].isNotNull(), normal_text(x[k])).alias(k) for k in ("sub1", "sub2")]
        return F.struct(x["neg"].alias("neg"), x["op"].alias("op"), x["val"].alias("val"), nothing.alias("val1"), nothing.alias("val2"), *subs)

    def clause(name: str) -> Column:
        part = F.struct(F.transform(c[name]["conds"], blank).alias("conds"), c[name]["links"].alias("links"))
        return F.when(c[name].isNotNull(), part).alias(name)

    return _rebuilt(c, {name: clause(name) for name in ("joined", "where", "having")})


_FIELDS = (
    "distinct select tables joined where group_by having order_dir order_by limit_rows intersect except union"
).split()


def _rebuilt(c: Column, changed: dict[str, Column]) -> Column:
    """The query with some fields changed; null stays null."""
    return F.when(c.isNotNull(), F.struct(*[changed.get(f, c[f]).alias(f) for f in _FIELDS]))


def foreign_key_map(tables: str, columns: str, keys: str) -> Column:
    """Column key to the key of its foreign-key group's lowest column, as array<struct<k, v>>.

    One catalogue entry is one row: table names, columns array<struct<tbl, name>> and keys
    array<array<int>>.  Pairs are taken in order; a pair joins the first group that holds one of its ends,
    and groups are not merged afterwards.  Where a column is in several groups the last one counts.
    """
    empty = F.array().cast("array<array<int>>")

    def place(groups: Column, pair: Column) -> Column:
        hits = F.transform(groups, lambda g: F.arrays_overlap(g, pair))
        at = F.array_position(hits, F.lit(True))
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.array_union(g, pair)).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(pair)))

    names = F.transform(
        F.col(columns),
        lambda c: F.when(c["tbl"] < 0, "__all__").otherwise(
            F.lower(F.concat(F.lit("__"), F.get(F.col(tables), c["tbl"]), F.lit("."), c["name"], F.lit("__")))
        ),
    )
    groups = F.aggregate(F.col(keys), empty, place)
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                F.array_sort(F.array_distinct(g)), lambda i: F.struct(F.get(names, i).alias("k"), F.get(names, F.array_min(g)).alias("v"))
            ),
        )
    )


def foreign_key_groups(pairs: DataFrame) -> DataFrame:
    """foreign_key_map for catalogues of any size, with key pairs as rows: (db_id, col, representative).

    pairs(db_id, pos, a, b) are taken in the order of pos, unique in a database.  The group that a pair joins is named by its
    first pair: the least pos that can be reached by steps to an earlier pair with a common end.  Rounds take the least
    name of all earlier pairs at either end, then the name of the pair so named, until nothing changes; steps double, so
    rounds are few.  A column of any number of pairs is searched range by range.
    """
    pairs = kept(pairs.select("db_id", "pos", "a", "b", F.col("pos").alias("grp")), "pairs")
    ends = F.explode(F.array_distinct(F.array("a", "b"))).alias("col")
    while True:
        cut = with_range_bucket(pairs, ["pos"]).select("db_id", "pos", "grp", "_bucket", ends)
        within = Window.partitionBy("db_id", "col", "_bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        least = cut.groupBy("db_id", "col", "_bucket").agg(F.min("grp").alias("_least"))
        earlier = Window.partitionBy("db_id", "col").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = least.withColumn("_before", F.min("_least").over(earlier)).where("_before IS NOT NULL").drop("_least")
        seen = cut.withColumn("_own", F.min("grp").over(within)).join(before, ["db_id", "col", "_bucket"], "left")
        named = seen.groupBy("db_id", "pos").agg(F.min(F.least("_own", "_before")).alias("_new"))
        named = pairs.join(named, ["db_id", "pos"])
        target = pairs.select("db_id", F.col("pos").alias("_new"), F.col("grp").alias("_next"))
        moved = named.join(target, ["db_id", "_new"]).select("db_id", "pos", "a", "b", F.least("_new", "_next").alias("grp"), F.col("grp").alias("_old"))
        moved = kept(moved, "pairs")
        if moved.where("grp <> _old").isEmpty():
            break
        pairs = moved.drop("_old")
    members = pairs.select("db_id", "grp", ends).distinct()
    lowest = members.groupBy("db_id", "grp").agg(F.min("col").alias("representative"))
    # a column in several groups follows the last one
    return members.join(lowest, ["db_id", "grp"]).groupBy("db_id", "col").agg(F.max_by("representative", "grp").alias("representative"))


def valid_columns(col_keys: str | Column, table_ids: Column) -> Column:
    """Those of a catalogue's column keys whose table is in FROM."""
    keys = F.col(col_keys) if isinstance(col_keys, str) else col_keys
    return F.filter(keys, lambda k: F.array_contains(table_ids, F.concat(F.substring_index(k, ".", 1), F.lit("__"))) & F.contains(k, F.lit(".")))


def table_ids(q: str | Column) -> Column:
    c = F.col(q) if isinstance(q, str) else q
    return F.transform(
        F.filter(F.coalesce(c["tables"], F.array().cast("array<struct<kind:string,id:string>>")), lambda t: t["kind"] == "table_unit"), lambda t: t["id"]
    )


def canonicalise_keys(q: str | Column, kmap: str, from_ids: str) -> Column:
    """Columns in a foreign-key group become the group's representative if their table is in FROM, and the
    distinct flags go.  `kmap` is a map, `from_ids` the tables of the outermost query."""
    c = F.col(q) if isinstance(q, str) else q
    mapping, tables = F.col(kmap), F.col(from_ids)

    def unit(u: Column) -> Column:
        new = representative(u["col"], mapping, tables)
        return F.when(u.isNotNull(), F.struct(u["agg"].alias("agg"), new.alias("col"), F.lit(None).cast("boolean").alias("distinct")))

    def value(v: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(v["op"].alias("op"), unit(v["u1"]).alias("u1"), unit(v["u2"]).alias("u2")))

    def conditions(clause: str) -> Column:
        same = ("val1", "val2", "sub1", "sub2")
        conds = F.transform(
            c[clause]["conds"],
            lambda x: F.struct(x["neg"].alias("neg"), x["op"].alias("op"), value(x["val"]).alias("val"), *[x[k].alias(k) for k in same]),
        )
        return F.when(c[clause].isNotNull(), F.struct(conds.alias("conds"), c[clause]["links"].alias("links")))

    return _rebuilt(
        c,
        {
            "distinct": F.lit(None).cast("boolean"),
            "select": F.transform(c["select"], lambda s: F.struct(s["agg"].alias("agg"), value(s["val"]).alias("val"))),
            "group_by": F.transform(c["group_by"], unit),
            "order_by": F.transform(c["order_by"], value),
            "joined": conditions("joined"),
            "where": conditions("where"),
            "having": conditions("having"),
        },
    )


def normalise(nodes: DataFrame, kmaps: DataFrame | None = None) -> DataFrame:
    """Blank the values of both queries and, with kmaps(db_id, kmap), unify their foreign-key columns."""
    out = nodes.withColumn("gold", blank_values("gold")).withColumn("pred", blank_values("pred"))
    if kmaps is None:
        return out
    joined = with_key_map(out, kmaps)
    for side in ("gold", "pred"):
        joined = joined.withColumn(side, canonicalise_keys(side, "kmap", f"{side}_from"))
    return joined.drop("kmap")


# --- components ------------------------------------------------------------------------------------


def multiset_match(pred: Column, gold: Column) -> Column:
    """How many predicted units are found in gold, each gold unit used once."""
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))

    def found(both: Column) -> Column:
        p, g = both["p"], both["g"]
        return F.aggregate(F.array_distinct(p), F.lit(0), lambda n, x: n + F.least(count(p, x), count(g, x)))

    # as an element of an array the two lists are made once per row, not once per unit
    return F.get(F.transform(F.array(F.struct(pred.alias("p"), gold.alias("g"))), found), F.lit(0))


def _matched(pred: str, gold: str) -> Column:
    """multiset_match of two columns; equal lists, the most frequent case, are not counted unit by unit."""
    same = F.size(F.array_compact(F.col(pred)))
    return F.when(F.col(pred) == F.col(gold), same).otherwise(multiset_match(F.col(pred), F.col(gold)))


def multiset_match_rows(pred: DataFrame, gold: DataFrame, item: str, unit: str) -> DataFrame:
    """The same for units in rows, for items of any size: (item, label_total, pred_total, cnt).

    Units are counted per side before the two sides meet.
    """
    sides = pred.select(item, unit, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(
        gold.select(item, unit, F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    )
    counts = sides.groupBy(item, unit).agg(F.sum("_p").alias("p"), F.sum("_g").alias("g"))
    return counts.groupBy(item).agg(
        F.sum("g").alias("label_total"), F.sum("p").alias("pred_total"), F.sum(F.least("p", "g")).alias("cnt")
    )


def component_score(cnt: Column, pred_total: Column, label_total: Column) -> Column:
    """All or nothing: 1 if the totals agree and all were found."""
    return F.when((pred_total == label_total) & (cnt == pred_total), 1).otherwise(0)


def keyword_set(q: str | Column) -> Column:
    """The clause words a query uses."""
    c = F.col(q) if isinstance(q, str) else q
    links = _all_links(c)

    def some(test) -> Column:
        # clause by clause, so that no list of all conditions is made
        return reduce(lambda a, b: a | b, [F.exists(_conds(c, k), test) for k in ("joined", "where", "having")])

    used = {
        "where": F.size(_conds(c, "where")) > 0,
        "group": _n(c["group_by"]) > 0,
        "having": F.size(_conds(c, "having")) > 0,
        "order": _n(c["order_by"]) > 0,
        "limit": c["limit_rows"].isNotNull(),
        "except": c["except"].isNotNull(),
        "union": c["union"].isNotNull(),
        "intersect": c["intersect"].isNotNull(),
        "or": F.array_contains(links, "or"),
        "not": some(lambda x: x["neg"]),
        "in": some(lambda x: x["op"] == "in"),
        "like": some(lambda x: x["op"] == "like"),
    }
    words = [F.when(test, F.lit(word)) for word, test in used.items()]
    return F.array_compact(F.array(*words, F.when(_n(c["order_by"]) > 0, c["order_dir"])))


def keyword_overlap(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    return F.size(gold), F.size(pred), F.size(F.array_intersect(pred, gold))


def connector_set_equal(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Used and/or words: (1, 1, 1) if the sets are equal.  Otherwise the predicted size stands first."""
    p, g = F.array_sort(F.array_distinct(pred)), F.array_sort(F.array_distinct(gold))
    same = p == g
    return F.when(same, 1).otherwise(F.size(p)), F.when(same, 1).otherwise(F.size(g)), F.when(same, 1).otherwise(0)


def sorted_list_equality(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def _texts(side: str, kmap: str | None, from_ids: str) -> dict[str, Column]:
    """The comparable parts of a query as text, so that equal text means an equal unit.

    The text is the normal form: it leaves out literals and distinct flags, and with `kmap` it names a
    foreign-key column by its group's representative.
    """
    q = F.col(side)

    def column(name: Column) -> Column:
        return name if kmap is None else representative(name, F.col(kmap), F.col(from_ids))

    def unit(u: Column) -> Column:
        return F.concat(u["agg"], F.lit(":"), column(u["col"]))

    def value(v: Column) -> Column:
        return F.concat_ws(" ", v["op"], unit(v["u1"]), F.when(v["u2"].isNotNull(), unit(v["u2"])))

    def cond(c: Column) -> Column:
        subs = [F.when(c[k].isNotNull(), normal_text(c[k])) for k in ("sub1", "sub2")]
        return F.concat_ws("|", c["neg"].cast("string"), c["op"], value(c["val"]), *[F.coalesce(x, F.lit("-")) for x in subs])

    none = F.array().cast("array<string>")
    group = F.coalesce(F.transform(q["group_by"], lambda u: column(u["col"])), none)
    return {
        "select": F.coalesce(F.transform(q["select"], lambda s: F.concat_ws("|", s["agg"], value(s["val"]))), none),
        "select_plain": F.coalesce(F.transform(q["select"], lambda s: value(s["val"])), none),
        "where": F.transform(_conds(q, "where"), cond),
        "where_plain": F.transform(_conds(q, "where"), lambda c: value(c["val"])),
        "links": _links(q, "where"),
        "group": group,
        "group_bare": F.transform(group, lambda c: F.coalesce(F.get(F.split(c, "\\."), F.lit(1)), c)),
        "having": F.concat(F.transform(_conds(q, "having"), cond), _links(q, "having")),
        "order": F.when(_n(q["order_by"]) > 0, F.concat(F.array(q["order_dir"]), F.transform(q["order_by"], value))).otherwise(none),
        "limited": q["limit_rows"].isNotNull(),
        "tables": F.coalesce(F.transform(q["tables"], lambda t: F.concat_ws(" ", t["kind"], t["id"])), none),
        "keywords": keyword_set(q),
    }


def as_map(mapping: str | Column) -> Column:
    """array<struct<k, v>> as a map; of equal keys the last one counts."""
    m = F.col(mapping) if isinstance(mapping, str) else mapping
    last = F.filter(m, lambda e, i: ~F.exists(F.slice(m, i + 2, F.size(m)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def with_key_map(nodes: DataFrame, kmaps: DataFrame) -> DataFrame:
    """Add the foreign-key map of each node's database."""
    return join_small(nodes, kmaps.select("db_id", as_map("kmap").alias("kmap")), "db_id", "left")


def node_components(nodes: DataFrame) -> DataFrame:
    """Add, per pair of queries, `parts` = (label_total, pred_total, cnt) of the nine components that need
    no nested query, `parts_ok`, and whether both queries are there."""
    kmap = "kmap" if "kmap" in nodes.columns else None
    keep = [c for c in nodes.columns if c not in ("gold", "pred", "kmap", "gold_from", "pred_from")]
    sides = nodes.select(
        *keep,
        (F.col("gold").isNotNull() & F.col("pred").isNotNull()).alias("both"),
        # columns of their own: nothing is packed into a struct and taken out again
        *[c.alias(f"_g_{k}") for k, c in _texts("gold", kmap, "gold_from").items()],
        *[c.alias(f"_p_{k}") for k, c in _texts("pred", kmap, "pred_from").items()],
    )
    texts = [c for c in sides.columns if c not in (*keep, "both")]
    p, g = ({c[3:]: F.col(c) for c in texts if c.startswith(side)} for side in ("_p_", "_g_"))

    def units(name: str) -> tuple[Column, Column, Column]:
        return F.size(g[name]), F.size(p[name]), _matched(f"_p_{name}", f"_g_{name}")

    has = lambda a: (F.size(a) > 0).cast("int")
    grouped = (F.size(p["group"]) > 0) & (p["group"] == g["group"]) & (p["having"] == g["having"])
    ordered = (F.size(g["order"]) > 0) & (p["order"] == g["order"]) & (p["limited"] == g["limited"])
    found = {
        "select": units("select"),
        "select(no AGG)": units("select_plain"),
        "where": units("where"),
        "where(no OP)": units("where_plain"),
        "group(no Having)": units("group_bare"),
        "group": (has(g["group"]), has(p["group"]), grouped.cast("int")),
        "order": (has(g["order"]), has(p["order"]), ordered.cast("int")),
        "and/or": connector_set_equal(p["links"], g["links"]),
        "keywords": keyword_overlap(p["keywords"], g["keywords"]),
    }
    parts = F.array(
        *[
            F.struct(F.lit(k).alias("component"), lt.alias("label_total"), pt.alias("pred_total"), n.alias("cnt"))
            for k, (lt, pt, n) in found.items()
        ]
    )
    same_tables = (F.size(g["tables"]) == 0) | sorted_list_equality(p["tables"], g["tables"])
    out = sides.withColumn("parts", parts).withColumn("tables_ok", same_tables).drop(*texts)
    all_one = F.forall("parts", lambda x: component_score(x["cnt"], x["pred_total"], x["label_total"]) == 1)
    return out.withColumn("parts_ok", F.col("both") & all_one)


def _place_scores(nodes: DataFrame, keys: list[str], top: tuple[str, ...]) -> DataFrame:
    """The scores of all places, written once: they are narrow, and no query is made or parsed again for a second use."""
    scored = node_components(with_presence(nodes))
    return kept(scored.select(*keys, *top, "linked", "path", "gold_here", "pred_here", "parts", "tables_ok", "parts_ok"), "places")


def _trees(scored: DataFrame, keys: list[str], top: tuple[str, ...]) -> DataFrame:
    """One row per tree of places: what its outermost query has, nested queries per side, and per link whether all below it is right."""
    outermost = F.col("path") == ""
    branch = F.regexp_extract("path", "^/([a-z]+)", 1)
    good = F.col("parts_ok") & F.col("tables_ok")

    def present(side: str) -> Column:
        # children of the outermost query on one side
        return F.sum(F.when(F.rlike("path", F.lit("^/[a-z]+$")) & F.col(side), 1).otherwise(0)).cast("int")

    flat = scored.where("NOT linked").select(
        *keys, *top, "parts", "tables_ok", "linked", F.lit(0).alias("lt"), F.lit(0).alias("pt"), *[F.lit(None).cast("boolean").alias(k) for k in SET_LINKS]
    )
    grouped = (
        scored.where("linked")
        .groupBy(*keys)
        .agg(
            *[F.max(F.when(outermost, F.col(c))).alias(c) for c in top],
            F.max(F.when(outermost, F.col("parts"))).alias("parts"),
            F.bool_and(F.when(outermost, F.col("tables_ok"))).alias("tables_ok"),
            F.lit(True).alias("linked"),
            present("gold_here").alias("lt"),
            present("pred_here").alias("pt"),
            *[F.bool_and(F.when(branch == k, good)).alias(k) for k in SET_LINKS],
        )
    )
    return flat.unionByName(grouped)


def _graded(trees: DataFrame, keys: list[str], top: tuple[str, ...]) -> DataFrame:
    """`exact`, and `parts` with the nested queries as the tenth component."""
    n = reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(False)).cast("int") for k in SET_LINKS])
    iuen = F.struct(F.lit("IUEN").alias("component"), F.col("lt").alias("label_total"), F.col("pt").alias("pred_total"), n.alias("cnt"))
    full = trees.withColumn("parts", F.concat("parts", F.array(iuen)))
    exact = F.forall("parts", lambda x: component_score(x["cnt"], x["pred_total"], x["label_total"]) == 1) & F.col("tables_ok")
    return full.select(*keys, *top, exact.cast("int").alias("exact"), "parts")


def item_scores(nodes: DataFrame, item: str, keep: tuple[str, ...] = (), top: tuple[str, ...] = ()) -> DataFrame:
    """One row per item: `exact`, and `parts` with the totals of all ten components.

    The columns of `keep` are the same at all places of an item; those of `top` are taken from its outermost query.

    A nested pair is an exact match when it and all pairs below it are, so one AND over the tree replaces
    the recursion.  Only items with set operations are grouped; all others stay where they are.
    """
    keys = [item, *keep]
    return _graded(_trees(_place_scores(nodes, keys, top), keys, top), keys, top)


def with_pair(items: DataFrame, columns: tuple[str, ...] = ("db_id", "gold", "pred"), name: str = "pair") -> DataFrame:
    """Add the SHA-256 digest of what decides an item's scores; a null is told from a text, and each text is led by its length."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return items.withColumn(name, F.unhex(F.sha2(F.concat(*parts), 256)))


def paired_trees(
    items: DataFrame, nodes, item: str, keep: tuple[str, ...] = (), top: tuple[str, ...] = (), lookup=None
) -> tuple[DataFrame, DataFrame]:
    """item_scores of items(db_id, gold, pred) in two frames: a row per item with `exact` and the number of its `tree`, and the
    `parts` of each tree.  Each different pair of queries is parsed, compared and graded once.

    `nodes` makes places, as paired_nodes does, of rows that keep the column `pair`.  The items themselves meet the scores
    of their pair by its digest.  A pair may stand for any number of items: the join splits large groups.  Only digests are
    grouped: a pair's texts are read again from the items that have its least key.  `lookup` gives the items whose key is in a
    column of a frame; where texts are not just read, it should make those of these items only.
    """
    keys = [item, *keep]
    with small_methods(items.sparkSession):
        # flat and grouped items need the digests, and so does the search for one item of each pair
        digests = kept(with_pair(items).select(*keys, "pair"), "items")
        first = digests.groupBy("pair").agg(F.min(item).alias("_first")).select("_first").distinct()
        shown = lookup(first, "_first") if lookup else items.join(first, F.col(item).eqNullSafe(F.col("_first")), "left_semi")
        found = _trees(_place_scores(nodes(with_pair(shown.select("db_id", "gold", "pred").distinct())), ["pair"], top), ["pair"], top)
        trees = kept(found.withColumn("tree", F.monotonically_increasing_id()), "pairs")
    graded = _graded(trees, ["pair", "linked", "tree"], top)
    met = digests.join(graded.drop("parts"), "pair").drop("pair")
    # rows that share item and columns are one tree, as if their places lay in one group
    nested = kept(met.where("linked").groupBy(*keys).agg(F.min("tree").alias("tree"), F.count(F.lit(1)).alias("_rows")), "nested")
    single = nested.where("_rows = 1").join(graded.select("tree", *top, "exact"), "tree")
    columns = [*keys, *top, "exact", "tree"]
    rows, parts = met.where("NOT linked").select(*columns).unionByName(single.select(*columns)), graded.select("tree", "parts")
    repeated = nested.where("_rows > 1").select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    if repeated.isEmpty():
        return rows, parts
    shared = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    grouped = (
        met.where("linked")
        .join(repeated, shared, "left_semi")
        .select(*keys, "tree")
        .join(trees, "tree")
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in top],
            F.max("parts").alias("parts"),
            F.bool_and("tables_ok").alias("tables_ok"),
            F.sum("lt").cast("int").alias("lt"),
            F.sum("pt").cast("int").alias("pt"),
            *[F.bool_and(k).alias(k) for k in SET_LINKS],
        )
    )
    # numbers below 0 are those of no pair
    merged = kept(_graded(grouped, keys, top).withColumn("tree", -1 - F.monotonically_increasing_id()), "merged")
    return rows.unionByName(merged.select(*columns)), parts.unionByName(merged.select("tree", "parts"))


def pair_scores(items: DataFrame, nodes, item: str, keep: tuple[str, ...] = (), top: tuple[str, ...] = ()) -> DataFrame:
    """item_scores of items(db_id, gold, pred), where each different pair of queries is parsed and compared once."""
    rows, parts = paired_trees(items, nodes, item, keep, top)
    return rows.join(parts, "tree").drop("tree")


def component_suite(scores: DataFrame) -> DataFrame:
    """Ten component rows per item: label_total, pred_total, cnt, acc, rec, f1."""
    keep = [c for c in scores.columns if c != "parts"]
    # the outer form: for the plain one Spark would test the list's size in a filter and build it twice
    rows = scores.select(*keep, F.inline_outer("parts"))
    score = component_score(F.col("cnt"), F.col("pred_total"), F.col("label_total"))
    return rows.select("*", score.alias("acc"), score.alias("rec"), score.alias("f1"))


def alike_scores(scores: DataFrame) -> DataFrame:
    """Items of one difficulty with the same parts as a row with their number, so that their component rows are made once."""
    return scores.groupBy("hardness", "parts").agg(F.count(F.lit(1)).alias("items"))


def alike_trees(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """alike_scores of paired_trees: items are counted by tree, so that none carries its parts."""
    counts = rows.groupBy("hardness", "tree").agg(F.count(F.lit(1)).alias("items"))
    return counts.join(parts, "tree").groupBy("hardness", "parts").agg(F.sum("items").alias("items"))


def with_presence(nodes: DataFrame) -> DataFrame:
    """Remember which side has a query at a place, before any default is put in."""
    return nodes.withColumn("gold_here", F.col("gold").isNotNull()).withColumn("pred_here", F.col("pred").isNotNull())


# --- difficulty ------------------------------------------------------------------------------------


def hardness_counts(q: str) -> tuple[Column, Column, Column]:
    """Clauses, nested queries and other signs of difficulty of one query.

    A NOT flag counts as an aggregate, and so does each and/or word of HAVING.
    """
    c = F.col(q)
    conds, links = _all_conds(c), _all_links(c)
    one = lambda test: test.cast("int")
    count = lambda array, test: _n(F.filter(array, test))
    is_agg = lambda x: x["agg"] != "none"
    clauses = (
        one(F.size(_conds(c, "where")) > 0)
        + one(_n(c["group_by"]) > 0)
        + one(_n(c["order_by"]) > 0)
        + one(c["limit_rows"].isNotNull())
        + F.greatest(_n(c["tables"]) - 1, F.lit(0))
        + count(links, lambda x: x == "or")
        + count(conds, lambda x: x["op"] == "like")
    )
    aggregates = (
        count(c["select"], is_agg)
        + count(_conds(c, "where"), lambda x: x["neg"])
        + count(c["group_by"], is_agg)
        + count(c["order_by"], lambda v: v["u1"]["agg"] != "none")
        + count(c["order_by"], lambda v: v["u2"]["agg"] != "none")
        + count(_conds(c, "having"), lambda x: x["neg"])
        + F.size(_links(c, "having"))
    )
    others = (
        one(aggregates > 1)
        + one(_n(c["select"]) > 1)
        + one(F.size(_conds(c, "where")) + F.size(_links(c, "where")) > 1)
        + one(_n(c["group_by"]) > 1)
    )
    return clauses, F.size(nested_queries(q)), others


def hardness_level(q: str) -> Column:
    clauses, nested, others = hardness_counts(q)
    flat = nested == 0
    return (
        F.when((clauses <= 1) & (others == 0) & flat, "easy")
        .when(flat & (((others <= 2) & (clauses <= 1)) | ((clauses <= 2) & (others < 2))), "medium")
        .when(
            (flat & (((others > 2) & (clauses <= 2)) | ((clauses > 2) & (clauses <= 3) & (others <= 2))))
            | ((clauses <= 1) & (others == 0) & (nested <= 1)),
            "hard",
        )
        .otherwise("extra")
    )


# --- roll-up ---------------------------------------------------------------------------------------


def align_pred_gold(pred: DataFrame, gold: DataFrame, item: str) -> DataFrame:
    """Pair by key; `aligned` says whether both sides were there."""
    both = gold.join(pred, item, "full")
    return both.withColumn(
        "aligned", F.when(F.col("gold").isNull(), "no gold").when(F.col("pred").isNull(), "no prediction").otherwise("both")
    )


def score_counts(items: DataFrame, session: str = "session") -> DataFrame:
    """(level, n, exec, exact) by difficulty, by turn, for all, and for sessions with every item right."""
    sums = [
        F.count(F.lit(1)).alias("n"),
        F.sum("exec").cast("double").alias("exec"),
        F.sum("exact").cast("double").alias("exact"),
    ]
    level = F.coalesce("hardness", "turn_id", F.lit("all"))
    # sums by difficulty and turn first, so that no item is multiplied for the levels
    both = items.groupBy("hardness", "turn_id").agg(F.count(F.lit(1)).alias("n"), F.sum("exec").alias("exec"), F.sum("exact").alias("exact"))
    totals = [F.sum("n").alias("n"), *[F.sum(c).cast("double").alias(c) for c in ("exec", "exact")]]
    by_level = both.groupingSets([["hardness"], ["turn_id"], []], "hardness", "turn_id").agg(*totals).select(level.alias("level"), "n", "exec", "exact")
    whole = items.groupBy(session).agg(
        F.coalesce(F.bool_and(F.col("exec") == 1), F.lit(True)).cast("int").alias("exec"),
        F.coalesce(F.bool_and(F.col("exact") == 1), F.lit(True)).cast("int").alias("exact"),
    )
    joint = whole.agg(*sums).select(F.lit("joint_all").alias("level"), "n", "exec", "exact")
    return by_level.unionByName(joint).select(
        "level", "n", (F.col("exec") / F.col("n")).alias("exec"), (F.col("exact") / F.col("n")).alias("exact")
    )


def partial_averages(components: DataFrame) -> DataFrame:
    """(level, component, acc, rec, f1): acc over items that predict the component, rec over items whose gold
    has it, F1 of the two means, and 1 where both are 0.  A row with a column `items` stands for so many items."""
    items = F.col("items") if "items" in components.columns else F.lit(1)
    acc, rec = F.when(F.col("pred_total") > 0, F.col("acc")), F.when(F.col("label_total") > 0, F.col("rec"))
    # sums by component and level first, so that no component row is multiplied for the levels of the roll-up
    sums = components.groupBy("component", "hardness").agg(
        *[f for c, n in ((acc, "acc"), (rec, "rec")) for f in (F.sum(c * items).alias(n), F.sum(F.when(c.isNotNull(), items)).alias(f"{n}_n"))]
    )
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c).cast("double"), F.sum(f"{c}_n")), F.lit(0.0)).alias(c)
    means = sums.rollup("component", "hardness").agg(mean("acc"), mean("rec"))
    both = F.col("acc") + F.col("rec")
    f1 = F.when(both == 0, 1.0).otherwise(F.try_divide(2 * F.col("acc") * F.col("rec"), both))
    return means.where("component is not null").select(
        F.coalesce("hardness", F.lit("all")).alias("level"), "component", "acc", "rec", f1.alias("f1")
    )


def score_report(counts: DataFrame, partials: DataFrame) -> DataFrame:
    """Metric by level, then the turn section: metric by turn.  A level or turn without items shows 0."""
    rows = counts.select(
        "level", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in (("count", "n"), ("execution", "exec"), ("exact match", "exact"))]))
    ).unionByName(
        partials.select(
            "level",
            F.inline(F.array(*[F.struct(F.concat(F.col("component"), F.lit(f" {m}")).alias("metric"), F.col(m).alias("value")) for m in ("acc", "rec", "f1")])),
        )
    )
    wide = rows.groupBy("metric").pivot("level", [*LEVELS, *TURNS]).agg(F.first("value"))
    # sessions have no components: both means are 0, which makes F1 1
    empty = {"joint_all": F.when(F.endswith("metric", F.lit(" f1")), 1.0).otherwise(0.0)}
    by_turn = F.col("metric").isin("count", "execution", "exact match")
    return wide.select(
        "metric",
        *[F.coalesce(F.col(f"`{c}`"), empty.get(c, F.lit(0.0))).alias(c) for c in LEVELS],
        *[F.when(by_turn, F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in TURNS],
    )


def result_set_match(
    pred: DataFrame, gold: DataFrame, keep_distinct: bool = True, order: list[str] | None = None, any_column_order: bool = False
) -> DataFrame:
    """One row (n_pred, n_gold, matches): do two query results hold the same bag of rows?

    Rows are counted per value on each side; `keep_distinct=False` compares sets, and with `order` the
    position of a row counts too.  Columns are compared by place, under pred's names, or with `any_column_order` in
    any order, each side under its own names; results with another number of columns never match.
    """
    same_width = len(pred.columns) == len(gold.columns)
    if same_width and not any_column_order:
        gold = gold.toDF(*pred.columns)
    sides, names = [], []
    for df in (pred, gold):
        df = df if keep_distinct else df.distinct()
        own = [f"_v{i}" for i in range(len(df.columns))]
        df = with_position(df, order, name="_at").toDF(*own, "_at") if order else df.toDF(*own)
        sides.append(df)
        names.append(own)
    if not same_width:
        return _counts_of(*sides).withColumn("matches", F.lit(False))
    if not any_column_order:
        return _compared(*sides, *names)
    sides = [evaluated_once(df, "result") for df in sides]
    *others, last = column_assignments(*sides, *names) or [None]
    for columns in others:
        found = _compared(*sides, columns, names[1])
        if found.first()["matches"]:
            return found
    return _counts_of(*sides).withColumn("matches", F.lit(False)) if last is None else _compared(*sides, last, names[1])


def _counts_of(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n_pred, n_gold)."""
    both = pred.select(F.lit(1).alias("_p")).unionByName(gold.select(F.lit(0).alias("_p")))
    return both.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(1 - F.col("_p")), F.lit(0)).alias("n_gold"))


def _compared(pred: DataFrame, gold: DataFrame, pred_columns: list[str], gold_columns: list[str]) -> DataFrame:
    place = ["_at"] if "_at" in gold.columns else []
    keys = [f"_c{i}" for i in range(len(gold_columns))]
    sides = [
        df.select(*place, *[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keys, strict=True)], F.lit(p).alias("_p"))
        for df, columns, p in ((pred, pred_columns, 1), (gold, gold_columns, 0))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy(*place, *keys).agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("g"))
    return counts.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"),
        F.coalesce(F.bool_and(F.col("p") == F.col("g")), F.lit(True)).alias("matches"),
    )


def _fingerprints(df: DataFrame, lists: list[list[str]]) -> list[tuple]:
    """For each list of columns a fingerprint of the bag of its rows, in one scan; positions count where there are any.

    Values are compared as text, with a mark that tells null from a text.
    """
    place = [F.col("_at")] if "_at" in df.columns else []

    def hashed(columns: list[str], seed: int) -> Column:
        cells = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
        return F.xxhash64(F.lit(seed), *place, *cells).cast("decimal(20,0)")

    sums = [F.sum(hashed(columns, seed)) for columns in lists for seed in (0, 1)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return [(row[0], row[1 + 2 * i], row[2 + 2 * i]) for i in range(len(lists))]


def column_assignments(pred: DataFrame, gold: DataFrame, pred_names: list[str], gold_names: list[str]) -> list[list[str]]:
    """The orders of pred's columns in which both results may hold the same rows, most often none or one.

    Each gold column can only be a pred column whose bag of values has the same fingerprint.  Columns are settled one by
    one, and a beginning is kept only if the bag of its rows has the fingerprint of gold's; columns of pred that are equal in
    every row need no more than one order.
    """
    single = dict(zip(pred_names, _fingerprints(pred, [[c] for c in pred_names]), strict=True))
    wanted = _fingerprints(gold, [[c] for c in gold_names])
    fits = [[c for c in pred_names if single[c] == w] for w in wanted]
    if not all(fits) or sorted(single.values(), key=str) != sorted(wanted, key=str):
        return []
    alike = [(a, b) for i, a in enumerate(pred_names) for b in pred_names[i + 1 :] if single[a] == single[b]]
    twins: set[tuple[str, str]] = set()
    if alike:
        same = pred.agg(*[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))) for a, b in alike]).first()
        twins = {pair for pair, equal in zip(alike, same, strict=True) if equal is not False}
    begun: list[list[str]] = [[]]
    for i, candidates in enumerate(fits):
        longer = [
            [*own, c]
            for own in begun
            for c in candidates
            if c not in own and not any(b == c and a not in own for a, b in twins)  # of equal columns the first goes first
        ]
        if len(candidates) > 1 and len(longer) > 1:
            (want,) = _fingerprints(gold, [gold_names[: i + 1]])
            longer = [own for own, found in zip(longer, _fingerprints(pred, longer), strict=True) if found == want]
        begun = longer
    return begun
