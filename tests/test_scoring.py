import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweft.operators import embeddings as emb
from cellweft.operators import scoring
from cellweft.functions import vectors as vec
from cellweft.streaming import metric_blocks


def v(col, agg="none"):
    return {"op": "none", "u1": {"agg": agg, "col": col, "distinct": False}}


def cond(col, op="=", neg=False, **kw):
    return {"neg": neg, "op": op, "val": v(col), **kw}


def query(select=("__t.a__",), where=(), links=(), **kw):
    return {
        "select": [{"agg": "none", "val": v(c)} for c in select],
        "tables": [{"kind": "table_unit", "id": "__t__"}],
        "where": {"conds": list(where), "links": list(links)},
        **kw,
    }


def suite(spark, pairs):
    rows = [(i, json.dumps(g), None if p is None else json.dumps(p)) for i, (g, p) in enumerate(pairs)]
    df = scoring.empty_query_default(spark.createDataFrame(rows, "q int, gold string, pred string"), "pred")
    out = scoring.component_suite(scoring.item_scores(scoring.paired_nodes(df), "q")).collect()
    exact = {r.q: r.exact for r in out}
    return [exact[i] for i in range(len(pairs))], {(r.q, r.component): (r.label_total, r.pred_total, r.cnt, r.f1) for r in out}


def test_exact_match(spark):
    a, b = query(("__t.a__", "__t.b__")), query(("__t.b__", "__t.a__"))
    lit1, lit2 = query(where=[cond("__t.a__", val1="x")]), query(where=[cond("__t.a__", val1='y "q",')])
    sub1 = query(where=[cond("__t.a__", op="in", sub1=query(where=[cond("__t.b__", val1="x")]))])
    sub2 = query(where=[cond("__t.a__", op="in", sub1=query(where=[cond("__t.b__", val1="z")]))])
    other = query(where=[cond("__t.a__", op="in", sub1=query(where=[cond("__t.c__", val1="x")]))])
    no_table = query(tables=[])
    exact, parts = suite(spark, [(a, b), (lit1, lit2), (sub1, sub2), (sub1, other), (a, None), (no_table, query()), (query(), no_table)])
    assert exact == [1, 1, 1, 0, 0, 1, 0]
    assert parts[(4, "select")] == (2, 0, 0, 0)


def test_set_operations_to_any_depth(spark):
    def deep(n, last):
        return query((last,)) if n == 0 else query(union=deep(n - 1, last))

    pairs = [(deep(5, "__t.a__"), deep(5, "__t.a__")), (deep(5, "__t.a__"), deep(5, "__t.b__")), (deep(5, "__t.a__"), deep(4, "__t.a__"))]
    pairs += [(query(union=query()), query(intersect=query())), (query(union=query(), intersect=query()), query(union=query(), intersect=query(("__t.z__",))))]
    exact, parts = suite(spark, pairs)
    assert exact == [1, 0, 0, 0, 0]
    assert parts[(1, "IUEN")] == (1, 1, 0, 0) and parts[(3, "IUEN")] == (1, 1, 0, 0) and parts[(4, "IUEN")] == (2, 2, 1, 0)


def test_order_and_group_rules(spark):
    def o(limit, direction="asc"):
        extra = {} if limit is None else {"limit_rows": limit}
        return query(order_dir=direction, order_by=[v("__t.a__")], **extra)

    g = query(group_by=[{"agg": "none", "col": "__t.a__", "distinct": False}], having={"conds": [cond("__t.b__", val1="1")], "links": []})
    h = query(group_by=[{"agg": "none", "col": "__u.a__", "distinct": False}])
    exact, parts = suite(spark, [(o(1), o(9)), (o(1), o(None)), (o(1, "desc"), o(1)), (g, g), (g, h), (query(), query())])
    assert exact == [1, 0, 0, 1, 0, 1]
    assert parts[(4, "group(no Having)")][3] == 1 and parts[(4, "group")] == (1, 1, 0, 0) and parts[(5, "order")] == (0, 0, 0, 1)


def test_and_or_totals_stand_the_other_way_round(spark):
    two = query(where=[cond("__t.a__"), cond("__t.b__"), cond("__t.c__")], links=["and", "or"])
    one = query(where=[cond("__t.a__"), cond("__t.b__"), cond("__t.c__")], links=["and", "and"])
    _, parts = suite(spark, [(two, one)])
    assert parts[(0, "and/or")] == (1, 2, 0, 0)


@pytest.mark.parametrize(
    "q,level",
    [
        (query(), "easy"),
        (query(where=[cond("__t.a__")]), "easy"),
        (query(("__t.a__", "__t.b__"), where=[cond("__t.a__")]), "medium"),
        (query(where=[cond("__t.a__", neg=True), cond("__t.b__", neg=True)], links=["and"]), "medium"),
        (query(where=[cond("__t.a__", sub1=query())]), "hard"),
        (query(union=query(), where=[cond("__t.a__", sub1=query())]), "extra"),
        (query(having={"conds": [cond("__t.a__"), cond("__t.b__"), cond("__t.c__")], "links": ["and", "and"]}), "medium"),
        (query(limit_rows=1, order_dir="asc", order_by=[v("__t.a__")], where=[cond("__t.a__", op="like")]), "extra"),
    ],
)
def test_hardness(spark, q, level):
    df = spark.createDataFrame([(json.dumps(q),)], "t string").select(scoring.parse_query("t").alias("q"))
    assert df.select(scoring.hardness_level("q").alias("h")).first().h == level


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
def test_multiset_match(spark, p, g):
    df = spark.createDataFrame([(p, g)], "p array<string>, g array<string>")
    got = df.select(scoring.multiset_match(F.col("p"), F.col("g")).alias("n")).first().n
    assert got == sum((Counter(p) & Counter(g)).values()) <= min(len(p), len(g))


def test_foreign_key_groups_keep_the_order_of_pairs(spark):
    names = [(0, f"C{i}") for i in range(6)]
    entry = spark.createDataFrame([(["T"], names, [[5, 4], [2, 1], [4, 2]])], "t array<string>, c array<struct<tbl:int,name:string>>, k array<array<int>>")
    got = {}
    for e in entry.select(scoring.foreign_key_map("t", "c", "k").alias("m")).first().m:
        got[e.k] = e.v
    # 4-2 joins the first group and does not merge the second, which then wins for column 2
    assert got == {"__t.c2__": "__t.c1__", "__t.c4__": "__t.c2__", "__t.c5__": "__t.c2__", "__t.c1__": "__t.c1__"}


def test_foreign_keys_apply_only_to_tables_in_from(spark):
    maps = spark.createDataFrame([("d", [("__t.a__", "__s.a__"), ("__s.a__", "__s.a__")])], "db_id string, kmap array<struct<k:string,v:string>>")
    pairs = [(query(("__t.a__",)), query(("__s.a__",))), (query(("__u.a__",)), query(("__s.a__",)))]
    rows = [(i, "d", json.dumps(g), json.dumps(p)) for i, (g, p) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "q int, db_id string, gold string, pred string")
    scores = scoring.item_scores(scoring.with_key_map(scoring.paired_nodes(df), maps), "q").collect()
    assert {r.q: r.exact for r in scores} == {0: 1, 1: 0}


def test_report(spark):
    items = spark.createDataFrame([("s", "easy", "turn 1", 1, 1), ("s", "hard", "turn 2", 0, 1), ("r", "easy", "turn 1", 1, 1)], "session string, hardness string, turn_id string, exec int, exact int")
    counts = {r.level: (r.n, r["exec"], r.exact) for r in scoring.score_counts(items).collect()}
    assert counts["all"] == (3, 2 / 3, 1.0) and counts["joint_all"] == (2, 0.5, 1.0) and counts["hard"] == (1, 0.0, 1.0)
    comps = spark.createDataFrame([("easy", "where", 0, 0, 1), ("easy", "where", 1, 0, 0)], "hardness string, component string, label_total int, pred_total int, acc int").withColumn("rec", F.col("acc"))
    partial = {(r.level, r.component): (r.acc, r.rec, r.f1) for r in scoring.partial_averages(comps).collect()}
    assert partial[("easy", "where")] == (0.0, 0.0, 1.0)
    report = {r.metric: r.asDict() for r in scoring.score_report(scoring.score_counts(items), scoring.partial_averages(comps)).collect()}
    assert report["count"]["all"] == 3.0 and report["where f1"]["extra"] == 0.0 and report["where f1"]["easy"] == 1.0


def test_result_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, t string")
    assert scoring.result_set_match(a, a).first().matches
    assert not scoring.result_set_match(a, b).first().matches
    assert scoring.result_set_match(a, b, keep_distinct=False).first().matches
    assert scoring.result_set_match(a.limit(0), b.limit(0)).first().matches


def test_result_sets_in_any_column_order(spark):
    match = lambda p, g, **kw: scoring.result_set_match(p, g, any_column_order=True, **kw).first()
    rng = random.Random(8)
    for trial in range(12):
        width, n = rng.randint(1, 4), rng.randint(0, 7)
        gold = [tuple(rng.choice([1, 2, None]) for _ in range(width)) for _ in range(n)]
        if trial % 3 == 0:
            order = rng.sample(range(width), width)
            pred = [tuple(r[i] for i in order) for r in gold]
            rng.shuffle(pred)
        else:
            pred = [tuple(rng.choice([1, 2, None]) for _ in range(width)) for _ in range(n)]
        schema = ", ".join(f"c{i} int" for i in range(width))
        found = match(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema))
        want = any(Counter(tuple(r[i] for i in order) for r in pred) == Counter(gold) for order in itertools.permutations(range(width)))
        assert (found.n_pred, found.n_gold, found.matches) == (n, n, want)
    a = spark.createDataFrame([(1, "x", None), (2, "y", None)], "k int, t string, n string")
    assert not match(a, a.drop("n")).matches
    turned = a.select("n", "t", "k")
    assert match(turned, a, order=["k"]).matches
    assert not match(turned.withColumn("k", 3 - F.col("k")), a, order=["k"]).matches
    same = a.select("k", F.col("k").alias("k2"), F.col("k").alias("k3"), "t")
    assert match(same.select("t", "k3", "k", "k2"), same).matches
    assert len(scoring.column_assignments(same, same, same.columns, same.columns)) == 1


def test_trees_of_any_depth(spark):
    deep = json.dumps({"limit_rows": 0})
    for i in range(1, 40):
        deep = json.dumps({"limit_rows": i, ("union", "except", "intersect")[i % 3]: json.loads(deep)})
    rows = spark.createDataFrame([(1, deep, deep), (2, deep, "{}"), (3, "{}", None)], "q int, gold string, pred string")
    nodes = scoring.paired_nodes(rows)
    found = {(r.q, r.path.count("/")): (r.gold.limit_rows, r.pred.limit_rows if r.pred else None) for r in nodes.collect()}
    assert found == {**{(1, d): (39 - d, 39 - d) for d in range(40)}, **{(2, d): (39 - d, None) for d in range(40)}, (3, 0): (None, None)}


def test_empty_lists_equal_missing_fields(spark):
    def exact(gold, pred):
        nodes = scoring.paired_nodes(spark.createDataFrame([(1, json.dumps(gold), json.dumps(pred))], "q int, gold string, pred string"))
        return scoring.item_scores(nodes, "q").first()["exact"]

    value = {"op": "none", "u1": {"agg": "none", "col": "c", "distinct": False}}
    nested = lambda x: {"where": {"conds": [{"neg": False, "op": "=", "val": value, "sub1": x}], "links": []}}
    assert exact(nested({"group_by": []}), nested({})) == 1
    assert exact(nested({"where": {"conds": [], "links": []}, "select": []}), nested({"select": None})) == 1
    assert exact(nested({"group_by": [{"agg": "none", "col": "c"}]}), nested({})) == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(vec.l2_normalize("a").alias("u"), vec.l2_normalize("z").alias("z"), vec.cosine_similarity("a", "z").alias("c"), vec.cosine_similarity("a", "a").alias("s")).first()
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.c == 0.0 and row.s == pytest.approx(1.0)


def test_contrastive_loss_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a, s = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    rows = [(0, i, a[i].tolist(), s[i].tolist()) for i in range(5)]
    got = emb.contrastive_loss(spark.createDataFrame(rows, "batch_id bigint, item bigint, anchor array<double>, shuffled array<double>")).first()
    logits = np.concatenate([a @ s.T, a @ a.T], axis=1) / 0.07
    losses = [np.log(sum(np.exp(logits[i, k] - logits[i, i]) for k in range(10) if k != 5 + i)) for i in range(5)]
    assert got.loss == pytest.approx(np.mean(losses)) and got.n_items == 5


def test_widths_without_tables_show_zero(spark):
    sims = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.0), ("b", 1, 0.0)], "table_id string, col_idx int, similarity double")
    got = {r.n_cols: r.similarity for r in emb.cosine_by_width(sims, 4).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: pytest.approx(0.6), 3: 0.0}


def test_hot_value_is_embedded_once_and_kept_everywhere(spark):
    cells = spark.range(100).select(F.lit("t").alias("table_id"), F.col("id").alias("row_id"), F.lit(0).alias("col_idx"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("w "), "id")).alias("value"))
    plain = emb.embed_cells(cells, emb.native_vector(4)).select("row_id", "vector").collect()
    joined = emb.embed_cells(cells, emb.native_vector(4), distinct=True).select("row_id", "vector").collect()
    assert len(joined) == 100 and sorted(map(tuple, plain)) == sorted(map(tuple, joined))


def test_block_means_of_a_stream(spark, tmp_path):
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/in")
    out = metric_blocks.block_means(stream, "ts", "value")
    query_ = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query_.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("block_start").collect()
    assert [r.mean_value for r in got][:3] == [4.5, 14.5, 24.5] and all(r.n == 10 for r in got)


def _exact(spark, gold, pred, maps=None):
    nodes = scoring.paired_nodes(spark.createDataFrame([(1, "d", gold, pred)], "q int, db_id string, gold string, pred string"))
    nodes = nodes if maps is None else scoring.with_key_map(nodes, maps)
    return scoring.item_scores(nodes, "q").first()["exact"]


_WHERE = '{{"where":{{"conds":[{{"neg":false,"op":"=","val":{{"op":"none","u1":{{"agg":"none","col":"__t.a__"}}}},"sub1":{}}}]}}}}'


@pytest.mark.parametrize(
    ("gold", "pred", "exact"),
    [
        ('{"where":{"conds":[{"op":"=","val1":5}]}}', '{"where":{"conds":[{"op":"=","val1":6}]}}', 1),
        ('{"where":{"conds":[{"op":"=","val1":"a,\\"b"}]}}', '{"where": {"conds": [{"val1": -1.5, "op": "="}]}}', 1),
        ('{"limit_rows":3,"distinct":true}', '{"distinct":true,"union":null,"limit_rows":3}', 1),
        ('{"where":{"conds":[{"op":"=","val1":5}]}}', '{"where":{"conds":[{"op":">","val1":5}]}}', 0),
    ],
)
def test_nested_queries_are_compared_by_content(spark, gold, pred, exact):
    assert _exact(spark, _WHERE.format(gold), _WHERE.format(pred)) == exact


def test_links_with_spaces_count(spark):
    query = '{{"select":[],"union" : {{"select":[{{"agg":"none","val":{{"op":"none","u1":{{"agg":"none","col":"{}"}}}}}}]}}}}'
    assert _exact(spark, query.format("__t.a__"), query.format("__t.b__")) == 0
    assert _exact(spark, query.format("__t.a__"), query.format("__t.a__")) == 1


def test_nested_queries_use_the_outermost_from(spark):
    side = '{{"tables":[{{"kind":"table_unit","id":"__x__"}}],"union":{{"tables":[{{"kind":"table_unit","id":"__t__"}},{{"kind":"table_unit","id":"__u__"}}],"select":[{{"agg":"none","val":{{"op":"none","u1":{{"agg":"none","col":"{}"}}}}}}]}}}}'
    maps = spark.createDataFrame([("d", [("__t.a__", "__t.a__"), ("__u.a__", "__t.a__")])], "db_id string, kmap array<struct<k:string,v:string>>")
    assert _exact(spark, side.format("__t.a__"), side.format("__u.a__"), maps) == 0
    outer = side.replace('"__x__"', '"__t__"}},{{"kind":"table_unit","id":"__u__"')
    assert _exact(spark, outer.format("__t.a__"), outer.format("__u.a__"), maps) == 1


def test_arithmetic_and_aggregates_outside_select(spark):
    query = '{"order_by":[{"op":"-","u1":{"agg":"max","col":"__t.a__"},"u2":{"agg":"none","col":"__t.b__"}}]}'
    row = spark.createDataFrame([(query,)], "q string").select(scoring.parse_query("q").alias("q"))
    flags = row.select(*[c.alias(k) for k, c in scoring.condition_flags("q").items()]).first().asDict()
    assert flags == {"has_or": False, "has_like": False, "has_sql": False, "has_op": True, "has_agg": True}


def test_block_means_by_steps_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(run, step, rng.choice([None, rng.random()])) for run, n in (("a", 230), ("b", 100), ("c", 7)) for step in range(1, n + 1) if rng.random() < 0.9 or step == n]
    rows += [("d", 57, 1.0), ("a", None, 5.0)]
    schema = "run string, step bigint, value double"
    for i, at in enumerate(range(0, len(rows), 61)):  # several micro batches
        spark.createDataFrame(rows[at : at + 61], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    means = metric_blocks.step_means(stream, "run", "step", "value", 10)
    out = means.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert out.awaitTermination(180)
    got = {(r.run, r.block): r.mean_value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for run in "abcd":
        metrics = spark.createDataFrame([r for r in rows if r[0] == run], schema)
        want.update({(run, r.block): r.mean_value for r in emb.running_loss_mean(metrics, "step", "value", 10).collect()})
    assert got.keys() == want.keys() and ("a", 22) in got and ("d", 5) not in got
    assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)


def test_large_batches_in_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(b, i, *(rng.normal(size=6).tolist() for _ in range(2))) for b, n in ((0, 90), (1, 1), (2, 7)) for i in range(n)]
    batches = spark.createDataFrame(rows, "batch_id bigint, item bigint, anchor array<double>, shuffled array<double>")
    want = {r.batch_id: (r.n_items, r.loss) for r in emb.contrastive_loss(batches).collect()}
    for tile in (1000, 8):
        got = {r.batch_id: (r.n_items, r.loss) for r in emb.contrastive_loss_tiled(batches, tile=tile).collect()}
        assert got.keys() == want.keys()
        assert all(got[b][0] == want[b][0] and abs(got[b][1] - want[b][1]) < 1e-9 for b in want)


def test_key_groups_of_rows_follow_the_order_rule(spark):
    rng = random.Random(9)
    rows = [(d, t, rng.randrange(30), rng.randrange(30)) for d in range(6) for t in range(rng.choice([1, 5, 40]))]
    rows += [(7, t, t + 1, t) for t in range(60)] + [(8, t, 60 - t, 59 - t) for t in range(60)] + [(9, 0, 4, 4)]
    rows += [(10, t, 0, t) for t in range(50)]
    want = {}
    for d in {r[0] for r in rows}:
        groups = []
        for _, _, a, b in sorted(r for r in rows if r[0] == d):
            own = next((g for g in groups if a in g or b in g), None)
            if own is None:
                groups.append(own := set())
            own |= {a, b}
        want.update({(d, c): min(g) for g in groups for c in g})
    pairs = spark.createDataFrame(rows, "db_id bigint, pos bigint, a bigint, b bigint").repartition(4)
    assert {(r.db_id, r.col): r.representative for r in scoring.foreign_key_groups(pairs).collect()} == want
    assert scoring.foreign_key_groups(pairs.where("false")).collect() == []
