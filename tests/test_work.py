"""What a query does per row: plans and memory that must not grow faster than the input."""

import json
import tracemalloc
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from cellweft.operators import embeddings as emb
from cellweft.operators import examples, grid, scoring
from cellweft.plans import scoring_queries, text_queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def write_orders(spark, folder):
    rows = [*((k, k % 4) for k in [*range(60), 11]), (None, None)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_each_query_is_parsed_once(spark, tmp_path):
    sf = write_orders(spark, tmp_path)
    for query in (scoring_queries.keyword_overlap, scoring_queries.connector_set_equal, scoring_queries.sorted_list_equality):
        assert plan_of(query(spark, sf)).count("from_json(") == 2
    # and its text is made without a lambda, which would be interpreted for every row
    assert "lambda" not in plan_of(scoring_queries.items(spark, sf).select("gold", "pred"))


def test_links_are_looked_for_in_texts_that_hold_them(spark):
    low = {"select": [], "tables": []}
    texts = ['{"union":{"select":[]}}', '{"\\u0075nion":{"select":[]}}', "{'union':{'select':[]}}", json.dumps({**low, "where": {"conds": [], "links": []}}), "{}", None]
    df = spark.createDataFrame([(i, t, "{}") for i, t in enumerate(texts)], "q int, gold string, pred string")
    nodes = scoring.paired_nodes(df)
    assert "Contains(gold" in plan_of(nodes)
    assert {r.q for r in nodes.where("linked").collect()} == {0, 1, 2}


def test_partial_averages_sums_before_the_roll_up(spark):
    rows = [("a", "easy", 1, 1, 1), ("a", "hard", 0, 1, 0), ("a", None, 1, 0, 1), ("b", "easy", 0, 0, 0), (None, "easy", 1, 1, 1)]
    comps = spark.createDataFrame(rows, "component string, hardness string, pred_total int, label_total int, acc int").withColumn("rec", F.col("acc"))
    means = scoring.partial_averages(comps)
    plan = plan_of(means)
    assert "Aggregate" in plan[plan.index("Expand") :]
    found = {(r.component, r.level, r.acc, r.rec) for r in means.collect()}
    assert {("a", "easy", 1.0, 1.0), ("a", "hard", 0.0, 0.0), ("b", "all", 0.0, 0.0), ("b", "easy", 0.0, 0.0), ("a", "all", 1.0, 0.5)} <= found


def test_pairs_of_a_grid_are_not_grouped(spark):
    cells = [(t, r, c, 1) for t, rows in (("x", [[0, 1], [0, 1], [1, 2], [2]]), ("y", [[0, 1, 2]]), (None, [[3], [3]])) for c, items in enumerate(rows) for r in items]
    df = spark.createDataFrame([*cells, ("x", 5, 0, 0)], "table_id string, row_pos int, col_pos int, mask int")
    pairs = grid.pair_masks(df)[1]
    assert "Aggregate" not in plan_of(pairs).split("Generate")[0]
    want = Counter((t, a, b) for t, a, c, _ in cells for u, b, d, _ in cells if t == u and c == d)
    assert Counter({(r.table_id, r.a, r.b): r.n_joint for r in pairs.collect()}) == want


def test_rare_words_alone_are_shuffled(spark, monkeypatch):
    texts = {1: "a b a", 2: "c a d d", 3: "", 4: None, 5: "e"}
    docs = spark.createDataFrame([*texts.items(), (2, "a")], "k int, text string")
    vocab = spark.createDataFrame([("a", 0), ("d", 1), ("b", 2), ("c", -3), ("x", 4)], "word string, id int")
    monkeypatch.setattr(examples, "COMMON_IDS", 2)
    got = sorted((r.k, list(r.ids)) for r in examples.tokenise_by_vocabulary(docs, "k", "text", vocab).collect())
    assert got == [(1, [0, 2, 0]), (2, [-3, 0, 0, 1, 1]), (2, [-3, 0, 0, 1, 1]), (3, []), (4, []), (5, [])]


def test_equal_cells_are_embedded_and_joined_as_one_row(spark):
    rows = [("t", 0, r, v) for r, v in enumerate(["x y", "x y", None, "nan", "x y"])] + [("u", 1, 0, "x y")]
    counted = emb.counted_cells(spark.createDataFrame(rows, "table_id string, col_idx int, row_id int, value string"))
    assert counted.count() == 4
    cells = emb.embed_cells(counted, emb.native_vector(4), distinct=True)
    assert {(r.table_id, r.value): r.n for r in cells.groupBy("table_id", "value").agg(F.sum("n_cells").alias("n")).collect()} == {("t", "x y"): 3, ("t", "nan"): 2, ("u", "x y"): 1}


def test_words_are_counted_without_lists_of_them():
    frame = pd.DataFrame({"doc_id": range(300), "text": [" ".join(["ab"] * 2000)] * 298 + ["", None]})
    tracemalloc.start()
    out = text_queries._lengths(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["n_words"].tolist()[:299] == [2000.0] * 298 + [1.0] and pd.isna(out["n_words"].iloc[299])
    assert peak < 298 * 6000


def test_equal_pairs_of_queries_are_parsed_and_compared_once(spark):
    """Items meet the scores of their pair; repeated, null and nested items get what they get one by one."""
    select = [{"agg": "none", "val": {"op": "none", "u1": {"agg": "none", "col": "__t.a__", "distinct": False}}}]
    plain, nested = json.dumps({"select": select}), json.dumps({"select": select, "union": {"select": select}})
    kinds = [(plain, plain), (plain, "{}"), (nested, nested), (nested, plain), (None, plain)]
    rows = [(i, i % 3, "d", *kinds[i % 5]) for i in range(60)] + [(2, 2, "d", nested, nested), (None, 1, "d", nested, nested), (None, 1, None, plain, plain)]
    items = spark.createDataFrame(rows, "q int, session int, db_id string, gold string, pred string")
    met = []

    def nodes(pairs):
        met.append(pairs.count())
        return scoring.paired_nodes(pairs).withColumn("here", F.col("gold").isNotNull())

    once = scoring.pair_scores(items, nodes, "q", ("session",), ("here",))
    assert met == [6]
    each = scoring.item_scores(scoring.paired_nodes(items).withColumn("here", F.col("gold").isNotNull()), "q", ("session",), ("here",))
    assert sorted(map(str, once.collect())) == sorted(map(str, each.collect()))

    def averages(scores):
        return sorted(map(str, scoring.partial_averages(scoring.component_suite(scores)).collect()))

    leveled = once.withColumn("hardness", F.when(F.col("here"), "easy").otherwise("hard"))
    alike = scoring.alike_scores(leveled)
    assert alike.count() < 10 and alike.agg(F.sum("items")).first()[0] == leveled.count()
    assert averages(alike) == averages(leveled)


def test_items_carry_the_number_of_their_tree_and_no_parts(spark):
    """Trees are graded once, in methods that the JVM compiles, from texts of the items asked for; rows that share a key are one tree."""
    select = [{"agg": "none", "val": {"op": "none", "u1": {"agg": "none", "col": "__t.a__", "distinct": False}}}]
    plain, nested = json.dumps({"select": select}), json.dumps({"select": select, "union": {"select": select}})
    kinds = [(plain, plain), (nested, nested), (nested, plain)]
    rows = [(i, "d", *kinds[i % 3]) for i in range(30)] + [(1, "d", nested, nested), (None, "d", plain, "{}"), (None, None, nested, nested)]
    items = spark.createDataFrame(rows, "q int, db_id string, gold string, pred string")
    limit, seen, asked = "spark.sql.codegen.hugeMethodLimit", [], []
    before = spark.conf.get(limit)

    def leveled(pairs):
        return scoring.paired_nodes(pairs).withColumn("hardness", F.when(F.col("gold").isNotNull(), "easy").otherwise("hard"))

    def nodes(pairs):
        seen.append((spark.conf.get(limit), pairs.count()))
        return leveled(pairs)

    def lookup(keys, key):
        asked.append({r[0] for r in keys.select(key).collect()})
        return items.join(keys, F.col("q").eqNullSafe(F.col(key)), "left_semi")

    trees, parts = scoring.paired_trees(items, nodes, "q", top=("hardness",), lookup=lookup)
    assert seen == [("8000", 5)] and spark.conf.get(limit) == before and asked == [{0, 1, 2, None}]
    assert trees.columns == ["q", "hardness", "exact", "tree"] and parts.columns == ["tree", "parts"]
    assert trees.count() == 32 and [r.q for r in trees.where("tree < 0").collect()] == [1]
    each = scoring.item_scores(leveled(items), "q", top=("hardness",))
    by_item, by_tree = (sorted(map(str, df.select("hardness", "parts", "items").collect())) for df in (scoring.alike_scores(each), scoring.alike_trees(trees, parts)))
    assert by_item == by_tree


def test_score_counts_sums_before_the_levels(spark):
    rows = [(1, "easy", "turn 1", 1, 1), (1, "hard", "turn 2", 0, 1), (2, None, "turn 1", 1, 0), (2, "easy", None, None, 1)]
    items = spark.createDataFrame(rows, "session int, hardness string, turn_id string, exec int, exact int")
    counts = scoring.score_counts(items)
    plan = plan_of(counts)
    assert plan[plan.index("Expand") :].split("LogicalRDD")[0].count("Aggregate") == 1
    found = {(r.level, r.n, r["exec"], r.exact) for r in counts.collect()}
    assert {("easy", 2, 0.5, 1.0), ("hard", 1, 0.0, 1.0), ("turn 1", 2, 1.0, 0.5), ("all", 4, 0.5, 0.75), ("joint_all", 2, 0.5, 0.5)} <= found
