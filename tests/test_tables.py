import itertools
import json
import sqlite3

import numpy as np
from pyspark.sql import functions as F

import pytest
from cellweft.operators import corpus, describe, grid, pairs, profile
from cellweft.sources import stores, tables

COLUMNS = "table_id string, col_idx int, col_name string, dtype string"
CELLS = "table_id string, row_id bigint, col_idx int, value string"


def profiled(spark, cells, columns):
    c = spark.createDataFrame(cells, CELLS)
    d = spark.createDataFrame(columns, COLUMNS)
    groups = profile.value_groups(c)
    return groups, d, profile.profile_columns(groups, d)


def test_empty_table_takes_its_first_column_as_key(spark):
    _, _, profiles = profiled(spark, [], [("t", 0, "a", "int64"), ("t", 1, "b", "object")])
    assert profile.infer_primary_key(profiles).first().primary_key == "a"


def test_key_needs_unique_values_without_gaps(spark):
    cells = [("t", 1, 0, "1"), ("t", 2, 0, None), ("t", 1, 1, "x"), ("t", 2, 1, "x")]
    _, _, profiles = profiled(spark, cells, [("t", 0, "a", "int64"), ("t", 1, "b", "object")])
    assert profile.infer_primary_key(profiles).first().primary_key == ""
    a = profiles.where("col_idx = 0").first()
    assert (a.n_rows, a.n_nulls, a.n_distinct, a.contains_null, a.is_unique, a.pandas_dtype) == (2, 1, 1, True, False, "float64")


def test_example_values_limits(spark):
    cells = [("t", i, 0, str(i)) for i in range(1, 4)] + [("t", i, 1, f"{i}.5") for i in range(1, 5)] + [("t", i, 2, None) for i in range(1, 4)]
    cells += [("t", 1, 3, "x" * 81), ("t", 2, 3, "y" * 80)]
    groups, d, _ = profiled(spark, cells, [("t", 0, "a", "int64"), ("t", 1, "b", "float64"), ("t", 2, "c", "object"), ("t", 3, "d", "object")])
    got = {r.col_name: r.examples for r in profile.example_values(groups, d).collect()}
    assert got == {"a": ["1", "2", "3"], "b": ["1.5", "2.5", "..."], "c": [], "d": ["x" * 80 + "....", "y" * 80]}
    drop = spark.createDataFrame([("t", 1, "1.5")], "table_id string, col_idx int, value string")
    fewer = {r.col_name: r.examples for r in profile.example_values(groups, d, exclude=drop).collect()}
    assert fewer["b"] == ["2.5", "3.5", "4.5"]
    none = {r.col_name: r.examples for r in profile.example_values(groups, d, valuecount=1).collect()}
    assert none["a"] == ["1", "..."]


def test_imputation_of_an_empty_column_is_zero(spark):
    cells = spark.createDataFrame([("t", 1, 0, None), ("t", 2, 0, None), ("t", 1, 1, "2"), ("t", 2, 1, None), ("t", 3, 1, "4")], CELLS)
    cols = spark.createDataFrame([("t", 0, "a", "float64"), ("t", 1, "b", "int64")], COLUMNS)
    for bounded in (True, False):
        got = profile.impute_mean(cells, cols, bounded).collect()
        assert sorted((r.col_idx, r.row_id, r.number) for r in got) == [(0, 1, 0.0), (0, 2, 0.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0)]


def test_half_of_the_names_is_enough(spark):
    cols = spark.createDataFrame([("t", 0, "id", "int64"), ("t", 1, "address", "object"), ("u", 0, "l_tax", "object"), ("u", 1, "a_1", "object"), ("u", 2, "city", "object")], COLUMNS)
    assert {r.table_id: r.cls for r in corpus.classify_tables(cols).collect()} == {"t": "non_semantic", "u": "semantic"}
    names = spark.createDataFrame([(n,) for n in ("col1", "12", "ab", "c_9", "l_tax", "address_2x", "abc")], "n string")
    flags = {r.n: r.f for r in names.select("n", corpus.is_non_semantic_name("n").alias("f")).collect()}
    assert [n for n, f in flags.items() if f] == ["col1", "12", "ab", "c_9"]


def test_schema_line(spark):
    cells = [("t", 1, 0, "1"), ("t", 2, 0, "2"), ("t", 1, 1, "x"), ("t", 2, 1, "x")]
    groups, d, profiles = profiled(spark, cells, [("t", 0, "Id", "int64"), ("t", 1, "my name", "object")])
    keys = profile.infer_primary_key(profiles)
    assert describe.describe_table(profiles, keys).first().line == 'table t, columns = [t.Id(<insert_embs>|int64|primary key), t."my name"(<insert_embs>|object)]'
    shown = describe.describe_table(profiles, keys, profile.example_values(groups, d), "values", lower=True).first().line
    assert shown == "table t, columns = [t.id(<insert_embs>|int64|primary key|values: 1, 2), t.\"my name\"(<insert_embs>|object|values: 'x')]"


def test_pairs_equal_brute_force(spark):
    for n in (0, 1, 2, 5, 90):
        names = [f"t{i:03}" for i in range(n)]
        df = spark.createDataFrame([(x, 4) for x in names], "table_id string, n_cols int")
        got = [tuple(r) for r in pairs.pair_all(df, "table_id", 50).collect()]
        assert sorted(got) == sorted(list(itertools.combinations_with_replacement(names, 2))[:50])
        rows = pairs.pair_same_width(df, 1, 20).collect()
        assert sorted((r.left_id, r.right_id) for r in rows if r.kind == "different") == list(itertools.combinations(names, 2))[:20]
        same = [r for r in rows if r.kind == "same"]
        assert len(same) == min(20, n * (n - 1) // 2) and all(r.left_id == r.right_id for r in same)


def test_resolve_table_name(spark):
    names = spark.createDataFrame([("d", n) for n in ("Users.csv", "user_log.csv", "A.b.csv", "users_old.csv")], "db_id string, name string")
    keys = spark.createDataFrame([("d", k) for k in ("USERS", "log", "a", "Ser", "nope", "")], "db_id string, key string")
    got = {r.key: (r.name, r.tier) for r in pairs.resolve_table_name(keys, names).collect()}
    assert got == {
        "USERS": ("Users", "equal"), "log": ("user_log", "contains"), "a": ("A", "equal"), "Ser": ("Users", "contains"),
        "nope": (None, "missing"), "": ("A", "contains"),
    }


def test_grid_and_pair_masks(spark):
    cells = spark.createDataFrame([("t", r, c, f"{r}{c}") for r in range(2) for c in range(3)], "table_id string, row_pos int, col_pos int, value string")
    sizes = spark.createDataFrame([("t", 2, 3), ("empty", 0, 2)], "table_id string, n_rows int, n_cols int")
    padded = grid.pad_grid(cells, sizes, 4, 5)
    assert padded.count() == 2 * 4 * 5 and padded.agg(F.sum("mask")).first()[0] == 6
    mask = np.zeros((4, 5), int)
    mask[:2, :3] = 1
    for got, want in zip(grid.pair_masks(padded), (mask.T @ mask, mask @ mask.T)):
        assert {(r.a, r.b): r.n_joint for r in got.collect()} == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want))}
    arrays = spark.range(1).select(grid.resolve_padding(grid.pad_permutation(F.array(F.lit(1), F.lit(0)), 4)).alias("p"), grid.row_padding_mask(F.lit(2), 4).alias("m")).first()
    assert arrays.p == [1, 0, 2, 3] and arrays.m == [False, False, True, True]


def test_csv_corpus_with_quotes_and_a_broken_table(spark, tmp_path):
    db = tmp_path / "shop"
    db.mkdir()
    (db / "good.csv").write_text('id,note,flag\n1,"a, ""b""",True\n2,,False\n')
    (db / "twice.csv").write_text("id,x\n1,2.5\nid,x\n")
    (db / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    rows, columns, rejects = tables.read_csv_corpus(spark, str(tmp_path))
    assert sorted((r.table_id, r["values"]) for r in rows.collect()) == [
        ("shop/good", ["1", 'a, "b"', "True"]), ("shop/good", ["2", None, "False"]), ("shop/twice", ["1", "2.5"]), ("shop/twice", ["id", "x"]),
    ]
    assert {(r.table_id, r.col_name): r.dtype for r in columns.collect()} == {
        ("shop/good", "id"): "int64", ("shop/good", "note"): "object", ("shop/good", "flag"): "bool",
        ("shop/twice", "id"): "object", ("shop/twice", "x"): "object",
    }
    assert [(r.table_id, r.n_bad) for r in rejects.collect()] == [("shop/bad", 1)]
    assert sorted((r.db_id, r.table_name) for r in tables.discover_tables(spark, str(tmp_path)).collect()) == [("shop", "bad"), ("shop", "good"), ("shop", "twice")]


def test_sqlite_files_are_cut_and_bad_ones_listed(spark, tmp_path):
    db = tmp_path / "shop"
    db.mkdir()
    con = sqlite3.connect(db / "shop.sqlite")
    con.execute("CREATE TABLE item (k INTEGER, name TEXT)")
    con.executemany("INSERT INTO item VALUES (?, ?)", [(i, None if i == 3 else f"n{i}") for i in range(25)])
    con.execute("CREATE TABLE pair (a TEXT PRIMARY KEY, b REAL) WITHOUT ROWID")
    con.execute("INSERT INTO pair VALUES ('x', 1.5)")
    con.commit()
    con.close()
    (db / "broken.sqlite").write_text("this is no database, but text that is long enough" * 40)
    rows, rejects = tables.sqlite_rows(spark, [str(db / "shop.sqlite"), str(db / "broken.sqlite")], rows_per_task=10)
    got = rows.collect()
    assert sorted(int(r["values"][0]) for r in got if r.table_name == "item") == list(range(25))
    assert [r["values"] for r in got if r.table_name == "pair"] == [["x", "1.5"]]
    assert [r["values"] for r in got if r.row_id == 4 and r.table_name == "item"] == [["3", None]]
    assert rejects.count() == 1 and {r.db_id for r in got} == {"shop"}


def test_examples_from_a_json_list(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"instruction": "q\nr", "answer": "a", "path_csvs": ["x.csv", "y.csv"]}]))
    row = stores.read_examples(spark, str(tmp_path / "e.json")).first()
    assert (row.instruction, row.path_csvs, row.db_id) == ("q\nr", ["x.csv", "y.csv"], None)


def test_catalogue_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shopdb LOCATION '{tmp_path}/shopdb'")
    try:
        spark.range(3).write.saveAsTable("shopdb.numbers")
        found = tables.catalogue_tables(spark, ["shopdb"])
        tables.extract_tables(found, f"{tmp_path}/out")
        rows, _, _ = tables.read_csv_corpus(spark, f"{tmp_path}/out", folder_is_table=True)
        assert sorted((r.table_id, r["values"]) for r in rows.collect()) == [("shopdb/numbers", [str(i)]) for i in range(3)]
    finally:
        spark.sql("DROP DATABASE shopdb CASCADE")


def test_numeric_tables_show_integers_as_floats(spark):
    cells = spark.createDataFrame([("n", 1, 0, "1"), ("n", 1, 1, "2.5"), ("m", 1, 0, "1"), ("m", 1, 1, None)], CELLS)
    cols = spark.createDataFrame([("n", 0, "a", "int64"), ("n", 1, "b", "float64"), ("m", 0, "a", "int64"), ("m", 1, "b", "object")], COLUMNS)
    got = {(r.table_id, r.col_idx): r.value for r in corpus.stringify(cells, cols, pandas_compat=True).collect()}
    assert got == {("n", 0): "1.0", ("n", 1): "2.5", ("m", 0): "1", ("m", 1): "nan"}


def test_predictions_pair_up_and_resume_tells_errors_apart(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from cellweft.sources import stores

    rows = [(1, f"p{i}", f"g{i}", "d") for i in (3, 1, 2)] + [(0, "p0", "g0", "d")]
    stores.write_predictions(spark.createDataFrame(rows, "question_id int, pred string, gold string, db_id string").repartition(3), f"{tmp_path}/p")
    read = lambda name: [line for f in sorted((tmp_path / "p" / name).glob("part-*")) for line in f.read_text().splitlines()]
    assert read("pred") == ["p0", "p1", "p2", "p3"] and [g.split("\t")[0] for g in read("gold")] == ["g0", "g1", "g2", "g3"]
    todo = spark.range(3).withColumnRenamed("id", "k")
    assert stores.resume_or_compute(todo, f"{tmp_path}/s", "k", lambda x: x).count() == 3
    assert stores.resume_or_compute(todo, f"{tmp_path}/s", "k", lambda x: x).count() == 3
    with pytest.raises(AnalysisException):
        stores.resume_or_compute(todo.withColumnRenamed("k", "other"), f"{tmp_path}/s", "other", lambda x: x)


def test_primary_keys_by_sketch_equal_full_profiles(spark):
    cells = [("t", r, 0, str(r % 500)) for r in range(1000)] + [("t", r, 1, str(r)) for r in range(1000)] + [("t", r, 2, None if r == 5 else str(r)) for r in range(1000)]
    cells += [("u", r, 0, str(max(r, 1))) for r in range(1000)] + [("v", r, 0, "x" * (r + 1)) for r in range(3)]
    df = spark.createDataFrame(cells, "table_id string, row_id bigint, col_idx int, value string")
    columns = spark.createDataFrame(
        [("t", 0, "a", "object"), ("t", 1, "b", "object"), ("t", 2, "c", "object"), ("u", 0, "a", "object"), ("v", 0, "k", "object"), ("w", 0, "empty", "object")],
        "table_id string, col_idx int, col_name string, dtype string",
    )
    got = {tuple(r) for r in profile.find_primary_key(df, columns).collect()}
    assert got == {("t", "b"), ("u", ""), ("v", "k"), ("w", "empty")}
    assert got == {tuple(r) for r in profile.infer_primary_key(profile.profile_columns(profile.value_groups(df), columns)).collect()}


def test_csv_as_people_write_it(spark, tmp_path):
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "broken.csv").write_text('id,note,n\n1,"two\nlines, ""quoted""\n\nand more",5\n\n2,NA,N/A\n3\n4,"",6\n')
    (shop / "plain.csv").write_text("a,b\n1,x\n\n2,null\n3\n")
    (shop / "head.csv").write_text('"two\nlines",b\n1,2\n')
    (shop / "bad.csv").write_text("a,b\n1,2,3\n")
    rows, columns, rejects = tables.read_csv_corpus(spark, str(tmp_path))
    got = {}
    for r in rows.orderBy("table_id", "file_start", "line_id").collect():
        got.setdefault(r.table_id, []).append(r["values"])
    assert got == {
        "shop/broken": [["1", 'two\nlines, "quoted"\n\nand more', "5"], ["2", None, None], ["3", None, None], ["4", None, "6"]],
        "shop/plain": [["1", "x"], ["2", None], ["3", None]],
        "shop/head": [["1", "2"]],
    }
    kinds = {(r.table_id, r.col_name): r.dtype for r in columns.collect()}
    assert kinds[("shop/broken", "n")] == "float64" and kinds[("shop/broken", "id")] == "int64" and ("shop/head", "two\nlines") in kinds
    assert [(r.table_id, r.n_bad) for r in rejects.collect()] == [("shop/bad", 1)]


def test_primary_keys_of_many_small_tables(spark):
    cells = spark.range(20000 * 9).selectExpr("concat('t', id div 9) AS table_id", "id % 9 AS row_id", "0 AS col_idx", "concat('v', id) AS value")
    columns = spark.range(20000).selectExpr("concat('t', id) AS table_id", "0 AS col_idx", "'k' AS col_name", "'object' AS dtype")
    assert profile.find_primary_key(cells, columns).where("primary_key = 'k'").count() == 20000


def test_quotes_inside_unquoted_fields(spark, tmp_path):
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "pipes.csv").write_text('id,note\n1,5" pipe\n2,x\n3,"two\nlines, 6"" \n7"" end"\n4,7" pipe\n5,"q"\n6,y\n')
    rows, _, rejects = tables.read_csv_corpus(spark, str(tmp_path))
    got = [r["values"] for r in rows.orderBy("file_start", "line_id").collect()]
    assert got == [["1", '5" pipe'], ["2", "x"], ["3", 'two\nlines, 6" \n7" end'], ["4", '7" pipe'], ["5", "q"], ["6", "y"]]
    assert rejects.collect() == []
