"""CSV records and JSON objects of files that many tasks read, against the csv and json libraries."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from cellweft.sources import splits, stores, tables


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, ("150", "1", "64"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_one_csv_file_with_open_quotes_over_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(4)
    texts = ["plain", "two\nlines", 'a "word"', "x, y", "\n\n", 'ends with "', '"\n"', "", 'z\n",\n,"', "long\n" * 40]
    rows = [[str(i), rng.choice(texts), str(rng.randrange(99))] for i in range(400)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "note", "n"], *rows])
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "one.csv").write_text(out.getvalue())
    (tmp_path / "db" / "flat.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(200)))
    pieces = splits.read_pieces(spark, str(tmp_path), "one.csv")
    assert pieces.select("file_start").distinct().count() > 20
    within, none = splits.csv_records(pieces)
    assert none.count() == 0 and within.select("file_start").distinct().count() > 20
    found, _, rejects = tables.read_csv_corpus(spark, str(tmp_path))
    got = {r["values"][0]: r["values"] for r in found.where("table_id = 'db/one'").collect()}
    assert got == {r[0]: [r[0], r[1] or None, r[2]] for r in rows}
    assert found.where("table_id = 'db/flat'").count() == 200 and rejects.count() == 0


def test_a_quote_that_is_never_closed(spark, tmp_path, small_splits):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "open.csv").write_text('a,b\n1,"x\ny"\n2,"never\n' + "".join(f"{i},{i}\n" for i in range(300)))
    (tmp_path / "db" / "good.csv").write_text('a,b\n1,"x\ny"\n')
    found, columns, rejects = tables.read_csv_corpus(spark, str(tmp_path))
    assert [tuple(r) for r in rejects.collect()] == [("db/open", 1, "quote left open")]
    assert [r["values"] for r in found.collect()] == [["1", "x\ny"]]
    assert {r.table_id for r in columns.collect()} == {"db/good"}


SCHEMA = "id bigint, text string, more array<struct<k:string,v:string>>, path_csvs array<string>"


def objects(n, seed):
    rng = random.Random(seed)
    texts = ["", "}", "{", '"', "\\", '\\"', "]}[{", 'a"}b', "line\nbreak", "\\\\}", "é{", "x" * 400]
    return [
        {"id": i, "text": rng.choice(texts), "more": [{"k": rng.choice(texts), "v": "{}"} for _ in range(rng.randrange(3))], "path_csvs": [rng.choice(texts)]}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 0, 3])
def test_one_json_list_over_many_tasks(spark, tmp_path, small_splits, indent):
    rows = objects(200, 9)
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=indent != 0))
    assert splits.json_objects(spark, str(tmp_path)).select("file_start").distinct().count() > 20
    got = stores.read_examples(spark, str(tmp_path), schema=SCHEMA).collect()
    assert sorted((r.asDict(recursive=True) for r in got), key=lambda r: r["id"]) == rows


def test_json_of_other_shapes(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in objects(20, 1)))
    (tmp_path / "one.json").write_text(json.dumps({"id": 500, "text": "alone", "more": [], "path_csvs": []}, indent=2))
    for name, text in (("none.json", "[]"), ("blank.json", " \n"), ("empty.json", "")):
        (tmp_path / name).write_text(text)
    got = stores.read_examples(spark, str(tmp_path), schema=SCHEMA)
    assert sorted(r.id for r in got.collect()) == [*range(20), 500]


def test_tables_are_written_side_by_side(spark, tmp_path):
    frames = {("db", f"t{i}"): spark.range(i).select(F.col("id").alias("k")) for i in range(12)}
    tables.extract_tables(frames, str(tmp_path))
    assert [spark.read.option("header", True).csv(f"{tmp_path}/db/t{i}").count() if i else 0 for i in range(12)] == list(range(12))
