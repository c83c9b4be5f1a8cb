"""The pipeline's stages on planted rows, and its registration."""

import __spark_entry__ as entry
import corpus_pipeline


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]


def test_planted_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 200").withColumnRenamed("source", "src").selectExpr("*", "1 AS own", "2 AS ids")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    words = [f"word{i}" for i in range(130)]
    near = [*words[:60], "other", *words[61:]]
    passage = " ".join(f"passage{i}" for i in range(60))
    planted = [
        (9001, " ".join(words)), (9002, " ".join(words)), (9003, " ".join(near)), (9004, "before " + item + " after"), (9005, None), (9006, "12 34"),
        (9007, "first text " + passage + " its end"), (9008, "second text of another kind " + passage + " and so on, with more words of its own to tell the two apart"),
    ]
    rows = spark.createDataFrame([(i, t, None, "s", 0, 1, 2) for i, t in planted], docs.schema)
    frame, kept, texts = docs.unionByName(rows), [], {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        texts = {r["doc_id"]: r["text"] for r in frame.filter("doc_id > 9000").collect()}
    every = {i for i, _ in planted}
    assert every - kept[0] == {9005, 9006} and len(kept[0] - every) >= 195
    assert every & kept[1] == {9001, 9004, 9007, 9008}
    assert every & kept[3] == {9001, 9007, 9008}
    assert passage in texts[9007] and passage not in texts[9008] and texts[9008].startswith("second text of another kind")
    assert all(r["n_tokens"] == len(r["ids"]) // 4 > 0 for r in frame.collect())
    assert {r["n_chars"] for r in frame.filter("doc_id = 9008").collect()} == {len(texts[9008])}


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, nth__ int, own string, `group` int, `class` string, row int, n_chars long, `a.b` int"
    plain = "the quick brown fox jumps over the lazy dog and runs away from all of them "
    rows = [(1, plain, "en"), (1, plain, "en"), (2, "le renard brun saute par dessus le chien paresseux et court", "fr"), (3, "", "en"), (4, None, "fr"), (None, "no id but some words of its own", None)]
    rows += [(5, " ".join(f"long{i}" for i in range(60_000)), "en"), (6, "\u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0434\u0440\u0443\u0433\u043e\u043c \u044f\u0437\u044b\u043a\u0435", None)]
    frame = spark.createDataFrame([(*r, 7, "o", 8, "c", 9, 0, 1) for r in rows], schema)
    for name, docs in (("full", frame), ("empty", frame.filter("false")), ("null", frame.filter("text IS NULL"))):
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, docs, "/root/testdata/sf0.001")
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.filter("nth__ <> 7 OR own <> 'o' OR `group` <> 8 OR `class` <> 'c' OR row <> 9 OR `a.b` <> 1").count() == 0
            found = [r.doc_id for r in docs.select("doc_id").collect()]
            if name == "full" and k == 0:
                assert {3, 4}.isdisjoint(found) and found.count(1) == 2 and {2, 5} <= set(found)
            if name == "full" and k == 1:
                assert found.count(1) == 1 and 5 in found
        assert name == "full" or docs.count() == 0
