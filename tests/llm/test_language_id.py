"""Gradients, held-out accuracy and edge cases of language identification."""

import numpy as np
import pytest

from cellweft.llm import language_id

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    net = language_id.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, (6, 5)).astype(np.int16)
    data[4:, 2] = language_id.PAD
    target = np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(data, target)
    for name in net.p:
        for at in [(0, 0), (1, 0)] if name == "bias" else [(0, 1), (2, 3)] if name.startswith(("out", "re")) else [(0, 97), (9, 98), (17, 99)]:
            before, eps = net.p[name][at], 1e-2
            net.p[name][at] = before + eps
            up, _ = net.gradients(data, target)
            net.p[name][at] = before - eps
            down, _ = net.gradients(data, target)
            net.p[name][at] = before
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_pooling_is_the_mean_over_all_positions(monkeypatch):
    net = language_id.Network(["a", "b"])
    texts = [b"x" * 200, b"", b"hello world"]
    whole = language_id._pooled(texts, net)
    monkeypatch.setattr(language_id, "WIDE", 1)
    assert np.allclose(whole, language_id._pooled(texts, net), atol=1e-6)
    p = net.probabilities(language_id.windows(texts[2]).T)[: len(texts[2]), :, 0]
    assert np.allclose(whole[2], p.mean(axis=0), atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = docs.filter(language_id.held_out()).select("doc_id").toPandas()["doc_id"]
    out = got[got["doc_id"].isin(held)]
    assert len(got) == docs.count() and len(out) > 100
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_edge_rows(spark):
    rows = [(1, "the and of with " * 20, "en"), (2, None, "en"), (3, "123 !!", None), (4, "", "fr"), (None, "der und die das " * 20, "de"), (1, "the", "en"), (1, "the", "en")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id.identify(frame).collect()
    assert len(got) == 7 and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, None)} <= {"en", "de"}
    assert language_id.identify(frame.filter("false")).collect() == []
    assert language_id.identify(frame.withColumn("lang", frame["lang"].substr(9, 1)).filter("doc_id = 2")).first()["lang_pred"] == "und"
    assert {r["doc_id"] for r in language_id.keep_known(frame, 0.4).collect()} <= {1, None}


def test_rows_pass_through_in_slices(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    whole = sorted(map(tuple, language_id.keep_known(docs, 0.3).collect()))
    monkeypatch.setattr(language_id, "ROWS_AT_ONCE", 7)
    assert sorted(map(tuple, language_id.keep_known(docs, 0.3).collect())) == whole
    told = {(r.doc_id, r.own) for r in language_id.identify(docs).filter("lang_pred <> 'und' AND score >= 0.3").collect()}
    known = language_id.keep_known(docs, 0.3).selectExpr("doc_id", "xxhash64(text) AS own").collect()
    assert {(r.doc_id, r.own) for r in known} == told
