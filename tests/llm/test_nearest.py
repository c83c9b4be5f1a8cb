"""One-bit codes against exact search."""

import numpy as np
import pytest

from cellweft.llm import nearest


def brute(rows, k=20, every=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    lengths = [len(v) for _, v in rows]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), -d)) if rows else 0
    rows = [(i, v) for i, v in rows if len(v) == dim]
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted(((-float((v * x).sum()), i) for i, v in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def search(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    out = {}
    for r in sorted(nearest.search(frame, **kw).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 64))
    rows = [(i, (centres[i % 10] + spread * rng.normal(size=64)).tolist()) for i in range(1500)]
    want, got = brute(rows), search(spark, rows)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        exact = dict(rows)
        assert all(s == pytest.approx(float(np.dot(exact[v], exact[q])), rel=1e-12) for _, v, s in found)


def test_embeddings_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), search(spark, rows)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))


def test_edge_rows(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(0, one), (20, one), (20, one), (1, one), (2, [0.0] * 3), (3, None), (4, [1.0, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (None, one), (7, [1.0]), (8, []), (-40, [-1.0, 0.0, 0.0])]
    got = {q: [(v, s) for _, v, s in found] for q, found in search(spark, rows).items()}
    assert got == brute(rows)
    assert search(spark, []) == {} and search(spark, [(0, one)]) == {}
