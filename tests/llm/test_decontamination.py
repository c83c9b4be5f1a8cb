"""Decontamination against all windows that share a shingle."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cellweft.llm import decontamination


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items):
    out = {}
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in items:
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            own = bag(v, k)
            at = {}
            for t in range(len(v) - k + 1):
                at.setdefault(tuple(v[t : t + k]), []).append(t)
            starts = {p - t for p in range(len(w) - k + 1) for t in at.get(tuple(w[p : p + k]), [])}
            for s in starts:
                window = bag(w[max(s, 0) : s + len(v)], k)
                both = sum((own & window).values())
                similarity = both / (sum(own.values()) + sum(window.values()) - both)
                if similarity >= 0.8:
                    old = out.get((doc_id, item_id), (0, 0))
                    out[doc_id, item_id] = max(old, (similarity, -max(s, 0)))
    return sorted(((*k, round(v[0], 9), -v[1]) for k, v in out.items()), key=str)


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, m int, item_id string")
    return docs, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def samples():
    rng = random.Random(2)
    vocabulary = [f"Wört{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([12, 20, 20, 40, 60])))) for i in range(12)]
    items += [(100, "two words"), (101, "two words"), (102, ""), (103, None), (104, "a a a a a a a a"), (None, "one lonely item without an id at all"), (105, "!!")]
    rows = []
    for n in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        if rng.random() < 0.5:
            leak = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if len(leak) > 8:
                    leak[rng.randint(0, len(leak) - 1)] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w[at:at] = leak
        rows.append((n, ", ".join(w)))
    rows += [(500, None), (501, ""), (502, "a " * 500), (503, items[0][1]), (503, items[0][1]), (503, "other"), (None, items[1][1].upper()), (504, items[2][1] + " " + items[2][1])]
    return rows, items


def test_against_all_windows(spark):
    rows, items = samples()
    got = decontamination.leaks(*frames(spark, rows, items)).collect()
    assert sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in got), key=str) == brute(rows, items)


def test_clean_documents(spark):
    rows, items = samples()
    docs, benchmark = frames(spark, rows, items)
    kept = decontamination.clean_documents(docs, benchmark)
    want = [(i, t) for i, t in rows if not brute([(i, t)], items)]
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert decontamination.leaks(docs.filter("false"), benchmark).collect() == []
    assert decontamination.leaks(docs, benchmark.filter("false")).collect() == []


def test_fingerprints_of_very_long_lists(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    lists = [rng.integers(-(2**63), 2**63 - 1, n).tolist() for n in (0, 1, 6, 7, 8, 50)] + [[-1] * 40 + [0] * 39, [0] * 40 + [-1] * 39]
    monkeypatch.setattr(decontamination, "PART", 7)
    frame = spark.createDataFrame(list(enumerate(lists)), "k int, h array<long>")
    got = {r.k: r.f for r in frame.select("k", decontamination.bits_of(decontamination.fingerprint(F.col("h"))).alias("f")).collect()}
    for k, own in enumerate(lists):
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in own) * 2 > len(own))
        assert got[k] % 2**64 == want
    monkeypatch.undo()
    many = spark.range(1).select(F.concat(F.array_repeat(F.lit(-1).cast("long"), 70_001), F.array_repeat(F.lit(0).cast("long"), 70_000)).alias("h"))
    assert many.select(decontamination.bits_of(decontamination.fingerprint(F.col("h"))).alias("f")).first().f == -1
