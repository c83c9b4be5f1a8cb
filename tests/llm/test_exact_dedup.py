import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cellweft.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def expected(rows):
    sums = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    out = []
    for (doc_id, _), s in zip(rows, sums, strict=True):
        ids = [d for (d, _), x in zip(rows, sums, strict=True) if x == s]
        known = [d for d in ids if d is not None]
        out.append((doc_id, min(known) if known else None, len(ids), s))
    return sorted(out, key=repr)


def check(spark, rows, counters):
    got = exact_dedup.groups(spark.createDataFrame(rows, SCHEMA).repartition(5), counters).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == {s: 1 for *_, s in expected(rows)}
    assert all(r.doc_id == r.keep_id for r in kept)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a \x0b\x0c\r\nb"), (4, "a b"), (None, "a b"), (7, None), (8, ""), (6, " "), (10, "   "),
    (11, "x"), (11, "x"), (None, "only"), (None, "only"), (12, "long " * 50_000), (13, "long  " * 50_000), (14, "a b "),
]


def test_groups_whichever_texts_are_frequent(spark):
    for counters in (1, 3, 4096):
        check(spark, ROWS, counters)


def test_a_text_of_a_third_of_all_rows(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i // 2 if i % 5 == 0 else i}") for i in range(600)]
    check(spark, rows, 4)


def test_frequent_texts_are_shuffled_nowhere(spark):
    rows = spark.createDataFrame([(i, "copy" if i % 2 else str(i)) for i in range(400)], SCHEMA).repartition(7)
    keyed = exact_dedup._keyed(rows)
    found = [bytes(r.digest) for r in exact_dedup.frequent(keyed.select("digest"), 2).collect()]
    assert hashlib.sha256(b"copy").digest() in found and len(found) <= 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=30), max_size=8), st.integers(1, 5))
def test_merged_summaries_hold_all_frequent_digests(parts, counters):
    held: dict = {}
    for part in parts:
        own = exact_dedup.reduced(dict(Counter(part)), counters)
        held = exact_dedup.reduced({k: held.get(k, 0) + own.get(k, 0) for k in {*held, *own}}, counters)
    every = [x for part in parts for x in part]
    assert len(held) <= counters
    for value, n in Counter(every).items():
        if n * (counters + 1) > len(every):
            assert value in held


def test_keep_first_returns_whole_rows(spark):
    docs = spark.createDataFrame([(2, "a", 1.0, "p"), (1, " a", 2.0, "q"), (1, "a", 3.0, "r"), (3, None, 4.0, "s")], "doc_id long, text string, place double, digest string")
    docs = docs.unionByName(docs.where("doc_id = 2"))
    got = exact_dedup.keep_first(docs, 1)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, " a", 2.0, "q"), (1, "a", 3.0, "r"), (3, None, 4.0, "s")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(empty).collect() == [] and exact_dedup.keep_first(empty).collect() == []
