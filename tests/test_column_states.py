"""Merged states of columns against plain loops over all cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import column_states as cs
from cellweft.operators import profile

CELLS = "table_id string, row_id bigint, col_idx int, value string"
COLUMNS = "table_id string, col_idx int, col_name string, dtype string"
KINDS = [
    lambda r: str(r.randrange(50)),
    lambda r: str(r.randrange(-(10**18), 10**18)),
    lambda r: f"{r.randrange(900) / 100:.2f}",
    lambda r: r.choice(["", "x", "X", " 1", "1", "01", "+1", "-0", "0", "ä", "日本"]),
    lambda r: r.choice([None, "a"]),
    lambda r: "same",
    lambda r: r.choice(["9223372036854775807", "9223372036854775808", "-9223372036854775808"]),
]


def drawn(seed, n_rows):
    rng = random.Random(seed)
    cells = [(f"t{i % 3}", rng.randrange(n_rows) if i % 2 else r, k, KINDS[k](rng)) for i in range(6) for r in range(n_rows) for k in range(len(KINDS))]
    cells += [("keys", r, 0, str(r * 7)) for r in range(n_rows)] + [("keys", r, 1, f"k{r}") for r in range(n_rows)]
    rng.shuffle(cells)
    return cells


def expected(cells, first):
    out = {}
    for name in {(t, c) for t, _, c, _ in cells}:
        own = [(r, v) for t, r, c, v in cells if (t, c) == name]
        values = [v for _, v in own if v is not None]
        least = {}
        for r, v in own:
            if v is not None:
                least[v] = min(r, least.get(v, r))
        firsts = [v for _, v in sorted((r, v) for v, r in least.items())][:first]
        out[name] = (len(own), len(own) - len(values), len(set(values)), len(set(values)) < len(own), firsts)
    return out


@pytest.mark.parametrize("held", [5, 1 << 21])
def test_states_equal_plain_loops(spark, monkeypatch, held):
    monkeypatch.setattr(cs, "HELD_KEYS", held)
    cells = drawn(1, 120)
    frame = spark.createDataFrame(cells, CELLS).repartition(6)
    want = expected(cells, 4)
    got = {(r.table_id, r.col_idx): r for r in cs.column_states(frame, 4).collect()}
    assert {k: (r.n_rows, r.n_nulls, r.n_distinct, [x["value"] for x in r.firsts]) for k, r in got.items()} == {k: (*w[:3], w[4]) for k, w in want.items()}
    told = {(r.table_id, r.col_idx): r.repeated for r in cs.column_states(frame, keys="unrepeated").collect()}
    assert told == {k: w[3] for k, w in want.items()}
    only = {(r.table_id, r.col_idx): [x["value"] for x in r.firsts] for r in cs.column_states(frame, 2, keys=None).collect()}
    assert only == {k: w[4][:2] for k, w in want.items()}


def test_flushes_of_one_task_change_nothing():
    import pyarrow as pa

    rng = random.Random(3)
    cells = [("t", rng.randrange(60), c, str(rng.randrange(40)) if c else rng.choice(["p", "q"])) for _ in range(400) for c in range(2)]
    rows = [(t, c, r, v, int(v) if v.isdigit() else ord(v), 0 if v.isdigit() else 1) for t, r, c, v in cells]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["table_id", "col_idx", "row_id", "value", "k1", "k2"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 70], strict=True), types, strict=True)], names) for i in range(0, len(rows), 70)]
    for limit in (1, 30, 1 << 21):
        old, cs.HELD_KEYS = cs.HELD_KEYS, limit
        try:
            states = list(cs._states(3, "all", 4)(batches))
        finally:
            cs.HELD_KEYS = old
        every = pa.Table.from_batches(states).sort_by([("table_id", "ascending"), ("col_idx", "ascending"), ("part", "ascending")])
        merged = {}
        for b in cs._merged(3)(every.to_batches()):
            for r in b.to_pylist():
                held = merged.setdefault(r["col_idx"], [0, 0, []])
                held[0] += r["n_rows"]
                held[1] += r["n_distinct"]
                held[2] += [x["value"] for x in r["firsts"] or ()]
        assert {c: tuple(v) for c, v in merged.items()} == {c: (w[0], w[2], w[4]) for (_, c), w in expected(cells, 3).items()}


def test_packed_keys():
    rng = np.random.default_rng(1)
    zeros = lambda n: np.zeros(n, np.int64)
    for first in (np.arange(5000), np.arange(0, 10**6, 997), np.array([-(2**63), 0, 2**63 - 1]), np.array([-3]), np.sort(rng.integers(-(2**62), 2**62, 50))):
        first = first.astype(np.int64)
        data = cs.pack(first, zeros(len(first)))
        assert all((a == b).all() for a, b in zip(cs.unpack(data), (first, zeros(len(first))), strict=True))
    assert len(cs.pack(np.arange(65536), zeros(65536))) < 65536 // 8 + 16
    first, second = np.array([4, 4, 9]), np.array([1, 2, 0])
    assert [x.tolist() for x in cs.unpack(cs.pack(first, second))] == [[4, 4, 9], [1, 2, 0]]


def test_no_value_is_shuffled_beyond_the_first_ones(spark):
    cells = spark.range(20_000).select(F.lit("t").alias("table_id"), F.col("id").alias("row_id"), F.lit(0).alias("col_idx"), F.col("id").cast("string").alias("value")).repartition(4)
    read = cs.with_key(cells.select("table_id", "col_idx", "row_id", "value"))
    rows = read.mapInArrow(cs._states(4, "all", 8), cs.STATE).collect()
    assert max(len(r["firsts"] or ()) for r in rows) <= 4
    assert sum(len(r["keys"] or b"") for r in rows) < 20_000 * 4


def test_empty_table_and_keys_of_hash_pairs(spark):
    assert cs.column_states(spark.createDataFrame([], CELLS), 3).collect() == []
    texts = spark.createDataFrame([("12",), ("012",), ("1.0",), ("",), (None,), ("x" * 100_000,)], "value string")
    keys = [tuple(r) for r in cs.with_key(texts).select("_k1", "_k2").collect()]
    assert keys[0] == (12, 0) and len(set(keys)) == 6 and keys[4][0] is None


def test_key_search_equals_full_profiles(spark):
    cells = drawn(2, 40)
    columns = [(t, c, f"c{c}", "object") for t, c in sorted({(t, c) for t, _, c, _ in cells})] + [("none", 0, "z", "object")]
    frame, dim = spark.createDataFrame(cells, CELLS).repartition(5), spark.createDataFrame(columns, COLUMNS)
    want = {tuple(r) for r in profile.infer_primary_key(profile.profile_columns(profile.value_groups(frame), dim)).collect()}
    assert {tuple(r) for r in profile.find_primary_key(frame, dim).collect()} == want


def test_states_of_a_wide_table_equal_those_of_its_cells(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, 1, 2, -5]), rng.choice([None, "a", "", "7"]), rng.randrange(10**6), rng.random() < 0.5, rng.randrange(400) / 4, f"u{i}") for i in range(300)]
    wide = spark.createDataFrame(rows, "r bigint, a int, b string, c bigint, d boolean, e double, f string").repartition(5)
    wide = wide.withColumn("g", F.col("e").cast("decimal(12,2)")).withColumn("h", F.lit(None).cast("string"))
    values = {i: F.col(c) for i, c in enumerate("abcdefgh")}
    cells = wide.select(F.lit("t").alias("table_id"), F.col("r").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("value")) for i, v in values.items()])).alias("x")).select("table_id", "row_id", "x.*")
    for first, keys in ((3, "all"), (0, "all"), (2, None), (0, "unrepeated"), (2, "unrepeated")):
        got = cs.merged_states(cs.table_states(wide, "t", F.col("r"), values, first, keys), first).drop("n_nulls", *(["n_distinct"] if keys == "unrepeated" else []))
        want = cs.column_states(cells, first, keys).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = cs.merged_states(cs.table_states(wide, "t", F.col("r"), values, 0, "all")).collect()
    assert {r.col_idx: r.n_nulls for r in whole} == {r.col_idx: r.n_nulls for r in cs.column_states(cells).collect()}
