"""Virtual slots: numbering, balance, rebalancing and written shards."""

import random
import zlib

from cellweft.llm import sharding
from cellweft.session import work_folder


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot int")


def test_every_record_has_a_place(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(1500)] + [(5, None), (5, None), (None, "x"), (None, None), (9, ""), (9, "")]
    for cell_rows in (50_000, 1):
        monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
        records = sharding.slotted(frame(spark, rows), 64)
        shard_of = sharding.first_map(sharding.slot_bytes(records), 7, 64)
        folder = work_folder(spark)
        sharding.store_map(spark, folder, shard_of, 1)
        placed = sharding.place(records, sharding.read_map(spark, folder), cell_rows).collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in placed), key=str) == sorted(
            ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str
        )
        for shard in range(7):
            assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))
    assert sharding.shard_documents(frame(spark, []), 40).collect() == []


def test_balance_and_rebalance():
    rng = random.Random(2)
    sizes = {v: rng.randint(1, 1000) for v in range(sharding.SLOTS) if v % 10}
    old = sharding.first_map(sizes, 40)

    def loads(m, n):
        return [sum(sizes.get(v, 0) for v, s in m.items() if s == k) for k in range(n)]

    assert max(loads(old, 40)) - min(loads(old, 40)) <= 1000
    new = sharding.rebalance(old, sizes, 41)
    assert set(new) == set(old) and max(loads(new, 41)) - min(loads(new, 41)) <= 1000
    moved = [v for v in old if old[v] != new[v]]
    assert sum(new[v] == 40 for v in moved) > 0.7 * len(moved) and len(moved) < 0.05 * len(old)
    fewer = sharding.rebalance(old, sizes, 39)
    assert set(fewer.values()) <= set(range(39)) and max(loads(fewer, 39)) - min(loads(fewer, 39)) <= 1000


def test_versions_and_written_shards(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(60)] + [(3, "text 3" * 3)] * 2 + [(None, None)]
    docs, folder = frame(spark, rows), work_folder(spark)
    records = sharding.slotted(docs)
    sizes = sharding.slot_bytes(records)
    first = sharding.first_map(sizes, 3)
    sharding.store_map(spark, folder, first, 1)
    sharding.store_map(spark, folder, sharding.rebalance(first, sizes, 4), 2)
    assert {r["version"] for r in sharding.read_map(spark, folder).collect()} == {2}
    assert {r["vslot"]: r["shard"] for r in sharding.read_map(spark, folder, 1).collect()} == first
    placed = sharding.place(records, sharding.read_map(spark, folder, 1))
    sharding.write_shards(placed, docs, f"{folder}/shards")
    out = spark.read.parquet(f"{folder}/shards").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(rows, key=str)
    assert len({(r["shard"], r["slot"]) for r in out}) == len(rows)
