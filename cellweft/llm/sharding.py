"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots.  Bytes are added up per slot, and a table
(version, vslot, shard) says where each slot lives.  Rebalancing edits that table: a new version moves
some slots, and records never change their slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.llm.common import stored
from cellweft.session import work_folder

SLOTS = 4096
#: A record counts this much besides its text.
RECORD_BYTES = 16
#: Rows of a cell, the part of a slot that one task numbers.
CELL_ROWS = 50_000


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each record.

    Null text: 16 bytes, checksum of nothing.  Equal rows share a slot; a doc_id that repeats with different
    texts, null among them, is spread by the checksum.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sized.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes per slot: as many numbers as there are slots, however many records."""
    return {r["vslot"]: r["b"] for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: the largest slot first, each to the lightest shard; empty slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for vslot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
        if sizes.get(vslot, 0):
            load, shard = heapq.heappop(heap)
            heapq.heappush(heap, (load + sizes[vslot], shard))
        else:
            shard = vslot % shards
        out[vslot] = shard
    return out


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The map edited for another number of shards.

    Slots of shards that no longer exist go to the lightest ones.  Then the heaviest shard gives the lightest
    its largest slot that narrows their gap, until the gap is slack times the mean or no slot narrows it.  All
    other slots stay.
    """
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    homeless = []
    for vslot, shard in current.items():
        if shard < shards:
            load[shard] += sizes.get(vslot, 0)
            held[shard].add(vslot)
        else:
            homeless.append(vslot)

    def put(vslot: int, shard: int) -> None:
        held[shard].add(vslot)
        load[shard] += sizes.get(vslot, 0)

    for vslot in sorted(homeless, key=lambda v: (-sizes.get(v, 0), v)):
        put(vslot, min(load, key=lambda s: (load[s], s)))
    while True:
        heavy, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fits = [v for v in held[heavy] if 0 < 2 * sizes.get(v, 0) <= gap]
        if not fits or gap * shards <= slack * sum(load.values()):
            break
        vslot = max(fits, key=lambda v: (sizes[v], -v))
        held[heavy].remove(vslot)
        load[heavy] -= sizes[vslot]
        put(vslot, light)
    return {v: s for s, slots in held.items() for v in slots}


def store_map(spark: SparkSession, folder: str, shard_of: dict[int, int], version: int) -> None:
    """Append a version of the map; older versions stay readable."""
    rows = [(version, v, s) for v, s in sorted(shard_of.items())]
    frame = spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1)
    frame.write.mode("append").partitionBy("version").parquet(f"{folder}/map")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest if none is named."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(f"{folder}/map")
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version)


def place(records: DataFrame, shard_map: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add shard, map_version and slot, the place of a record in its shard, from 0 without gaps.

    A shard is numbered cell by cell (a slot, or a part of one where slots hold more than cell_rows), so no
    task sorts a whole shard.  Rows that are equal in every column take neighbouring places in any order.
    """
    n = records.count()
    parts = max(1, -(-n // (SLOTS * cell_rows)))
    celled = records.withColumn("part", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(parts)).cast("int"))
    cells = celled.groupBy("vslot", "part").agg(F.count("*").alias("n"))
    cells = cells.join(F.broadcast(shard_map.withColumnRenamed("version", "map_version")), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = celled.withColumn("nth", F.row_number().over(within).cast("long") - 1)
    return numbered.join(cells, ["vslot", "part"]).withColumn("slot", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard; the map goes to the shared folder as version 1.

    Sizes per shard are near equal: a shard is off the mean by less than its smallest slots weigh, where
    slots are many.  Null text counts as empty; an empty table gives no rows and a map of empty slots.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    records = stored(slotted(docs, slots), "records")
    store_map(spark, folder, first_map(slot_bytes(records), shards, slots), 1)
    return place(records, read_map(spark, folder))


def write_shards(placed: DataFrame, docs: DataFrame, path: str) -> None:
    """Write the records with their documents, a folder for each shard, in place order within a file."""
    keys = ["doc_id", "text_crc32"]
    texts = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # equal rows are interchangeable: number both sides
    nth = Window.partitionBy(*keys).orderBy("doc_id")
    placed = placed.withColumn("nth", F.row_number().over(nth))
    texts = texts.withColumn("nth", F.row_number().over(nth)).withColumnsRenamed({"doc_id": "d", "text_crc32": "c", "nth": "n"})
    same = placed["doc_id"].eqNullSafe(texts["d"]) & (placed["text_crc32"] == texts["c"]) & (placed["nth"] == texts["n"])
    out = placed.join(texts, same)
    (
        out.select("shard", "slot", "vslot", "doc_id", "text")
        .repartition("shard", "vslot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
