"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact weighted shingles.

A window has as many words as a benchmark item.  Windows are laid wherever a document shares a shingle with an
item of that size (a pair above the threshold shares many).  Each gets a 64-bit SimHash, and a fingerprint is
looked up by its eight bytes: two fingerprints within RADIUS differ in at most RADIUS // 8 bits of some
byte, so that all of them are found.  What is found is compared by its shingles, weighted by how often they
occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import stored
from cellweft.operators.joins import is_small

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of a pair at the threshold differ in about 10 of 64 bits, with a deviation of 3.
RADIUS = 20
BLOCKS = 8
#: Shingles that a lane of a fingerprint counts; the top one must not reach the sign.
PART = (1 << 15) - 1
#: Item tables of more rows than this are joined without a broadcast; a row has four numbers.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if more than half of the hashes, counted as often as they occur, have it.

    Sixteen sums of four 16-bit lanes count all 64 bits of up to PART shingles; longer lists are counted part by part.
    """
    lanes = F.lit(0x0001000100010001)
    names = [f"s{k}" for k in range(16)]
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))

    def counted(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, h: F.struct(*((acc[n] + F.shiftrightunsigned(h, k).bitwiseAND(lanes)).alias(n) for k, n in enumerate(names))))

    last = F.floor((F.greatest(F.size(hashes), F.lit(1)) - 1) / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: counted(F.slice(hashes, i * PART + 1, PART)))
    return F.struct(parts.alias("parts"), F.size(hashes).alias("n"))


def bits_of(f: Column) -> Column:
    def count(k: int, lane: int) -> Column:
        own = lambda p: F.shiftrightunsigned(p[f"s{k}"], 16 * lane).bitwiseAND(F.lit(0xFFFF))
        return F.aggregate(f["parts"], F.lit(0).cast("long"), lambda n, p: n + own(p))

    out = F.lit(0).cast("long")
    for k in range(16):
        for lane in range(4):
            out = out.bitwiseOR(F.when(count(k, lane) * 2 > f["n"], F.shiftleft(F.lit(1).cast("long"), 16 * lane + k)).otherwise(F.lit(0).cast("long")))
    return out


def block_of(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * block).bitwiseAND(F.lit(255))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger, for two lists of shingles."""

    def times(x: Column, hashes: Column) -> Column:
        return F.size(F.filter(hashes, lambda y: y == x))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(x, a), times(x, b)))
    return both / (F.size(a) + F.size(b) - both)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, m (words), k (words per shingle) and shingles of the items that have words; equal rows once."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).distinct()
    items = items.withColumn("m", F.size("w")).withColumn("k", F.least(F.col("m"), F.lit(WORDS))).filter("m > 0")
    own = F.lit(None).cast("array<long>")
    for k in range(1, WORDS + 1):
        own = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(own)
    return items.select("item_id", "m", "k", own.alias("shingles"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, own, item_id, similarity, first_word: each document with each item that it holds, at its best place.

    A text or item without words holds nothing and is never held; an item of fewer than five words is one
    shingle and must be met whole.  Windows end at the ends of a document.  Equal similarities go to the
    first place.  Rows that repeat a doc_id and text give one row per item.  Long texts are taken whole; an empty table on
    either side gives no rows; other columns are not read.
    """
    items = stored(item_table(benchmark), "items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]
    at_items = items.select("k", "m", F.posexplode("shingles").alias("at", "h")).groupBy("h", "m", "k", "at").agg(F.lit(1).alias("one")).drop("one")
    n_at = at_items.count()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("own"), words(F.col("text")).alias("w"))
    starts = None
    for k in sizes:
        grams = keyed.select("doc_id", "own", F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        met = grams.join(_sized(at_items.filter(F.col("k") == k), n_at), "h").select("doc_id", "own", "k", "m", (F.col("pos") - F.col("at")).alias("start"))
        starts = met if starts is None else starts.unionByName(met)
    if starts is None:
        return keyed.select("doc_id", "own", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word")).filter("false")
    places = starts.distinct().groupBy("doc_id", "own").agg(F.collect_list(F.struct("k", "m", "start")).alias("places"))
    places = stored(places, "places").withColumnsRenamed({"doc_id": "d", "own": "o"})
    source = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    both = source.join(places, source["doc_id"].eqNullSafe(places["d"]) & (source["own"] == places["o"]))
    held = both.select("doc_id", "own", words(F.col("text")).alias("w"), "places").dropDuplicates(["doc_id", "own"])

    def window(p: Column) -> Column:
        first = F.greatest(p["start"], F.lit(0))
        return F.struct(p["k"].alias("k"), p["m"].alias("m"), first.cast("long").alias("first_word"), F.slice("w", first + 1, p["start"] + p["m"] - first).alias("own_words"))

    windows = held.select("doc_id", "own", F.explode(F.transform("places", window)).alias("x")).select("doc_id", "own", "x.*")
    own = F.lit(None).cast("array<long>")
    for k in sizes:
        own = F.when(F.col("k") == k, shingles(F.col("own_words"), k)).otherwise(own)
    windows = windows.select("doc_id", "own", "m", "first_word", own.alias("shingles"))
    windows = stored(windows.withColumn("f", fingerprint(F.col("shingles"))), "windows").withColumn("fp", bits_of(F.col("f"))).drop("f")
    known = stored(items.withColumn("f", fingerprint(F.col("shingles"))), "known").select("item_id", F.col("m"), F.col("shingles").alias("item_shingles"), bits_of(F.col("f")).alias("item_fp"))
    near = [x for x in range(256) if x.bit_count() <= RADIUS // BLOCKS]
    spread = F.array(*(F.struct(F.lit(b).alias("block"), block_of(F.col("item_fp"), b).alias("v")) for b in range(BLOCKS)))
    index = known.select("*", F.explode(spread).alias("x")).select("*", F.explode(F.array(*map(F.lit, near))).alias("mask"))
    index = index.select("item_id", "m", "item_fp", F.col("x.block").alias("block"), F.col("x.v").bitwiseXOR(F.col("mask").cast("long")).alias("v"))
    index = stored(index, "index")
    probe = F.array(*(F.struct(F.lit(b).alias("block"), block_of(F.col("fp"), b).alias("v")) for b in range(BLOCKS)))
    probes = windows.select("doc_id", "own", "m", "first_word", "fp", F.explode(probe).alias("x")).select("doc_id", "own", "m", "first_word", "fp", "x.*")
    found = probes.join(_sized(index, index.count()), ["m", "block", "v"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.least(*(F.when(F.bit_count(block_of(apart, b)) <= RADIUS // BLOCKS, b).otherwise(BLOCKS) for b in range(BLOCKS)))
    # a pair that several blocks find is taken from the first
    found = found.filter((F.bit_count(apart) <= RADIUS) & (F.col("block") == first)).select("doc_id", "own", "m", "first_word", "item_id", "item_fp")
    a, b = windows.drop("fp").withColumnsRenamed({"doc_id": "d", "own": "o", "m": "wm", "first_word": "wf"}), known.withColumnsRenamed({"item_id": "i", "m": "im", "item_fp": "ifp"})
    pairs = found.join(a, found["doc_id"].eqNullSafe(a["d"]) & (found["own"] == a["o"]) & (found["m"] == a["wm"]) & (found["first_word"] == a["wf"]))
    pairs = pairs.join(F.broadcast(b) if is_small(b, BROADCAST_ROWS) else b, pairs["item_id"].eqNullSafe(b["i"]) & (pairs["m"] == b["im"]) & (pairs["item_fp"] == b["ifp"]))
    sure = pairs.withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("item_shingles"))).filter(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back")))
    return sure.groupBy("doc_id", "own", "item_id").agg(best.alias("best")).select(
        "doc_id", "own", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("doc_id__"), F.col("own").alias("own__")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id__"]) & (F.xxhash64(docs["text"]) == bad["own__"]), "left_anti")
