"""Exact dedup with a heavy-hitter split.

Texts are equal when their normalised forms have the same SHA-256.  A Misra-Gries summary of the digests,
merged from task to task, holds every digest that stands for more than 1 / (COUNTERS + 1) of all rows.  Its
candidates are counted exactly; the winners, at most COUNTERS rows of a fixed width, are broadcast, and their
copies are decided where they lie.  No other digest has enough rows to matter to a task, so the rest is
shuffled by digest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import stored

#: Fixed value: runs that count as one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Digests that a summary holds.
COUNTERS = 4096
#: Summaries that one task merges.
FAN_IN = 32


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def reduced(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """At most so many counters: the largest count beyond them is taken off all, and what is left above zero stays."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {k: n - off for k, n in counts.items() if n > off}


def _summary(counters: int):
    """digest, n: the summary of a task's rows of (digest, n)."""

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("digest").aggregate([("n", "sum")])
            for digest, n in zip(sums["digest"].to_pylist(), sums["n_sum"].to_pylist(), strict=True):
                held[digest] = held.get(digest, 0) + n
            held = reduced(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, n: at most `counters` rows, among them every digest with more than 1 / (counters + 1) of all rows.

    Summaries are merged FAN_IN at a time, so no task reads more than FAN_IN * counters rows.
    """
    part = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(_summary(counters), "digest binary, n long")
    tasks = digests.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        part = part.repartition(tasks).mapInArrow(_summary(counters), "digest binary, n long")
    return part


def _least() -> Column:
    """The row that stays: the smallest doc_id, null after all others, then the earliest row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))


def grouped_rows(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, doc_id, place and least, group_size of their group, from stored rows of digest, doc_id, place."""
    found = stored(frequent(keyed.select("digest"), counters).select("digest"), "candidates")
    # at most `counters` rows of 32 bytes
    exact = keyed.join(F.broadcast(found), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), _least().alias("least"))
    heavy = F.col("group_size") * (counters + 1) > keyed.count()
    winners = F.broadcast(stored(exact.where(heavy), "winners"))
    hot = keyed.join(winners, "digest")
    same = Window.partitionBy("digest")
    rest = keyed.join(winners.select("digest"), "digest", "left_anti")
    cold = rest.withColumns({"group_size": F.count("*").over(same), "least": _least().over(same)})
    return hot.unionByName(cold)


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns as `own`, with the digest and the place of the row; places are those of the written table."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    digest, place = digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("place")
    return stored(docs.select(own, digest, place), "keyed")


def groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    Null texts count as empty and are equal to empty ones.  Of rows with equal texts the one with the smallest
    doc_id stays, null after all others; of rows that share text and doc_id the first as read stays, so each
    group keeps one row.  Long texts are only hashed.  An empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = grouped_rows(_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("digest", "own.doc_id", "place"), counters)
    return rows.select(
        "doc_id",
        F.col("least.doc_id").alias("keep_id"),
        "group_size",
        (F.col("least.place") == F.col("place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents, with all their columns, that stay by the rule of groups.

    Copies of frequent texts go where they lie; of the rest only digests and places are shuffled, and the places
    of rows that go.
    """
    keyed = _keyed(docs)
    rows = grouped_rows(keyed.select("digest", F.col("own.doc_id").cast("long").alias("doc_id"), "place"), counters)
    gone = rows.where(F.col("least.place") != F.col("place")).select("place")
    return keyed.join(gone, "place", "left_anti").select("own.*")
