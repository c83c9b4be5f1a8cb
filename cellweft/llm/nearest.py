"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is kept as the signs of its rotated residual from the nearest of a few centroids, with two correction
scalars.  Inner products are estimated from packed bits and a query in four bit planes; the estimate has a
known deviation, so a candidate is ranked again with its real vector only if its upper bound reaches what the
best lower bounds promise.  All queries meet all vectors, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import grouped, stored

NEIGHBOURS = 20
EVERY = 20
#: Bits per dimension of the vectors, before rounding up to words.
BITS_PER_DIMENSION = 2
CENTROIDS = 16
#: Rows that the centroids are fitted on, those with the smallest seeded hash.
SAMPLE = 4096
#: Deviations that a bound allows.
DEVIATIONS = 2.5
PLANES = 4
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Queries whose estimates are held at a time.
QUERY_ROWS = 256


class Index:
    """Centroids and rotation for vectors of one length."""

    def __init__(self, sample: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.bits = -(-self.dim * BITS_PER_DIMENSION // 64) * 64
        q, r = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))
        self.rotation = (q * np.sign(np.diag(r)))[:, : self.dim]
        centres = sample[rng.permutation(len(sample))[:CENTROIDS]].copy()
        for _ in range(8):
            own = self.nearest(sample, centres)
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = sample[own == c].mean(axis=0)
        self.centres = centres

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, residual length, cosine between residual and its code, packed signs."""
        own = self.nearest(x, self.centres)
        rest = x - self.centres[own]
        length = np.sqrt((rest * rest).sum(1))
        turned = rest @ self.rotation.T / np.maximum(length, 1e-300)[:, None]
        factor = np.abs(turned).sum(1) / np.sqrt(self.bits)
        return own, length, np.maximum(factor, 1e-6), np.packbits(turned > 0, axis=1)

    def estimates(self, queries: np.ndarray, centre: int, length: np.ndarray, factor: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products of residuals, what they may be off), queries by codes of one centroid."""
        rest = queries - self.centres[centre]
        size = np.sqrt((rest * rest).sum(1))
        turned = rest @ self.rotation.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        met = np.zeros((len(queries), len(codes)), np.int64)
        for plane in range(PLANES):
            bits = np.packbits(level >> plane & 1, axis=1).view(np.uint64)
            for word in range(codes.shape[1]):
                met += np.bitwise_count(bits[:, word][:, None] & codes[:, word][None, :]).astype(np.int64) << plane
        of_ones = step[:, None] * met + low[:, None] * ones
        along = (2 * of_ones - turned.sum(axis=1)[:, None]) / np.sqrt(self.bits)
        bound = DEVIATIONS * np.sqrt(np.maximum(1 - factor * factor, 0)) / factor / np.sqrt(self.bits - 1)
        # rounding to levels adds at most half a level per bit, in a random direction
        rounding = DEVIATIONS * step / 2 / factor.min()
        return along / factor * length, size[:, None] * (bound * length) + rounding[:, None] * length


def valid(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """vec_id and v, the vectors that take part: of the most frequent length, finite, without nulls, not zero."""
    v = F.col(vector).cast("array<double>")
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = fine.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    most = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (fine.filter(F.size("v") == most["d"]), most["d"]) if most else (fine, 0)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _encoded(index: Index):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), index.dim)
            own, length, factor, codes = index.encode(x)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.astype(np.int32)), pa.array(length), pa.array(factor), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "centre", "length", "factor", "code", "raw"],
            )

    return run


def block_best(index: Index, query_ids, queries, vec_ids, vectors, centre, length, factor, codes, k: int):
    """(query_id, vec_id, score) of the k best of a block for each query that has any."""
    out_q, out_v, out_s = [], [], []
    groups = [(c, np.flatnonzero(centre == c)) for c in np.unique(centre).tolist()]
    dots = vectors @ index.centres.T
    squares = (index.centres * index.centres).sum(1)
    for at in range(0, len(queries), QUERY_ROWS):
        q, ids = queries[at : at + QUERY_ROWS], query_ids[at : at + QUERY_ROWS]
        low, high = np.empty((len(q), len(vec_ids))), np.empty((len(q), len(vec_ids)))
        for c, own in groups:
            estimate, off = index.estimates(q, c, length[own], factor[own], codes[own])
            estimate += dots[own, c][None, :] + (q @ index.centres[c] - squares[c])[:, None]
            low[:, own], high[:, own] = estimate - off, estimate + off
        itself = ids[:, None] == vec_ids[None, :]
        low[itself], high[itself] = -np.inf, -np.inf
        n = min(k, low.shape[1])
        promised = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        for i in range(len(q)):
            near = np.flatnonzero((high[i] >= promised[i]) & ~itself[i])
            score = (vectors[near] * q[i]).sum(axis=1)
            best = np.lexsort((vec_ids[near], -score))[:k]
            out_q.append(np.full(len(best), ids[i]))
            out_v.append(vec_ids[near[best]])
            out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _best(index: Index, k: int):
    def run(batches):
        for rows in grouped(batches, 2):
            queries, data = [r for r in rows if r[2]], [r for r in rows if not r[2]]
            if not queries or not data:
                continue
            words = index.bits // 64
            codes = np.frombuffer(b"".join(r[7] for r in data), np.uint64).reshape(-1, words)
            raw = [np.frombuffer(b"".join(r[8] for r in part), np.float64).reshape(-1, index.dim) for part in (queries, data)]
            found = block_best(
                index, np.array([r[3] for r in queries]), raw[0], np.array([r[3] for r in data]), raw[1],
                *(np.array([r[c] for r in data]) for c in (4, 5, 6)), codes, k,
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, vector: str = "embedding", k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a row whose vec_id every divides.

    Scores are inner products in double precision of the vectors as given; equal scores go by vec_id.  Rows
    with the query's vec_id are no candidates.  Vectors that are null, zero or of another length than most, or that
    hold null or non-finite components, take no part, nor does a null vec_id.  Of rows that share a query's vec_id
    one asks; as candidates they all count.  An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    fine, dim = valid(rows, vector)
    if not dim:
        return spark.createDataFrame([], schema)
    fitted = fine.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", F.xxhash64("v")).limit(SAMPLE).toArrow()
    index = Index(_vectors(fitted.column("v").combine_chunks(), dim))
    coded = stored(fine.mapInArrow(_encoded(index), "vec_id long, centre int, length double, factor double, code binary, raw binary"), "codes")
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    columns = [c for c in coded.columns if c != "vec_id"]
    n, n_queries = coded.agg(F.count("*"), F.count_if(asked)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, others: int, is_query: bool) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id", "raw"), F.lit(own_blocks)).cast("int")).withColumn("query", F.lit(is_query))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return df.select("block", "query_block", "query", "vec_id", "centre", "length", "factor", "code", "raw")

    queries = coded.filter(asked).groupBy("vec_id").agg(F.min(F.struct("raw", *(c for c in columns if c != "raw"))).alias("x"))
    queries = queries.select("vec_id", *(f"x.{c}" for c in columns))
    both = dealt(coded, "block", blocks, "query_block", query_blocks, False).unionByName(
        dealt(queries, "query_block", query_blocks, "block", blocks, True)
    )
    both = both.repartition("block", "query_block").sortWithinPartitions("block", "query_block", "query", "vec_id")
    found = both.mapInArrow(_best(index, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
