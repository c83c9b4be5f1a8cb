"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is one id.
Tier two merges the bytes of all other pre-tokens: a linked list of parts and a heap of mergeable pairs,
lowest rank first.  Pre-tokens are resolved once per distinct string of a batch.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm import pretokens as pt

#: Strings whose merges a task remembers; the memory starts anew when it is full.
REMEMBERED = 400_000
#: Keys per bucket of the perfect hash, on average.
BUCKET = 4


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: a base64 string and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _mixed(hashes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes ^ (seed * np.uint64(0xA0761D6478BD642F))
        x *= np.uint64(0xE7037ED1A0B428DB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of byte strings: n strings, n places, none empty.

    Keys fall into buckets; each bucket has the smallest displacement that sends its keys to free places,
    the fullest bucket first.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.bytes = np.frombuffer(b"".join(keys), np.uint8)
        self.ends = np.cumsum([0, *map(len, keys)]).astype(np.int64)
        hashes = pt.token_hashes(self.bytes, self.ends)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two vocabulary entries share a hash or are equal")
        self.m = max(1, self.n // BUCKET)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.displace = np.zeros(self.m, np.uint64)
        self.key_at = np.full(self.n, -1, np.int64)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            members = order[edges[b] : edges[b + 1]]
            seed = 0
            while True:
                at = (_mixed(hashes[members][None, :], (tries + np.uint64(seed))[:, None]) % np.uint64(self.n)).astype(np.int64)
                fits = (self.key_at[at] < 0).all(axis=1)
                for row in np.flatnonzero(fits):
                    if len(set(at[row].tolist())) == len(members):
                        break
                else:
                    seed += len(tries)
                    continue
                self.displace[b] = seed + row
                self.key_at[at[row]] = members
                break

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % np.uint64(self.m)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of the key that each string equals, or -1; strings are compared, not only hashes."""
        place = (_mixed(hashes, self.displace[self._bucket(hashes)]) % np.uint64(self.n)).astype(np.int64)
        key = self.key_at[place]
        key_start = self.ends[key]
        key[self.ends[key + 1] - key_start != lengths] = -1
        maybe = np.flatnonzero(key >= 0)
        if len(maybe):
            n = lengths[maybe]
            same = pt.gather(data, starts[maybe], n) == pt.gather(self.bytes, self.ends[key[maybe]], n)
            key[maybe[~np.logical_and.reduceat(same, np.cumsum(n) - n)]] = -1
        return key


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a string: the mergeable pair of lowest rank first, the leftmost of equal ones."""
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into the part before
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] - i != length:
            continue  # one of the two parts has changed since
        end[i], end[j] = end[j], 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(token[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k] - i))
        if (h := before[i]) >= 0 and (r := ranks.get(token[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i] - h))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.by_id = {i: b for b, i in self.ranks.items()}
        keys = list(self.ranks)
        self.table = PerfectHash(keys)
        self.key_id = np.array([self.ranks[k] for k in keys], np.uint32)
        self.merged: dict[bytes, np.ndarray] = {}

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and the number of ids per part."""
        data, marks, counts = pt.split(parts)
        if len(marks) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        hashes = pt.token_hashes(data, marks)
        place, kind = pt.distinct(data, marks, hashes)
        starts, lengths = marks[:-1][place], np.diff(marks)[place]
        key = self.table.find(data, starts, lengths, hashes[place])
        whole, raw = key >= 0, data.tobytes()
        flat, sizes = [], np.ones(len(place), np.int64)
        for i in np.flatnonzero(~whole).tolist():
            ids = self._merged(raw[starts[i] : starts[i] + lengths[i]])
            flat.append(ids)
            sizes[i] = len(ids)
        kinds = np.zeros(int(sizes.sum()), np.uint32)
        at = np.cumsum(sizes) - sizes
        kinds[at[whole]] = self.key_id[key[whole]]
        if flat:
            rest = np.ones(len(kinds), bool)
            rest[at[whole]] = False
            kinds[rest] = np.concatenate(flat)
        per_token = sizes[kind]
        total = np.concatenate([[0], np.cumsum(per_token)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return pt.gather(kinds, at[kind], per_token), np.diff(total[edge])

    def _merged(self, token: bytes) -> np.ndarray:
        ids = self.merged.get(token)
        if ids is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            ids = np.array(merge(token, self.ranks), np.uint32)
            if len(token) <= 64:
                self.merged[token] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(texts: list[str], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, ids) for each piece of each text, in order; every text has a piece."""
    coder = codec(path)
    for rows, parts in pt.slices(texts):
        ids, counts = coder.encode(parts)
        yield from zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True)


def _digests(path: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, of_ids, of_bytes = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            coder = codec(path)
            for row, ids in encoded(texts, path):
                n[row] += len(ids)
                of_ids[row].update(ids.astype("<u4").tobytes())
                of_bytes[row].update(coder.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_bytes])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to.

    Null and empty texts have no ids.  Repeated rows give repeated rows; other columns are not read.  path
    must be readable in every task, as an installed package is.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, schema: pa.Schema, text_at: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            out: list[list[np.ndarray]] = [[] for _ in texts]
            for row, ids in encoded([t or "" for t in texts], path):
                out[row].append(ids)
            joined = [None if t is None else np.concatenate(x).astype("<u4").tobytes() for t, x in zip(texts, out, strict=True)]
            n = [None if x is None else len(x) // 4 for x in joined]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(joined, pa.binary())], schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", n: str = "n_tokens") -> DataFrame:
    """The rows with the number of ids and the ids of a text column, as little-endian 32-bit integers; null stays null.

    Columns named like the two new ones are replaced.  Long texts are taken in slices; repeated rows are encoded each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    names = [c for c in docs.columns if c not in (n, ids)]
    kept = docs.select(*(f"`{c}`" for c in names))
    # by place, as a name may hold a dot
    places = [f"_{i}" for i in range(len(names))]
    out = StructType([StructField(place, f.dataType) for place, f in zip(places, kept.schema, strict=True)])
    out = out.add(n, LongType()).add(ids, BinaryType())
    return kept.toDF(*places).mapInArrow(_ids(path, to_arrow_schema(out), names.index(text)), out).toDF(*names, n, ids)


def decode_ids(ids: bytes, path: str) -> bytes:
    return codec(path).decode(np.array(struct.unpack(f"<{len(ids) // 4}I", ids), np.uint32))
