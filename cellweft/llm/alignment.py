"""Cross-tokenizer alignment by products of sparse incidence matrices.

Two tokenizers A and B cut the same bytes.  With a row per token and a column per byte, A times B transposed
counts the bytes that two tokens share: the overlap links.  Byte offsets where tokens of both end cut the text into
groups; with a row per group and a column per token id, A transposed times B counts the links of each id pair.  Matrices are
held as compressed rows (CSR) and multiplied row by row (Gustavson): each entry of a row calls up a row of the
other factor, and a row of the result is the sum of those.

How many documents hold an id pair is counted over all documents: slices of documents send their different pairs to buckets by A's id,
buckets add them up, and send back to each slice the counts of its own pairs.  Ids of the two vocabularies bound what a bucket can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm import pretokens as pt
from cellweft.llm.common import stored
from cellweft.llm.remembered import Remembered
from cellweft.llm.token_files import Library

#: Bits of an id of B in the number of an id pair.
B_BITS = 15
#: A slice of documents closes when it holds so many different id pairs of documents.
SLICE_PAIRS = 1 << 19
#: Products of entries that are made at once.
AT_ONCE = 1 << 20
#: Pre-tokens that a task remembers.
REMEMBERED = 1_200_000
#: Characters that are aligned in one go.
CHARACTERS = 1 << 19


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has columns[starts[i] : starts[i + 1]] with those values."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
    """A matrix from entries in any order; entries of one place are added."""
    key = rows.astype(np.int64) * width + columns
    steps = np.diff(key)
    if (steps <= 0).any():
        if (steps < 0).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, values = key[first], np.add.reduceat(values, first)
    rows = key // max(width, 1)
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=height))])
    return Csr(starts, key - rows * width, values, width)


def transposed(m: Csr) -> Csr:
    height = len(m.starts) - 1
    return csr(m.columns, np.repeat(np.arange(height), np.diff(m.starts)), m.values, m.width, height)


def products(left: Csr, right: Csr) -> Iterator[Csr]:
    """The rows of left times right, a block of rows after the other, by Gustavson's row products.

    A block calls up AT_ONCE entries of right or a little more; one row that calls up more is made in parts,
    which are added, so that no more than a row of the result and AT_ONCE products are held.
    """
    calls = np.diff(right.starts)[left.columns]
    upto = np.concatenate([[0], np.cumsum(calls)])
    ends = upto[left.starts]
    at, height = 0, len(left.starts) - 1
    while at < height:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, side="right")) - 1)
        rows = np.repeat(np.arange(to - at), np.diff(left.starts[at : to + 1]))
        first, last = left.starts[at], left.starts[to]
        part = None
        while part is None or first < last:
            cut = min(max(int(np.searchsorted(upto, upto[first] + AT_ONCE, side="right")) - 1, first + 1), last)
            own = slice(first, cut)
            times, started = calls[own], right.starts[left.columns[own]]
            ends_of = np.cumsum(times)
            entry = np.arange(int(ends_of[-1]) if len(ends_of) else 0) + np.repeat(started - (ends_of - times), times)
            row = np.repeat(rows[first - left.starts[at] : cut - left.starts[at]], times)
            value = np.repeat(left.values[own], times) * right.values[entry]
            made = csr(row, right.columns[entry], value, to - at, right.width)
            if part is not None:
                both = [np.concatenate(x) for x in ((_rows(part), _rows(made)), (part.columns, made.columns), (part.values, made.values))]
                made = csr(*both, to - at, right.width)
            part, first = made, cut
        yield part
        at = to


def _rows(m: Csr) -> np.ndarray:
    return np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))


def byte_matrix(ends: np.ndarray, size: int) -> Csr:
    """Token by byte: a one where the byte is in the token; tokens follow one another from byte 0 to size."""
    starts = np.concatenate([[0], ends]).astype(np.int64)
    return Csr(starts, np.arange(size), np.ones(size, np.int64), size)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> Csr:
    """Token by token: the number of bytes that a token of A shares with one of B."""
    size = int(ends_a[-1]) if len(ends_a) else 0
    blocks = list(products(byte_matrix(ends_a, size), transposed(byte_matrix(ends_b, size))))
    if not blocks:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(ends_b))
    sizes = np.concatenate([np.diff(b.starts) for b in blocks])
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), *(np.concatenate([b[i] for b in blocks]) for i in (1, 2)), len(ends_b))


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each token of A, of each token of B, end of each group)."""
    size = int(ends_a[-1]) + 1 if len(ends_a) else 1
    is_end = np.zeros((2, size), bool)
    is_end[0, ends_a] = is_end[1, ends_b] = True
    closes_a, closes_b = is_end[1, ends_a], is_end[0, ends_b]
    return np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b, ends_a[closes_a]


def pair_counts(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id pair, links) of all token pairs that share a group; owner is the ascending document number of each group.

    A row of the first factor is an id of A within a document, a row of the second a group.  Equal ids of a group are
    one entry, so a group of n and m tokens makes no more products than it has different ids.
    """
    per_a = csr(group_a, ids_a, np.ones(len(ids_a), np.int64), len(owner), 1 << 16)
    per_b = csr(group_b, ids_b, np.ones(len(ids_b), np.int64), len(owner), 1 << B_BITS)
    group = _rows(per_a)
    row = owner[group] << 16 | per_a.columns
    order = np.argsort(row, kind="stable")  # groups of an id stay in order
    row = row[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    names = row[starts]
    by_id = Csr(np.append(starts, len(row)), group[order], per_a.values[order], len(owner))
    keys, links, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for block in products(by_id, per_b):
        height = len(block.starts) - 1
        keys.append(np.repeat(names[first : first + height], np.diff(block.starts)) << B_BITS | block.columns)
        links.append(block.values)
        first += height
    key = np.concatenate(keys)
    return key >> (16 + B_BITS), key & ((1 << (16 + B_BITS)) - 1), np.concatenate(links)


class PieceEncoder:
    """Ids of a piece model, which puts one space in front of a text.

    No piece holds a space after another character, nor a line break beside one, so merges never cross these places: each
    different stretch between them is encoded once.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        names = [p.piece for p in model.pieces]
        if not model.normalizer_spec.add_dummy_prefix or any("▁" in n.lstrip("▁") or "\n" in n for n in names):
            raise ValueError("pieces cross spaces or line breaks")
        model.normalizer_spec.add_dummy_prefix = False  # the space is put in front by the caller
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        tokens = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.sizes, flat = token_bytes(tokens)
        self.memory = Remembered(self._ids, REMEMBERED, self.sizes, flat)

    def _ids(self, texts: list[str], _) -> tuple[np.ndarray, np.ndarray]:
        found = self.processor.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def encode(self, parts: list[str]) -> Encoded:
        data, bounds = _bytes(parts)
        space, line = data == 0x20, data == 0x0A
        cut = line.copy()
        cut[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        marks = np.append(np.flatnonzero(cut), len(data))
        return Encoded(*self.memory.encode(data, marks, np.diff(np.searchsorted(marks[:-1], bounds))))


class ByteEncoder:
    """Ids of a byte-level model of the tokenizers library, by its pre-tokens; special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        library = Library(path)
        self.sizes, flat = token_bytes(library.tokens)
        self.memory = Remembered(library.ids, REMEMBERED, self.sizes, flat)

    def encode(self, parts: list[str]) -> Encoded:
        return Encoded(*self.memory.encode(*pt.split(parts)))


def token_bytes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(size of each token, the bytes of all)."""
    return np.array([len(t) for t in tokens], np.int64), np.frombuffer(b"".join(tokens), np.uint8)


class Encoded(NamedTuple):
    ids: np.ndarray
    counts: np.ndarray  # ids per part
    sound: np.ndarray  # whether the ids' bytes are those of the part


def _bytes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [p.encode("utf-8") for p in parts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str) -> tuple[ByteEncoder, PieceEncoder]:
    return ByteEncoder(path_a), PieceEncoder(path_b)


class Document:
    """What is gathered of a document, piece by piece."""

    def __init__(self) -> None:
        self.sound, self.n_a, self.n_b, self.n_groups, self.n_links, self.n_overlaps = True, 0, 0, 0, 0, 0
        self.hash, self.first = hashlib.sha256(), True
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: bytes, sizes: tuple[int, int, int], overlaps: int, pairs: np.ndarray, links: np.ndarray) -> None:
        self.hash.update(text if self.first else b";" + text)
        self.first = False
        self.n_a, self.n_b, self.n_groups = (x + y for x, y in zip((self.n_a, self.n_b, self.n_groups), sizes, strict=True))
        self.n_overlaps += overlaps
        self.n_links += int(links.sum())
        self.pairs.append((pairs, links))

    def id_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The different id pairs in ascending order and their links; none if the bytes did not agree."""
        if not self.sound or not self.pairs:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            pairs, links = self.pairs[0]
        else:
            every, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            pairs, links = every, np.bincount(at, np.concatenate([n for _, n in self.pairs]), len(every)).astype(np.int64)
        return pairs.astype(np.int32), links


def group_texts(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Groups as text, a1,a2|b1;a3|b2, for each run of groups up to one of ends."""
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    ids, side = np.concatenate([ids_a, ids_b])[order], side[order]
    # what stands before an id: its like, the other side, the next group, or nothing at the start of a run
    before = np.where(np.diff(side, prepend=-1) == 0, 0, np.where(side & 1, 1, 2))
    first = np.searchsorted(side, np.concatenate([[0], ends[:-1]]) * 2)
    last = np.searchsorted(side, ends * 2)
    before[first[first < last]] = 3
    out = list(map(_words().__getitem__, (before << 16 | ids).tolist()))
    return [b"".join(out[f:t]) for f, t in zip(first.tolist(), last.tolist(), strict=True)]


@lru_cache(maxsize=1)
def _words() -> list[bytes]:
    """An id as text after each of the four marks that group_texts knows."""
    return [mark + b"%d" % i for mark in (b",", b"|", b";", b"") for i in range(1 << 16)]


def aligned(texts: list[str | None], path_a: str, path_b: str) -> Iterator[Document]:
    """A Document for each text, in order."""
    a, b = encoders(path_a, path_b)
    held, at = Document(), 0
    for rows, parts in pt.slices((" " + t if t else "" for t in texts), CHARACTERS, pt.BEFORE_WORD):
        got_a, got_b = a.encode(parts), b.encode(parts)
        _, bounds = _bytes(parts)
        sound = got_a.sound & got_b.sound
        # parts whose bytes do not agree take no part
        keep_a, keep_b = np.repeat(sound, got_a.counts), np.repeat(sound, got_b.counts)
        ids_a, ids_b = got_a.ids[keep_a].astype(np.int64), got_b.ids[keep_b].astype(np.int64)
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        group_a, group_b, common = groups_of(ends_a, ends_b)
        edges = np.cumsum(np.where(sound, np.diff(bounds), 0))
        edge = np.searchsorted(common, edges, side="right")  # groups up to the end of each part
        owner = np.repeat(np.arange(len(parts)), np.diff(edge, prepend=0))
        own, pairs, links = pair_counts(group_a, ids_a, group_b, ids_b, owner)
        shared = overlaps(ends_a, ends_b)
        token_edge = np.cumsum(np.where(sound, got_a.counts, 0))
        n_overlaps = np.diff(shared.starts[token_edge], prepend=0).tolist()
        split = np.searchsorted(own, np.arange(len(parts) + 1))
        texts_of = group_texts(ids_a, group_a, ids_b, group_b, edge)
        n_a, n_b, n_groups = (x.tolist() for x in (got_a.counts, got_b.counts, np.diff(edge, prepend=0)))
        for i, row in enumerate(rows):
            while at < row:
                yield held
                held, at = Document(), at + 1
            if not sound[i]:
                held.sound = False
            elif parts[i]:
                own = slice(split[i], split[i + 1])
                held.add(texts_of[i], (n_a[i], n_b[i], n_groups[i]), n_overlaps[i], pairs[own], links[own])
    if texts:
        yield held


def squeezed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small ones take little."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosened(data: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).reshape(-1).view(dtype)


ROW_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string"
SLICE_SCHEMA = "slice long, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_overlaps:bigint,groups_sha256:string>>, pairs binary, holders binary, sizes binary, entries binary, links binary"
ROW_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256")


def _slices(path_a: str, path_b: str):
    """Documents with their counts, and their id pairs as places in the slice's sorted different pairs."""

    def closed(number, docs, held):
        sizes = np.array([len(p) for p, _ in held], np.int32)
        every = np.concatenate([np.zeros(0, np.int32), *[p for p, _ in held]])
        links = np.concatenate([np.zeros(0, np.int64), *[n for _, n in held]])
        pairs, entries, holders = np.unique(every, return_inverse=True, return_counts=True)
        # places ascend within a document, so their steps are small
        steps = np.diff(entries.astype(np.int32), prepend=np.int32(0))
        row = [number, docs, *map(squeezed, (pairs, holders.astype(np.int32), sizes, steps, links))]
        types = [pa.int64(), pa.list_(ARROW_ROW), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["slice", "docs", "pairs", "holders", "sizes", "entries", "links"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        docs, held, size = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, doc in zip(doc_ids, aligned(batch.column(1).to_pylist(), path_a, path_b), strict=True):
                pairs, links = doc.id_pairs()
                if len(pairs):
                    values = (doc.n_a, doc.n_b, doc.n_groups, doc.n_links, doc.n_overlaps, doc.hash.hexdigest())
                else:
                    values = (0, 0, 0, 0, 0, "")
                docs.append(dict(zip(ROW_NAMES, (doc_id, *values), strict=True)))
                held.append((pairs, links))
                size += len(pairs) + 1
                if size >= SLICE_PAIRS:
                    yield closed(number, docs, held)
                    number, docs, held, size = number + 1, [], [], 0
        if docs:
            yield closed(number, docs, held)

    return run


ARROW_ROW = pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ROW_NAMES])


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of an id of A are in one bucket."""
    return ((pairs >> B_BITS).astype(np.uint64) * np.uint64(pt.FACTOR) >> np.uint64(40)).astype(np.int64) % buckets


def _dealt(buckets: int, with_counts: bool):
    """bucket, slice, pairs (and in how many documents of the task they are): the pairs of slices, parted by bucket.

    With counts the slices of a batch are added up first.
    """

    def run(batches):
        for batch in batches:
            rows = [(s, loosened(p, np.int32), loosened(n, np.int32)) for s, p, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if with_counts and rows:
                pairs, at = np.unique(np.concatenate([p for _, p, _ in rows]), return_inverse=True)
                rows = [(0, pairs, np.bincount(at, np.concatenate([n for *_, n in rows]), len(pairs)).astype(np.int64))]
            out = []
            for number, pairs, n in rows:
                bucket = _bucket_of(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                names, at = np.unique(bucket[order], return_index=True)
                own = np.split(pairs[order], at[1:])
                sums = np.split(n[order].astype(np.int64), at[1:]) if with_counts else [np.zeros(0, np.int64)] * len(names)
                out += [(int(b), number, squeezed(p), squeezed(c)) for b, p, c in zip(names, own, sums, strict=False)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "slice", "pairs", "n"])

    return run


def _added(batches):
    """bucket, pairs, counts: the documents of each pair of a bucket, negative where no pair of its id of A has more."""

    def closed(bucket, pairs, counts):
        ids = pairs >> B_BITS
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(ids))))
        counts = np.where(counts == best, -counts, counts)
        arrays = [pa.array([bucket], pa.int64()), pa.array([squeezed(pairs)], pa.binary()), pa.array([squeezed(counts)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "pairs", "counts"])

    def merged(parts):
        pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)

    held, waiting, bucket = [], 0, None
    for batch in batches:
        for b, pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield closed(bucket, *merged(held))
                held, waiting = [], 0
            bucket = b
            held.append((loosened(pairs, np.int32), loosened(n, np.int64)))
            waiting += len(held[-1][0])
            if waiting > 2 * len(held[0][0]) + AT_ONCE:  # what is held stays near what is different
                held = [merged(held)]
                waiting = len(held[0][0])
    if held:
        yield closed(bucket, *merged(held))


def _answered(batches):
    """slice, bucket, counts of the slice's pairs in the bucket, from rows of (bucket, slice, pairs, counts), where the bucket's own row, without slice, comes first."""
    every = sums = None
    for batch in batches:
        out = []
        for bucket, number, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number is None:
                every, sums = loosened(pairs, np.int32), loosened(counts, np.int64)
            else:
                out.append((number, bucket, squeezed(sums[np.searchsorted(every, loosened(pairs, np.int32))])))
        columns = zip(*out, strict=True) if out else [[]] * 3
        arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["slice", "bucket", "counts"])


def _scored(buckets: int):
    """The documents of each slice with n_best and count_sum."""

    def of(docs, pairs, sizes, steps, links, answers):
        pairs, sizes, links = loosened(pairs, np.int32), loosened(sizes, np.int32), loosened(links, np.int64)
        counts = np.zeros(len(pairs), np.int64)
        told = [loosened(x["counts"], np.int64) for x in sorted(answers or (), key=lambda x: x["bucket"])]
        if told:
            counts[np.argsort(_bucket_of(pairs, buckets), kind="stable")] = np.concatenate(told)
        own = counts[np.cumsum(loosened(steps, np.int32), dtype=np.int32)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        best = np.concatenate([[0], np.cumsum(links * (own < 0))])[edges]
        total = np.concatenate([[0], np.cumsum(links * np.abs(own))])[edges]
        for doc, n_best, count_sum in zip(docs, np.diff(best).tolist(), np.diff(total).tolist(), strict=True):
            yield {**doc, "n_best": n_best, "count_sum": count_sum}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(of(*(c[i].as_py() for c in batch.columns)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.string() if n == "groups_sha256" else pa.int64()) for n in SCORED], list(SCORED))

    return run


SCORED = (*ROW_NAMES, "n_best", "count_sum")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document: tokens of A and B, groups, links, overlapping token pairs, and what the corpus says of its links.

    Null and empty texts, and those whose tokens do not spell one space and the text, have no tokens: zeros and an
    empty digest.  Rows that repeat a doc_id are documents of their own; ties for the best count are all best.  Long texts are taken in
    slices, cut where neither tokenizer can join.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    slices = stored(texts.mapInArrow(_slices(path_a, path_b), SLICE_SCHEMA), "slices")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = slices.select("slice", "pairs", "holders")
    schema = "bucket long, slice long, pairs binary, n binary"
    counted = parts.mapInArrow(_dealt(buckets, True), schema).select("bucket", "pairs", "n")
    counted = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = stored(counted.mapInArrow(_added, "bucket long, pairs binary, counts binary"), "pair_counts")
    asked = parts.mapInArrow(_dealt(buckets, False), schema).select("bucket", "slice", "pairs", F.lit(None).cast("binary").alias("counts"))
    told = counts.select("bucket", F.lit(None).cast("long").alias("slice"), "pairs", "counts")
    both = told.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
    answers = both.mapInArrow(_answered, "slice long, bucket long, counts binary")
    answers = answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    rows = slices.join(answers, "slice", "left").select("docs", "pairs", "sizes", "entries", "links", "answers")
    return rows.mapInArrow(_scored(buckets), f"{ROW_SCHEMA}, n_best long, count_sum long")
