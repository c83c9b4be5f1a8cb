"""Token ids as binary files: Simple-8b word-aligned coding with escapes and per-block offsets.

A 64-bit word holds a selector in its top four bits and, in the other sixty, as many ids as fit at the
selector's width.  An id of more than sixty bits is an escape: a word with selector 0, then the id in a word
of its own.  Blocks of BLOCK ids start at a word of their own; a table of offsets in front of the words says
which, so that any block can be decoded alone and all words at once with array operations.

A file holds segments in ascending document order, one per row of a Parquet file written by Spark (so files
reach any storage, and a lost task is written again).  A segment is

    magic 'S8B1', uint32 ids, uint32 blocks, uint32 words, uint32 offsets[blocks], uint64 words[words]

all little-endian, beside the doc_id and the length of each document in it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.llm import pretokens as pt
from cellweft.llm.remembered import Remembered
from cellweft.session import work_folder

MAGIC = b"S8B1"
#: Fixed values of the coding: ids per word and bits per id, by selector; selector 0 is the escape.
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 1 << 60
BLOCK = 4096
#: A segment closes when it holds so many ids.
SEGMENT = 1 << 20
#: Strings whose ids a task remembers; the memory starts anew when it is full.
REMEMBERED = 700_000
END_ID = 2


def pack(ids: np.ndarray) -> bytes:
    """A segment of ids, given as unsigned 64-bit integers."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<3I", 0, 0, 0)
    place = np.arange(n, dtype=np.int32)
    bits = np.append(_bit_lengths(ids), np.full(max(COUNTS), 255, np.uint8))  # nothing fits past the end
    chosen = np.zeros(n, np.uint8)
    # where a selector fits, all that pack less fit, too; the one that packs most comes last
    at, widest, taken = place, bits[:n], 1
    for selector in range(15, 0, -1):
        for k in range(taken, COUNTS[selector]):
            widest = np.maximum(widest, bits[at + k])
        taken = COUNTS[selector]
        fits = (widest <= WIDTHS[selector]) & (at % BLOCK + taken <= BLOCK)
        at, widest = at[fits], widest[fits]
        chosen[at] = selector
    step = np.maximum(np.array(COUNTS)[chosen], 1)
    jumps = place + step
    # blocks are independent: the next word of all that have one left
    ends = np.minimum(np.arange(BLOCK, n + BLOCK, BLOCK), n)
    at, found = np.arange(0, n, BLOCK), []
    while len(at):
        found.append(at)
        at = jumps[at]
        left = at < ends
        at, ends = at[left], ends[left]
    heads = np.sort(np.concatenate(found))
    selector = chosen[heads]
    escapes = selector == 0
    word_at = np.arange(len(heads)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(heads) + int(escapes.sum()), np.uint64)
    words[word_at[escapes] + 1] = ids[heads[escapes]]
    for s in np.unique(selector[~escapes]).tolist():
        own = heads[selector == s]
        word = np.full(len(own), s << 60, np.uint64)
        if WIDTHS[s]:
            for k in range(COUNTS[s]):
                word |= ids[own + k] << np.uint64(k * WIDTHS[s])
        words[word_at[selector == s]] = word
    offsets = word_at[np.searchsorted(heads, np.arange(blocks) * BLOCK)].astype("<u4")
    return MAGIC + struct.pack("<3I", n, blocks, len(words)) + offsets.tobytes() + words.astype("<u8").tobytes()


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; over 53 bits only whether it is an escape matters."""
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    wide = np.flatnonzero(ids >> np.uint64(53))
    bits[wide] = np.where(ids[wide] < np.uint64(ESCAPE), 60, 64)
    return bits


def _unpack_words(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    # an escape's second word may look like anything, another escape too: walk the escapes only
    raw = np.zeros(len(words), bool)
    last = -1
    for at in np.flatnonzero(selector == 0).tolist():
        if at != last:
            raw[at + 1] = True
            last = at + 1
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    counts = np.maximum(np.array(COUNTS)[selector], 1)
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        own = selector == s
        if s == 0:
            out[at[own]] = words[heads[own] + 1]
        elif WIDTHS[s]:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for k in range(COUNTS[s]):
                out[at[own] + k] = (words[heads[own]] >> np.uint64(k * WIDTHS[s])) & mask
    return out


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last (last not included) of a segment; all blocks by default."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, count = struct.unpack_from("<3I", segment, 4)
    offsets = np.append(np.frombuffer(segment, "<u4", blocks, 16), count)
    words = np.frombuffer(segment, "<u8", count, 16 + 4 * blocks)
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    return _unpack_words(words[offsets[first] : offsets[last]])


def byte_points() -> dict[int, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: b for b in own}, **{256 + i: b for i, b in enumerate(rest)}}


class Library:
    """A byte-level model of the tokenizers library, for pre-tokens; special strings in them are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        points = byte_points()
        self.tokens = [b""] * self.tokenizer.get_vocab_size()
        for name, i in self.tokenizer.get_vocab().items():
            self.tokens[i] = name.encode() if name in self.added else bytes(points[ord(c)] for c in name)
        self.token_sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.tokenizer.encode_special_tokens = True
        # what comes is split already
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of pre-tokens of so many bytes; no id spans two."""
        (got,) = self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.int64)
        upto = np.concatenate([[0], np.cumsum(self.token_sizes[ids])])
        edges = np.searchsorted(upto, np.concatenate([[0], np.cumsum(sizes)]))
        if upto[-1] != sizes.sum() or (upto[edges[1:]] != np.cumsum(sizes)).any():
            raise ValueError("the ids do not spell the text: not a byte-level vocabulary")
        return ids, np.diff(edges)


class LibraryEncoder:
    """Ids of texts by the tokenizers library.

    Merges never cross pre-tokens, so the library is given each distinct pre-token once instead of each text.  As the
    library does, a text is first cut at the strings of added tokens, which have ids of their own.
    """

    def __init__(self, path: str) -> None:
        library = Library(path)
        self.added = library.added
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.memory = Remembered(library.ids, REMEMBERED)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and the number of ids per part."""
        cut = [i for i, p in enumerate(parts) if self.cuts.search(p)] if self.cuts else []
        if not cut:
            ids, counts, _ = self.memory.encode(*pt.split(parts))
            return ids, counts
        split = [self.cuts.split(p) if i in set(cut) else [p] for i, p in enumerate(parts)]
        runs = [run for own in split for run in own]
        own_id = np.array([self.added.get(run, -1) if n % 2 else -1 for own in split for n, run in enumerate(own)])
        ids, counts, _ = self.memory.encode(*pt.split(["" if i >= 0 else run for run, i in zip(runs, own_id.tolist(), strict=True)]))
        at = np.flatnonzero(own_id >= 0)
        ids = np.insert(ids, (np.cumsum(counts) - counts)[at], own_id[at].astype(np.uint32))
        counts[at] = 1
        edge = np.concatenate([[0], np.cumsum([len(own) for own in split])])
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[edge])


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _document_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and all ids of each document, END_ID last."""
    encoder, end = library_encoder(path), np.array([END_ID], np.uint32)
    for batch in batches:
        doc_ids, own, at = batch.column(0).to_pylist(), [], 0
        for rows, parts in pt.slices(batch.column(1).to_pylist()):
            ids, counts = encoder.encode(parts)
            for row, piece in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                if row != at:
                    yield doc_ids[at], np.concatenate([*own, end])
                    own, at = [], row
                own.append(piece)
        if own:
            yield doc_ids[at], np.concatenate([*own, end])


ARROW_SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
SEGMENT_SCHEMA = "part int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
ARROW_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _segments(path: str) -> Callable:
    def run(batches):
        part, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def closed():
            lengths = [len(x) for x in held]
            row = dict(zip(ARROW_SEGMENT.names, (part, number, start, size, doc_ids, lengths, pack(np.concatenate(held))), strict=True))
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SEGMENT)

        for doc_id, ids in _document_ids(batches, path):
            doc_ids.append(doc_id)
            held.append(ids)
            size += len(ids)
            if size >= SEGMENT:
                yield closed()
                number, start = number + 1, start + size
                doc_ids, held, size = [], [], 0
        if held:
            yield closed()

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, parts: int | None = None) -> None:
    """Encode every text, END_ID after each, and write the files in ascending order of doc_id.

    Null texts count as empty, a null doc_id comes first, equal doc_ids are ordered by their text; other columns
    are not read.  An empty table gives files without segments.  A document stays within a segment, so a
    segment has SEGMENT ids and at most one document more.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    # packed words gain little from a second compression
    texts.mapInArrow(_segments(path), SEGMENT_SCHEMA).write.option("compression", "none").parquet(folder)


def _checksums(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, n = unpack(row["payload"]).astype("<u4"), row["lengths"]
            ends = np.cumsum(n)
            sums = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])]
            starts = row["start"] + ends - n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], schema=ARROW_READ)


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files.

    Places within a part are stored; the ids of earlier parts are added from a sum with a row per part.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = files.mapInArrow(_checksums, READ_SCHEMA)
    # a row per part of the range partitioning
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    folder = f"{work_folder(docs.sparkSession)}/tokens"
    write_token_files(docs, path, folder)
    return read_checksums(docs.sparkSession, folder)
