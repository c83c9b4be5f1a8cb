"""Suffix-array dedup by threshold-bounded interval expansion.

Every byte goes that is covered by a string of LENGTH bytes which also starts in a document with a smaller
doc_id.  Windows of LENGTH bytes meet by their anchor (see anchors.py): anchors that occur once are left out, the
others send the stretch of text that their windows cover to one task.  A task builds a Burrows-Wheeler
transform of the different stretches and extends intervals backwards, breadth first, so that common
prefixes come out by increasing value; it stops at LENGTH, and what is then still together shares LENGTH bytes.
Anchors that occur very often go no such way: their windows are grouped by their bytes, over all tasks.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellweft.llm import anchors
from cellweft.llm import pretokens as pt
from cellweft.llm.anchors import LENGTH
from cellweft.llm.common import stored

#: Bytes of stretches that share a transform; an anchor's stretches stay together.
CHUNK = 1 << 16
#: An anchor that occurs so often is not brought to one task: once in so many bytes of text, within these bounds.
BYTES_PER_HOT, LEAST_HOT, MOST_HOT = 1 << 14, 1 << 14, 1 << 15
#: Bits of the sketch that says which anchors occur more than once: 16 per such anchor, from and up to these.
LEAST_BITS, MOST_BITS = 16, 29
#: Text bytes per bucket of the count.
BUCKET_BYTES = 1 << 21


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 56 symbols or more; symbols are below 512 and wrap around."""
    return ranked_suffixes(text)[0]


def ranked_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of sorted_suffixes, the rank of each suffix by a smaller number of symbols, and that number."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | np.roll(text, -k)
    span = 7
    while True:
        order = np.argsort(key)
        if span >= LENGTH:
            return order, ranks, span // 2
        ranks = np.empty(n, np.int64)
        ranked = key[order]
        ranks[order] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        key = ranks << 32 | np.roll(ranks, -span)
        span *= 2


def shared_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH, known: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Whether each suffix in order starts a new group of suffixes with length symbols in common.

    The transform's column holds the symbol before each suffix, and its k-th c stands for the k-th suffix that
    starts with c.  Extending all intervals of one value backwards by c so parts c's suffixes where their places
    in the column lie in different intervals: boundaries of value v give those of v + 1.  `known` are
    ranks of the suffixes by a value of symbols, as the sort has them: its intervals are extended from that value on.
    """
    ranks, value = known or (text, 1)
    column = text[order - 1].astype(np.uint16)
    place = np.argsort(column, kind="stable").astype(np.int32)
    parted = np.ones(len(text), bool)
    first = ranks[order]
    np.not_equal(first[1:], first[:-1], out=parted[1:])
    whole = np.flatnonzero(~parted)
    before, own = place[whole - 1], place[whole]
    start, end = _intervals(parted)
    for _ in range(length - value):
        new = start[before] != start[own]
        cut = whole[new]
        if not len(cut):
            break
        parted[cut] = True
        if len(cut) * 16 > len(text):
            start, end = _intervals(parted)
        else:
            _part(start, end, cut)
        np.logical_not(new, out=new)
        whole, before, own = whole[new], before[new], own[new]
    return parted


def _intervals(parted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each place's interval, and at each start the interval's end."""
    starts = np.flatnonzero(parted).astype(np.int32)
    sizes = np.diff(np.append(starts, np.int32(len(parted))))
    end = np.zeros(len(parted), np.int32)
    end[starts] = starts + sizes
    return np.repeat(starts, sizes), end


def _part(start: np.ndarray, end: np.ndarray, cut: np.ndarray) -> None:
    """Intervals are parted in place at a few ascending places; only what is right of a cut is written."""
    cut = cut.astype(np.int32)
    old = start[cut]
    first = np.ones(len(cut), bool)
    first[1:] = old[1:] != old[:-1]
    upto = end[old]
    upto[:-1][~first[1:]] = cut[1:][~first[1:]]  # the next cut of the same interval
    end[old[first]] = cut[first]
    end[cut] = upto
    sizes = upto - cut
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(cut - (ends - sizes).astype(np.int32), sizes)
    start[at] = np.repeat(cut, sizes)


def window_minimum(stretches: list[bytes], first_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest document of each window of each stretch, windows per stretch)."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    data = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    data[ends - 1] = 0
    starts, counts = ends - sizes - 1, sizes - LENGTH + 1
    order, ranks, value = ranked_suffixes(data)
    group_of = np.empty(len(data), np.int64)
    group_of[order] = np.cumsum(shared_prefixes(data, order, known=(ranks, value))) - 1
    windows = pt.gather(np.arange(len(data)), starts, counts)
    group = group_of[windows]
    least = np.full(int(group_of.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, np.repeat(first_doc, counts))
    return least[group], counts


def _hash_parts(buckets: int):
    """Per batch and bucket the hashes of all anchors, a hash twice at most; more has (hash, further times)."""

    def run(batches):
        for batch in batches:
            found = []
            for data, ends, _, _ in anchors.slices(t.as_py().encode("utf-8") for t in batch.column(0)):
                place, hashes, _, _ = anchors.find(data, ends)
                found.append(hashes.view(np.uint64))
            hashes = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            third = np.zeros(len(hashes), bool)
            third[2:] = (hashes[2:] == hashes[:-2])
            again, times = np.unique(hashes[third], return_counts=True)
            further = np.stack([again, times.astype(np.uint64)], axis=1)
            hashes = hashes[~third]
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, at = np.unique(bucket[order], return_index=True)
            parts = [x.tobytes() for x in np.split(hashes[order], at[1:])] if len(names) else []
            own = (further[:, 0] % np.uint64(buckets)).astype(np.int64)
            further = further[np.argsort(own, kind="stable")]
            more = [x.tobytes() for x in np.split(further, np.searchsorted(np.sort(own), names[1:]))] if len(names) else []
            arrays = [pa.array(names, pa.int64()), pa.array(parts, pa.binary()), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "hashes", "more"])

    return run


def _repeated(batches):
    """The hashes that occur more than once in a bucket, as places in the sketch's hash space, and how often."""

    def of(parts, more):
        values, counts = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_counts=True)
        further = np.frombuffer(b"".join(more), np.uint64).reshape(-1, 2)
        np.add.at(counts, np.searchsorted(values, further[:, 0]), further[:, 1].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(values[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["h", "times"])

    held, further, bucket = [], [], None
    for batch in batches:
        for b, part, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield of(held, further)
                held, further = [], []
            bucket = b
            held.append(part)
            further.append(more)
    if held:
        yield of(held, further)


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        return h >> shift, (h * np.uint64(0x9E3779B97F4A7C15)) >> shift


def sketch_of(repeated: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit set with two bits per hash; its size is bounded whatever n is."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def words(batches):
        for batch in batches:
            both = np.unique(np.concatenate(_probes(batch.column(0).to_numpy(), bits)))
            word, at = np.unique(both >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (both & np.uint64(63)), at) if len(at) else both
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    rows = repeated.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out, bits


def _stretches(sketch, bits: int, hot, of_hot: bool):
    """Each different stretch of a batch whose anchor may repeat, with the documents and places it has there.

    hot are the sorted hashes of the anchors that occur very often: only these, or all others.
    """

    def run(batches):
        words, often = sketch.value, hot.value
        for batch in batches:
            doc_ids, own = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for data, ends, owners, offsets in anchors.slices(t.as_py().encode("utf-8") for t in batch.column(0)):
                _, hashes, first, last = anchors.find(data, ends)
                if len(often):
                    is_hot = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
                    part = np.flatnonzero(is_hot == of_hot)
                    hashes, first, last = hashes[part], first[part], last[part]
                a, b = _probes(hashes, bits)
                one, low = np.uint64(1), np.uint64(63)
                keep = np.flatnonzero((words[a >> np.uint64(6)] >> (a & low)) & (words[b >> np.uint64(6)] >> (b & low)) & one)
                if not len(keep):
                    continue
                hashes, first, last = hashes[keep], first[keep], last[keep]
                piece = np.searchsorted(ends, first, side="right")
                start = first - (ends[piece] - np.diff(ends, prepend=0)[piece]) + offsets[piece]
                raw = data.tobytes()
                number: dict[bytes, int] = {}
                kind = np.array([number.setdefault(raw[f : t + LENGTH], len(number)) for f, t in zip(first.tolist(), last.tolist(), strict=True)])
                order = np.argsort(kind, kind="stable")
                at = np.concatenate([[0], np.flatnonzero(np.diff(kind[order])) + 1])
                row = owners[piece[order]]
                bounds, columns = [*at.tolist(), len(order)], []
                for values, kind in zip((doc_ids[row], own[row], start[order]), PLACE, strict=True):
                    whole, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
                    columns.append([whole[f * width : t * width] for f, t in itertools.pairwise(bounds)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[order[at]]), pa.array(list(number), pa.binary()), *(pa.array(c, pa.binary()) for c in columns)],
                    ["h", "stretch", "docs", "sums", "starts"],
                )

    return run


#: What is sent of a place: its document, the checksum of the text, and where in the text a stretch starts.
PLACE = (np.int64, np.uint32, np.uint32)
#: A text is shorter than this.
LONGEST = 1 << 40
#: A run is one number, its start and so many bits of its length; a longer one is cut.
LENGTH_BITS = 16
RUNS = "doc_id long, crc long, runs binary"


def _packed(docs: np.ndarray, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """A row per document: its runs of removed window starts, first to last (not included), joined where they touch."""
    order = np.lexsort((first, sums, docs))
    docs, sums, first, last = docs[order], sums[order], first[order], last[order]
    new_doc = np.ones(len(docs), bool)
    new_doc[1:] = (docs[1:] != docs[:-1]) | (sums[1:] != sums[:-1])
    shift = np.cumsum(new_doc) * LONGEST
    reach = np.maximum.accumulate(last + shift)
    new_run = new_doc.copy()
    new_run[1:] |= (first + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new_run)
    size = (np.maximum.reduceat(last, at) if len(at) else last) - first[at]
    most = (1 << LENGTH_BITS) - 1
    pieces = -(-size // most)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first[at], pieces) + nth * most
    whole = (start << LENGTH_BITS | np.minimum(np.repeat(size, pieces) - nth * most, most)).astype(np.int64).tobytes()
    cut = [*((np.cumsum(pieces) - pieces)[new_doc[at]] * 8).tolist(), len(whole)]
    rows = [docs[new_doc], sums[new_doc], pa.array([whole[a:b] for a, b in itertools.pairwise(cut)], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["doc_id", "crc", "runs"])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all rows of a binary column, how many each row has), without an object per row."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _whole_groups(batches):
    """Batches of rows sorted by h, cut where h changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if held and held[-1].column(0)[-1].as_py() != h[0]:
            yield _one(held)
            held = []
        if last:
            yield _one([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _one(held)


def _removed(batches):
    """doc_id, crc and runs of the windows that go, a row per document and transform."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        names = rows.column(1).dictionary_encode()
        docs, places = _flat(rows.column(2), np.int64)
        sums, starts = (_flat(rows.column(c), kind)[0].astype(np.int64) for c, kind in zip((3, 4), PLACE[1:], strict=True))
        kind = np.repeat(names.indices.to_numpy(), places)
        first_doc = np.full(len(names.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first_doc, kind, docs)
        least, counts = window_minimum(names.dictionary.to_pylist(), first_doc)
        per = counts[kind]
        at = (np.cumsum(counts) - counts)[kind]
        gone = pt.gather(least, at, per) < np.repeat(docs, per)
        begin = np.zeros(len(gone) + 1, bool)
        begin[np.cumsum(per)] = True
        before = np.concatenate([[False], gone[:-1]]) & ~begin[:-1]
        after = np.concatenate([gone[1:], [False]]) & ~begin[1:]
        head, tail = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        edge = np.cumsum(per) - per
        row = np.searchsorted(edge, head, side="right") - 1
        first = starts[row] + head - edge[row]
        return _packed(docs[row], sums[row], first, first + tail - head + 1)

    held, size = [], 0
    for rows in _whole_groups(batches):
        h = rows.column(0).to_numpy()
        docs, places = _flat(rows.column(2), np.int64)
        group = np.flatnonzero(np.diff(h, prepend=h[0] ^ 1))
        at = (np.cumsum(places) - places)[group]
        # one document repeats itself, or the sketch was wrong
        alone = np.minimum.reduceat(docs, at) == np.maximum.reduceat(docs, at)
        sizes = np.diff(np.append(group, len(h)))
        rows = rows.filter(pa.array(np.repeat(~alone, sizes)))
        ends = np.cumsum(sizes[~alone])
        if not len(ends):
            continue
        upto = np.cumsum(_flat(rows.column(1), np.uint8)[1])[ends - 1]  # bytes of stretches to the end of each group
        cut, base = 0, 0
        while cut < rows.num_rows:
            full = int(np.searchsorted(upto, base + CHUNK - size))
            last = full >= len(ends)
            end = rows.num_rows if last else int(ends[full])
            held.append(rows.slice(cut, end - cut))
            size += int(upto[-1] if last else upto[full]) - base
            if not last or size >= CHUNK:
                yield of(_one(held))
                held, size = [], 0
            cut, base = end, int(upto[-1] if last else upto[full])
    if held:
        yield of(_one(held))


def _spans(batches):
    """stretch, its first and last document in a row of places, and the number of places."""
    for batch in batches:
        docs = [np.frombuffer(d, np.int64) for d in batch.column(1).to_pylist()]
        numbers = ([f(d) for d in docs] for f in (np.min, np.max, len))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in numbers)], ["stretch", "first", "last", "n"])


def _marked(batches):
    """doc_id, crc and runs as of _removed, from rows of places with the windows of their stretch that some document loses.

    The stretches of a document come one after the other, where they are not shuffled, so it is one row of a batch.
    """
    for batch in batches:
        found = [np.zeros((0, 4), np.int64)]
        for stretch, docs, sums, starts, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs, sums, starts = (np.frombuffer(x, kind).astype(np.int64) for x, kind in zip((docs, sums, starts), PLACE, strict=True))
            least = np.full(len(stretch) - LENGTH + 1, np.iinfo(np.int64).max)
            least[[m["at"] for m in marks]] = [m["least"] for m in marks]
            gone = np.pad(least < docs[:, None], ((0, 0), (1, 1)))
            edges = np.diff(gone.astype(np.int8), axis=1)
            row, head = np.nonzero(edges == 1)
            tail = np.nonzero(edges == -1)[1]
            found.append(np.stack([docs[row], sums[row], starts[row] + head, starts[row] + tail], axis=1))
        yield _packed(*np.concatenate(found).T)


def _joined(left: DataFrame, right: DataFrame, key: str, hot: int) -> DataFrame:
    """Inner join on a key that right has once; keys of `hot` or more left rows, as right's n says, are not shuffled."""
    often, rest = F.broadcast(right.where(F.col("n") >= hot).drop("n")), right.where(F.col("n") < hot).drop("n")
    return left.join(often, key).unionByName(left.join(often.select(key), key, "left_anti").join(rest, key))


def hot_runs(places: DataFrame, hot: int) -> DataFrame:
    """doc_id, crc and runs of the stretches of anchors that occur very often, with no key in one task.

    The first document of each different stretch, then of each different window; windows that some document
    loses go back to their stretches and these to their places.  Of what is broadcast there is a row per `hot` occurrences.
    """
    kinds = places.select("stretch", "docs").mapInArrow(_spans, "stretch binary, first long, last long, n long")
    kinds = kinds.groupBy("stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    kinds = stored(kinds, "hot_kinds")
    cut = F.transform(F.sequence(F.lit(1), F.length("stretch") - LENGTH + 1), lambda i: F.substring(F.col("stretch"), i, F.lit(LENGTH)))
    windows = kinds.select("stretch", "first", "last", F.posexplode(cut).alias("at", "window"))
    least = windows.groupBy("window").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("n"))
    least = stored(least.where("least < most").drop("most"), "hot_windows")
    lost = _joined(windows.drop("first"), least, "window", hot).where("least < last")
    marks = lost.groupBy("stretch").agg(F.collect_list(F.struct("at", "least")).alias("marks"))
    marks = stored(kinds.select("stretch", "n").join(marks, "stretch"), "hot_marks")
    both = _joined(places.drop("h"), marks, "stretch", hot).select("stretch", "docs", "sums", "starts", "marks")
    return both.mapInArrow(_marked, RUNS)


def _covered(runs: list[bytes] | None, n: int) -> np.ndarray:
    """Whether each of n bytes is covered by a removed window."""
    edges = np.zeros(n + 1, np.int64)
    every = np.frombuffer(b"".join(runs or ()), np.int64)
    first, size = every >> LENGTH_BITS, every & ((1 << LENGTH_BITS) - 1)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + size - 1 + LENGTH, -1)
    return np.cumsum(edges[:n]) > 0


def _texts_left(with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                gone = _covered(runs.as_py(), len(data))
                kept = data[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                # a cut inside a character leaves bytes that are no text
                left = kept.decode("utf-8", "ignore") if text is not None else None
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), left if with_text else None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left"])

    return run


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc_id, crc and lists of runs: the window starts that go, of documents that lose any."""
    spark = docs.sparkSession
    text = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    total = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, int(total // BUCKET_BYTES))
    parts = text.select("text").mapInArrow(_hash_parts(buckets), "bucket long, hashes binary, more binary")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    repeated = stored(parts.mapInArrow(_repeated, "h long, times long"), "repeated")
    words, bits = sketch_of(repeated.select("h"), repeated.count())
    least = min(MOST_HOT, max(LEAST_HOT, total // BYTES_PER_HOT))
    often = np.sort(repeated.where(F.col("times") >= least).select("h").toArrow().column(0).to_numpy())
    sketch, hot = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(often)
    keyed = text.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    schema = "h long, stretch binary, docs binary, sums binary, starts binary"
    found = keyed.mapInArrow(_stretches(sketch, bits, hot, False), schema)
    found = found.repartition("h").sortWithinPartitions("h")
    runs = found.mapInArrow(_removed, RUNS)
    if len(often):
        runs = runs.unionByName(hot_runs(stored(keyed.mapInArrow(_stretches(sketch, bits, hot, True), schema), "hot"), least))
    return runs.groupBy("doc_id", "crc").agg(F.collect_list("runs").alias("runs"))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and the text left if asked for.

    Null texts are empty.  A document without doc_id has no order: it takes nothing and loses nothing.  Rows that
    share a doc_id take nothing from each other.  Texts shorter than LENGTH bytes stay whole.  An empty table
    gives no rows; other columns are not read.  A null text has null left; a cut inside a character drops
    that character from left.
    """
    runs = removed_runs(docs).withColumnsRenamed({"doc_id": "d", "crc": "c"})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("crc"))
    both = keyed.join(runs, (keyed["doc_id"] == runs["d"]) & (keyed["crc"] == runs["c"]), "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, left string"
    out = both.mapInArrow(_texts_left(with_text), schema)
    return out if with_text else out.drop("left")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without the bytes that go; n_chars follows the text, and a document that loses all its text goes."""
    runs = removed_runs(docs).withColumnsRenamed({"doc_id": "d__", "crc": "c__", "runs": "runs__"})
    crc = F.crc32(docs["text"].cast("binary"))
    both = docs.join(runs, (docs["doc_id"].cast("long") == runs["d__"]) & (crc == runs["c__"]), "left").drop("d__", "c__")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            texts, every = [], batch.column(len(names))
            for text, own in zip(batch.column(at).to_pylist(), every, strict=True):
                if own.is_valid:
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    text = data[~_covered(own.as_py(), len(data))].tobytes().decode("utf-8", "ignore")
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(names))]
            left = pa.RecordBatch.from_arrays(columns, places)
            yield left.filter(pa.array([t != "" or not own.is_valid for t, own in zip(texts, every, strict=True)]))

    # by place, as a name may hold a dot
    places = [f"_{i}" for i in range(len(names))]
    schema = StructType([StructField(place, f.dataType) for place, f in zip(places, docs.schema, strict=True)])
    left = both.toDF(*places, "runs").mapInArrow(run, schema).toDF(*names)
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left
