"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of five-word shingles form a class, and classes are joined.  Classes that agree in
a band of MinHash values are candidates.  Their MinHash values are compared a few at a time, and a pair goes
as soon as the posterior probability that its similarity reaches the threshold falls below the tolerance.
The rest is verified on the whole shingle sets.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32, about 5e-8, and is pruned with about
TOLERANCE per comparison; nothing else is lost.  Pairs are never rows: a task compares blocks of at most BLOCK
classes of a bucket and returns one row per class.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import grouped, stored
from cellweft.llm.shingles import shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: MinHash values that are compared before the posterior is looked at again.
STEP = 16
TOLERANCE = 1e-7
BLOCK = 512
#: Characters that are hashed in one go.
SLICE = 1 << 20


def multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, least number of equal values among the first n that keeps a pair).

    With a uniform prior, m of n equal values give P(similarity >= s) = P(Binomial(n + 1, s) <= m).
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _text_slices(texts: list[str]):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _classes(batches):
    """doc_id, class and MinHash values of each text; without words the class is that of the text itself."""
    factors = multipliers()
    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
        classes, signatures = [], []
        for _, part in _text_slices([t or "" for t in texts]):
            hashes, n = shingle_hashes(part, WORDS)
            values = np.zeros((len(part), len(factors)), np.uint32)
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]
            if len(some):
                with np.errstate(over="ignore"):
                    for j, factor in enumerate(factors):
                        values[some, j] = np.minimum.reduceat(hashes * factor, starts) >> np.uint64(32)
            for i, own in enumerate(np.split(hashes, np.cumsum(n)[:-1])):
                content = np.unique(own).tobytes() if len(own) else b"text" + part[i].encode()
                classes.append(hashlib.blake2b(content, digest_size=16).digest())
                signatures.append(values[i].tobytes() if len(own) else None)
        kept = [c if t is not None else None for c, t in zip(classes, texts, strict=True)]
        signed = [s if t is not None else None for s, t in zip(signatures, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([doc_ids, batch.column(2), pa.array(kept, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "own", "class", "sig"])


def _bands(batches):
    """class and key of each band."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        pa_class = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        yield pa.RecordBatch.from_arrays([pa_class, pa.array(_band_keys(values).ravel().view(np.int64))], ["class", "key"])


def _band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
        for r in range(ROWS):
            key = (key ^ values[:, :, r]) * np.uint64(0xC6A4A7935BD1E995)
            key ^= key >> np.uint64(29)
    return key


def candidate_pairs(signatures: np.ndarray, key: int, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that no earlier band has and that pruning keeps."""
    keys = _band_keys(signatures.reshape(-1, BANDS, ROWS))
    band = int(np.flatnonzero((keys[left[0]] == np.uint64(key)))[0])
    fresh = np.triu(np.ones((len(left), len(right)), bool), 1) if same else np.ones((len(left), len(right)), bool)
    for b in range(band):
        fresh &= keys[left, b][:, None] != keys[right, b][None, :]
    i, j = np.nonzero(fresh)
    i, j = left[i], right[j]
    met, done = np.zeros(len(i), np.int64), 0
    for n, least in least_matches():
        met += (signatures[i, done:n] == signatures[j, done:n]).sum(1)
        keep = met >= least
        i, j, met, done = i[keep], j[keep], met[keep], n
    return i, j


def _candidates(batches):
    """For each block pair the classes that have a candidate there, with their partners."""
    for rows in grouped(batches, 3):
        key, s, t = rows[0][:3]
        signatures = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), -1)
        block = np.array([r[3] for r in rows])
        left, right = np.flatnonzero(block == s), np.flatnonzero(block == t)
        if not len(left) or not len(right):
            continue
        i, j = candidate_pairs(signatures, key & (2**64 - 1), left, right, s == t)
        if not len(i):
            continue
        partners: dict[int, list[bytes]] = {x: [] for x in np.unique(np.concatenate([i, j])).tolist()}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            partners[a].append(rows[b][4])
        out = [(key, s, t, rows[x][4], p) for x, p in partners.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())), strict=True)],
            ["key", "s", "t", "class", "partners"],
        )


def _sets(batches):
    for batch in batches:
        classes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, part in _text_slices(texts):
            hashes, n = shingle_hashes(part, WORDS)
            sets = [np.unique(own).tobytes() for own in np.split(hashes, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(classes[at : at + len(part)], pa.binary()), pa.array(sets, pa.binary())], ["class", "shingles"])


def _verified(batches):
    """Links of each class within a block pair, and the smallest class that it hangs together with there."""
    for rows in grouped(batches, 3):
        sets, partners = {}, {}
        for r in rows:
            sets[r[3]], partners[r[3]] = np.frombuffer(r[5], np.uint64), r[4]
        names = sorted(sets)
        number = {c: x for x, c in enumerate(names)}
        links, root = np.zeros(len(names), np.int64), list(range(len(names)))

        def find(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, others in partners.items():
            if not others:
                continue
            own = sets[a]
            sizes = np.array([len(sets[b]) for b in others])
            flat = np.concatenate([sets[b] for b in others])
            at = np.searchsorted(own, flat)
            at[at == len(own)] = 0
            shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            x = number[a]
            for k in np.flatnonzero(shared >= SIMILARITY * (len(own) + sizes - shared) - 1e-9).tolist():
                y = number[others[k]]
                links[x] += 1
                links[y] += 1
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
        some = np.flatnonzero(links).tolist()
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[x] for x in some], pa.binary()), pa.array(links[some]), pa.array([names[find(x)] for x in some], pa.binary())],
                ["class", "links", "hub"],
            )


def _equal(a: DataFrame, b: DataFrame, *names: str):
    """Null-safe equality; b's columns have an underscore."""
    on = None
    for x in names:
        one = a[x].eqNullSafe(b[f"{x}_"])
        on = one if on is None else on & one
    return on


def _underscored(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_" for c in df.columns})


def components(edges: DataFrame) -> DataFrame:
    """class, label: the smallest class that can be reached; each round also follows labels of labels."""
    both = stored(edges.unionByName(edges.select(F.col("hub").alias("class"), F.col("class").alias("hub"))).distinct(), "edges")
    labels = stored(both.groupBy("class").agg(F.min("hub").alias("label")).select("class", F.least("class", "label").alias("label")), "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(_underscored(labels), F.col("hub") == F.col("class_")).groupBy("class").agg(F.min("label_").alias("near"))
        new = labels.join(near, "class").select("class", "label", F.least("label", "near").alias("new"))
        jump = _underscored(labels)
        new = stored(new.join(jump, F.col("new") == F.col("class_")).select("class", "label", F.least("new", "label_").alias("new")), f"labels{step}")
        if new.filter("new != label").isEmpty():
            return labels
        labels = new.select("class", F.col("new").alias("label"))


def join_texts(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id, n_links, n_copies, copy_of, own.

    class_id is the smallest doc_id among all that hang together by links or equal shingle sets.  n_links counts
    the different shingle sets within the similarity, n_copies the documents with the same set, copy_of is the
    smallest doc_id of those.  own is the checksum of the text, group names what hangs together.  A text of fewer than five words is one
    shingle; texts without words hang together only where they are equal; a null text stays alone.  Repeated
    rows are copies.  An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))
    members = stored(texts.select("doc_id", "text", "own").mapInArrow(_classes, "doc_id long, own long, class binary, sig binary"), "members")
    classes = members.filter("class is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "own")).alias("first"), F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")
    )
    classes = stored(classes.select("class", F.col("first.doc_id").alias("doc_id"), F.col("first.own").alias("own"), "copy_of", "n_copies", "sig"), "classes")
    signed = classes.filter("sig is not null").select("class", "sig")
    keys = signed.mapInArrow(_bands, "class binary, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bucket = keys.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    bucket = bucket.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    bucket = bucket.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = bucket.select("key", F.least("block", "other").alias("s"), F.greatest("block", "other").alias("t"), "block", "class")
    bucket = bucket.join(signed, "class").select("key", "s", "t", "block", "class", "sig")
    bucket = bucket.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "class")
    pairs = stored(bucket.mapInArrow(_candidates, "key long, s int, t int, class binary, partners array<binary>"), "candidates")
    wanted = pairs.select("class").distinct().join(classes.select("class", "doc_id", "own"), "class")
    source = _underscored(texts)
    found = wanted.join(source, wanted["doc_id"].eqNullSafe(source["doc_id_"]) & (wanted["own"] == source["own_"])).select("class", F.col("text_").alias("text"))
    sets = found.mapInArrow(_sets, "class binary, shingles binary")
    blocks = pairs.join(sets, "class").select("key", "s", "t", "class", "partners", "shingles")
    blocks = blocks.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "class")
    links = stored(blocks.mapInArrow(_verified, "class binary, links long, hub binary"), "links")
    labels = components(links.filter("class != hub").select("class", "hub"))
    per_class = classes.select("class", "copy_of", "n_copies")
    per_class = per_class.join(links.groupBy("class").agg(F.sum("links").alias("n_links")), "class", "left").join(labels, "class", "left")
    per_class = stored(per_class.withColumn("label", F.coalesce("label", "class")), "per_class")
    first = per_class.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    per_class = per_class.join(first, "label").withColumn("group", F.hex("label")).drop("label").withColumnRenamed("class", "class_")
    out = members.select("doc_id", "own", "class").join(per_class, F.col("class") == F.col("class_"), "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        "own",
        "group",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that stay: of each group one with the smallest doc_id, and every null text.

    Of rows of a group that share the smallest doc_id the first by checksum stays.  Other cases as in join_texts.
    """
    first = join_texts(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")) | F.col("group").isNull())
    found = first.select(F.col("doc_id").alias("i"), F.col("own").alias("o"), "group").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    kept = rows.join(found, rows["id"].eqNullSafe(found["i"]) & (rows["own"] == found["o"]))
    nth = Window.partitionBy("group", F.when(F.col("group").isNull(), F.col("id"))).orderBy("own")
    return kept.withColumn("nth", F.row_number().over(nth)).filter("nth = 1 OR group IS NULL").select("row.*")
