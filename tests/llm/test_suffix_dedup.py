"""Suffix dedup against a table of all strings of 50 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np

from cellweft.llm import anchors, suffix_dedup


def brute(rows):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for i in range(len(raw) - 49):
                s = raw[i : i + 50]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if doc_id is not None else 0):
            if first[raw[i : i + 50]] < doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def samples(seed=1):
    rng = random.Random(seed)
    alphabet = ["ab", "é", "cd e", "\n", "x", "0", "日", " the "]
    passages = ["".join(rng.choices(alphabet, k=rng.randint(20, 200))) for _ in range(15)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    texts += [None, "", "a" * 500, "a" * 49, "a" * 50, "b" * 51, "ab" * 100, "ab" * 99, texts[0], texts[0], "\0" * 60, "\0" * 70, "x\0" * 60]
    rng.shuffle(texts)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[3]), (rows[5][0], texts[7]), (rows[9][0], texts[9])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, crc int, run string").repartition(5)


def test_against_all_strings(spark, monkeypatch):
    rows = samples()
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    got = suffix_dedup.dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert suffix_dedup.dedup(frame(spark, []).filter("false")).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    text = "".join(random.Random(4).choices("abcdé ", k=900)).encode()
    ends = np.array([len(text)])

    def windows():
        out = {}
        for data, ends, owners, offsets in anchors.slices([text]):
            place, h, a, b = anchors.find(data, ends)
            piece = np.searchsorted(ends, a, side="right")
            shift = offsets[piece] - (ends - np.diff(ends, prepend=0))[piece]
            for x, lo, hi, s in zip(h, a, b, shift):
                out |= {w + s: x for w in range(lo, hi + 1)}
        return out

    whole = windows()
    assert sorted(whole) == list(range(len(text) - 49)) and ends[0]
    monkeypatch.setattr(anchors, "SLICE", 100)
    assert windows() == whole


def test_groups_are_equal_prefixes():
    text = np.array([*b"abracadabra-abracadabra-abrac", 0], np.int64)
    order = suffix_dedup.sorted_suffixes(text)
    new = suffix_dedup.shared_prefixes(text, order, 5)
    double = np.concatenate([text, text])
    strings = [tuple(double[i : i + 5]) for i in order]
    assert new.tolist() == [True, *(a != b for a, b in zip(strings[:-1], strings[1:]))]


def test_text_left(spark):
    long = "é" * 40
    rows = [(1, long), (2, "x" + long + "y"), (3, None)]
    left = {r["doc_id"]: r["left"] for r in suffix_dedup.dedup(frame(spark, rows), with_text=True).collect()}
    assert left == {1: long, 2: "xy", 3: None}


def test_frequent_anchors_are_not_brought_to_one_task(spark, monkeypatch):
    rng = random.Random(8)
    line = "the same forty bytes stand in every text"
    rows = samples(2) + [(1000 + i, "".join(rng.choices("abc ", k=40)) + line + "".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(2000 + i, "-" * 70 + line * (i % 3)) for i in range(40)]
    whole, large = suffix_dedup._removed, spark.sparkContext.accumulator(0)
    for hot in (30, 2):

        def counted(batches, hot=hot):
            times = Counter()

            def seen():
                for batch in batches:
                    for h, docs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                        times[h] += len(docs) // 8
                    yield batch

            yield from whole(seen())
            large.add(sum(n >= hot for n in times.values()))

        monkeypatch.setattr(suffix_dedup, "LEAST_HOT", hot)
        monkeypatch.setattr(suffix_dedup, "MOST_HOT", hot)
        monkeypatch.setattr(suffix_dedup, "_removed", counted)
        got = suffix_dedup.dedup(frame(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert large.value == 0


def test_packed_runs_of_any_length():
    rng = np.random.default_rng(2)
    docs, sums = rng.integers(0, 3, 200), rng.integers(0, 2, 200)
    first = rng.integers(0, 400_000, 200)
    last = first + rng.integers(1, 150_000, 200)
    rows = suffix_dedup._packed(docs, sums, first, last).to_pylist()
    assert len(rows) == len(set(zip(docs.tolist(), sums.tolist(), strict=True)))
    for row in rows:
        own = (docs == row["doc_id"]) & (sums == row["crc"])
        want = np.zeros(700_000, bool)
        for a, b in zip(first[own], last[own], strict=True):
            want[a : b - 1 + suffix_dedup.LENGTH] = True
        assert (suffix_dedup._covered([row["runs"]], len(want)) == want).all()
    none = np.zeros(0, np.int64)
    assert suffix_dedup._packed(none, none, none, none).num_rows == 0 and not suffix_dedup._covered(None, 5).any()


def test_intervals_are_extended_from_what_the_sort_knows():
    """From the ranks of 28 symbols as from single symbols, in 22 steps; anchors block by block as in one go."""
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 5, 400)
    text = np.concatenate([np.concatenate([passage[a : a + n], [0]]) for a, n in rng.integers(20, 300, (60, 2)) % 350 + 1]).astype(np.int64)
    order, ranks, value = suffix_dedup.ranked_suffixes(text)
    assert value == 28
    whole = suffix_dedup.shared_prefixes(text, order)
    assert (suffix_dedup.shared_prefixes(text, order, known=(ranks, value)) == whole).all() and 1 < whole.sum() < len(text)
    data = rng.integers(97, 100, 3 * anchors.BLOCK + 77).astype(np.uint8)
    place, hashes, first, last = anchors.find(data, np.array([len(data)]))
    assert first[0] == 0 and last[-1] == len(data) - anchors.LENGTH and (first[1:] == last[:-1] + 1).all()
    for cut in range(0, len(data) - 5000, 5000):  # windows that lie in a piece have the same anchors there
        piece = data[cut : cut + 5000]
        own, h, a, _ = anchors.find(piece, np.array([len(piece)]))
        assert (h == hashes[np.searchsorted(first, a + cut, side="right") - 1]).mean() > 0.99
        assert set((own[1:-1] + cut).tolist()) <= set(place.tolist())
