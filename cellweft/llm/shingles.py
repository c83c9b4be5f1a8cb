"""Word shingles of whole batches of texts, as 64-bit hashes, by array operations."""

from __future__ import annotations

import numpy as np

from cellweft.llm import pretokens as pt


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text); a word is a run of letters and digits, in lower case."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = pt.char_classes()[points]
    inside = (kind == pt.LETTER) | (kind == pt.DIGIT)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    if len(data) > len(points):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts, ends = lead[starts], lead[ends]
    return pt.span_hashes(data, starts, ends), counts


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles, shingles per text); a text of fewer words has all of them as its one shingle."""
    words, counts = word_hashes(texts)
    total = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        factor = np.uint64(0xFF51AFD7ED558CCD)
        rolled = np.zeros(len(words), np.uint64)
        for j in range(k):  # words beyond the end count nothing
            rolled[: len(words) - j] = rolled[: len(words) - j] * factor + words[j:]
        n = np.maximum(counts - k + 1, np.minimum(counts, 1))
        out = pt.gather(rolled, total[:-1], n)
        short = np.flatnonzero((counts < k) & (counts > 0))
        at = np.cumsum(n) - n
        for i in short.tolist():
            h = np.uint64(counts[i])
            for w in words[total[i] : total[i + 1]]:
                h = h * factor + w
            out[at[i]] = h
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out, n
