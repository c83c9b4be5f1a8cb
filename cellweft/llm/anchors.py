"""Anchors: places that every copy of a string of LENGTH bytes has in common.

An anchor is the k-gram with the smallest hash in a window of LENGTH bytes, the leftmost of equal ones.
Windows with the same bytes have the same anchor at the same offset, and each document of LENGTH bytes or more
has one about every (LENGTH - GRAM) / 2 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from cellweft.llm import pretokens as pt

LENGTH = 50
GRAM = 20
#: Windows whose anchors are found in one go.
BLOCK = 1 << 14


def find(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window start, last window start) of each anchor in texts laid end to end.

    ends are the ends of the texts in data.  The windows of an anchor start from the first to the last start,
    last included; every window of a text belongs to one anchor.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = len(data) - GRAM + 1
    sums, down = pt.running_sums(data)
    width = LENGTH - GRAM + 1
    bits = np.uint64(max(1, int(grams).bit_length()))
    hashes, place = np.empty(grams, np.uint64), np.empty(n, np.int64)
    # block by block, so that what is compared stays in the processor's cache
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK + width - 1, grams)
        with np.errstate(over="ignore"):
            own = pt.mixed((sums[at + GRAM : end + GRAM] - sums[at:end]) * down[at:end])
        hashes[at:end] = own
        least = (own >> bits << bits) | np.arange(at, end, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        size = min(BLOCK, n - at)
        if span < width:
            least = np.minimum(least[:size], least[width - span : width - span + size])
        place[at : at + size] = least[:size] & ((np.uint64(1) << bits) - np.uint64(1))
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= LENGTH
    inside[starts[long]] = 1
    inside[ends[long] - LENGTH + 1] -= 1
    valid = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    place = place[valid]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(new[1:], len(place)) - 1
    return place[new], hashes[place[new]].view(np.int64), valid[new], valid[last]


#: Bytes that are looked at in one go; a longer text is taken in pieces that overlap by LENGTH - 1.
SLICE = 1 << 20


def slices(texts: Iterable[bytes]):
    """(bytes, ends of the pieces, number of each piece's text, offset of each piece in its text)."""
    parts, owners, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            piece = text[at : at + SLICE + LENGTH - 1]
            parts.append(piece)
            owners.append(i)
            offsets.append(at)
            size += len(piece)
            if size >= SLICE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners), np.array(offsets)
                parts, owners, offsets, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners), np.array(offsets)
