"""Splitting texts before byte-pair merges, for a whole batch of texts at once.

The split is that of the public pattern (contractions, letter runs, digit runs, other runs, each with one
space in front, and white space).  It depends on character classes alone, so it is done with array
operations over all characters of a batch instead of a search per token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, DIGIT, SPACE = range(4)
#: Characters that are split in one go; a longer text is cut where the split is sure to fall.
SLICE = 1 << 20
#: The endings that the public pattern splits off after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: An odd factor of the rolling hash, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Where the split is sure to fall: before a word with its space, and after a run of letters or digits where something else than a space comes.
BEFORE_WORD = regex.compile(r"(?<=\S)(?= \p{L})")
SURE_CUT = regex.compile(r"(?<=\S)(?= \p{L})|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    step = 0x800  # surrogates, which are no characters, are one step
    for low in range(0, len(table), step):
        if low != 0xD800:
            some = "".join(map(chr, range(low, low + step)))
            for value, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for run in regex.finditer(pattern, some):
                    table[low + run.start() : low + run.end()] = value
    return table


def pieces(texts: Iterable[str], size: int | None = None, cuts: regex.Pattern = SURE_CUT) -> Iterator[tuple[int, str]]:
    """(number of the text, piece): texts of up to size characters whole, longer ones in pieces."""
    size = size or SLICE
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > size and (cut := cuts.search(text, at + size)):
            yield row, text[at : cut.start()]
            at = cut.start()
        yield row, text[at:] if at else text


def slices(texts: Iterable[str], size: int | None = None, cuts: regex.Pattern = SURE_CUT) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces gathered until they hold size characters or more, SLICE where none is given."""
    size = size or SLICE
    rows, parts, held = [], [], 0
    for row, piece in pieces(texts, size, cuts):
        rows.append(row)
        parts.append(piece)
        held += len(piece)
        if held >= size:
            yield rows, parts
            rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def split(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all parts, the byte where each token starts (and the end), tokens per part."""
    joined = "".join(parts)
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    n = len(points)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(parts), np.int64)
    first = np.zeros(n + 1, bool)
    first[ends - lengths] = True
    first[n] = True  # what follows the last character is another text
    first, follows_end = first[:n], first[1:]
    kind = char_classes()[points]
    before = np.empty_like(kind)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    blank = points == 32
    after_blank = np.empty(n, bool)
    after_blank[0], after_blank[1:] = False, blank[:-1]
    after_blank &= ~first
    space = kind == SPACE
    before_text = np.empty(n, bool)
    before_text[-1], before_text[:-1] = False, ~space[1:]
    before_text &= ~follows_end
    start = (before != kind) & (space | ~after_blank)
    start |= space & before_text
    _split_contractions(points, start, first)
    lead = np.flatnonzero((data & 0xC0) != 0x80) if len(data) > n else None
    marks = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(marks, np.concatenate([[0], ends])))
    at = lead[marks] if lead is not None else marks
    return data, np.append(at, len(data)), counts


def _split_contractions(points: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Where a token starts with an apostrophe and an ending follows, the token ends after it."""
    n = len(points)
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    one = points[at + 1]
    short = at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]
    rest = at[at + 2 < n]
    rest = rest[~first[rest + 2]]
    long = np.zeros(len(rest), bool)
    for a, b in LONG_ENDINGS:
        long |= (points[rest + 1] == ord(a)) & (points[rest + 2] == ord(b))
    for found, length in ((short, 2), (rest[long], 3)):
        for k in range(1, length):
            start[found + k] = False
        after = found + length
        start[after[after < n]] = True


_kept_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of FACTOR and of INVERSE; one table of each is kept, the longest so far."""
    if len(_kept_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((FACTOR, INVERSE)):
                p = np.full(n + n // 4, base, np.uint64)
                p[0] = 1
                _kept_powers[i] = np.multiply.accumulate(p)
    return _kept_powers


def token_hashes(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes."""
    return span_hashes(data, marks[:-1], marks[1:])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum over all bytes."""
    sums, down = running_sums(data)
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * down[starts])


def running_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the span a to b, b not included, has the hash mixed((sums[b] - sums[a]) * down[a])."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        own = sums[1:]
        own[:] = data
        own += np.uint64(1)
        own *= up[: len(data)]
        np.cumsum(own, out=own)
    return sums, down


def mixed(own: np.ndarray) -> np.ndarray:
    """The numbers with their bits mixed, in place."""
    with np.errstate(over="ignore"):
        own ^= own >> np.uint64(32)
        own *= np.uint64(0xD6E8FEB86659FD93)
        own ^= own >> np.uint64(29)
    return own


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def distinct(data: np.ndarray, marks: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first token of each kind, kind of each token); kinds are equal byte strings.

    Tokens are grouped by hash, then compared byte for byte with the first of their group.  Should two
    strings ever share a hash, every token becomes a kind of its own.
    """
    kind, found = pd.factorize(hashes)
    place = np.empty(len(found), np.int64)
    place[kind[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    starts, lengths = marks[:-1], np.diff(marks)
    if (lengths != lengths[place][kind]).any() or (gather(data, starts[place][kind], lengths) != data[marks[0] : marks[-1]]).any():
        return np.arange(len(starts)), np.arange(len(starts))
    return place, kind
