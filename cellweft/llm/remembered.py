"""Ids of byte strings that a task has met lately, found by arrays instead of one lookup per string."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from cellweft.llm import pretokens as pt

#: Bytes of strings that are held at most, but for those of one call.
TEXT_LIMIT = 1 << 26
#: (flat ids, ids per string) of strings of so many bytes.
Encode = Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype) -> None:
        self.data, self.size = np.zeros(1024, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            data = np.zeros(max(self.size + len(more), len(self.data) * 3 // 2), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)


class Remembered:
    """Encodes each different string once, until more than `limit` are held; then it starts anew.

    Strings are found by a 64-bit hash in a sorted array, then compared byte for byte; one that shares its hash
    with another is encoded whenever it is met.
    """

    def __init__(self, ids_of: Encode, limit: int, sizes_of_ids: np.ndarray | None = None, bytes_of_ids: np.ndarray | None = None) -> None:
        self.ids_of, self.limit = ids_of, limit
        self.token_sizes, self.token_bytes = sizes_of_ids, bytes_of_ids
        self.forget()

    def forget(self) -> None:
        # the index: sorted hashes and the string of each
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = 0
        self.text, self.text_starts, self.text_sizes = Growing(np.uint8), Growing(np.uint32), Growing(np.uint32)
        self.flat, self.starts, self.sizes, self.sound = Growing(np.uint32), Growing(np.uint32), Growing(np.uint32), Growing(bool)

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers that new strings get."""
        text = pt.gather(data, starts, sizes)
        raw, ends = text.tobytes(), np.cumsum(sizes)
        ids, per = self.ids_of([raw[a:b].decode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], sizes)
        number = np.arange(self.n, self.n + len(sizes), dtype=np.int32)
        self.n += len(sizes)
        self.sound.append(self._spelled(ids, per, text, sizes))
        self.text_starts.append(self.text.size + ends - sizes)
        self.text_sizes.append(sizes)
        self.text.append(text)
        self.starts.append(self.flat.size + np.cumsum(per) - per)
        self.sizes.append(per)
        self.flat.append(ids)
        names, at = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, names)
        fresh = np.append(self.hashes, np.uint64(0))[place] != names
        fresh |= place == len(self.hashes)
        place, names, at = place[fresh], names[fresh], at[fresh]
        self.hashes, self.row = np.insert(self.hashes, place, names), np.insert(self.row, place, number[at])
        return number

    def _spelled(self, ids: np.ndarray, per: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the bytes of a string's ids are those of the string, where the bytes of ids are known."""
        if self.token_sizes is None:
            return np.ones(len(sizes), bool)
        own = self.token_sizes[ids]
        edges = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(per)])]
        same = np.diff(edges) == sizes
        starts = np.concatenate([[0], np.cumsum(self.token_sizes)])[ids]
        spelled = pt.gather(self.token_bytes, starts, own)
        good = np.flatnonzero(same)
        if len(good):
            differ = pt.gather(spelled, edges[good], sizes[good]) != pt.gather(text, (np.cumsum(sizes) - sizes)[good], sizes[good])
            wrong = np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], np.cumsum(sizes[good])])]
            same[good] = np.diff(wrong) == 0
        return same

    def rows(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The number of each string data[marks[i] : marks[i + 1]]."""
        hashes = pt.token_hashes(data, marks)
        place, kind = pt.distinct(data, marks, hashes)
        if self.n > self.limit or self.text.size > TEXT_LIMIT:
            self.forget()
        hashes, starts, sizes = hashes[place], marks[:-1][place], np.diff(marks)[place]
        row = np.full(len(place), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            found = self.row[at[hit]]
            same = self.text_sizes.data[found] == sizes[hit]
            hit, found = hit[same], found[same]
            differ = pt.gather(self.text.data, self.text_starts.data[found].astype(np.int64), sizes[hit]) != pt.gather(data, starts[hit], sizes[hit])
            if differ.any():
                wrong = np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], np.cumsum(sizes[hit])])]
                same = np.diff(wrong) == 0
                hit, found = hit[same], found[same]
            row[hit] = found
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = self._learn(data, starts[new], sizes[new], hashes[new])
        return row[kind]

    def encode(self, data: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all strings, ids per part of so many strings, and whether the bytes of a part's ids are the part's."""
        if len(marks) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64), np.ones(len(counts), bool)
        row = self.rows(data, marks)
        per = self.sizes.data[row].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(per)])[edge]
        bad = np.concatenate([[0], np.cumsum(~self.sound.data[row])])[edge]
        return pt.gather(self.flat.data, self.starts.data[row].astype(np.int64), per), np.diff(total), np.diff(bad) == 0
