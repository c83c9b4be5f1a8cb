"""Mergeable states of columns: counts, nulls, distinct keys and first distinct values.

Each task reads its cells once and keeps, per column, only what can still matter: the first values in row
order, and the distinct keys of the values, packed by parts of the key space.  States of tasks are merged by
part, so no column of any size lies in one task, and no text is shuffled but the first values.

A key is two longs: a whole number in its usual spelling, of up to 18 places, is its own key, other texts have two
hashes; the second is compared where the first is equal.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COL = ["table_id", "col_idx"]
#: Keys that a task holds before it gives them out, and columns.
HELD_KEYS = 1 << 21
HELD_COLUMNS = 1 << 16
#: An odd factor that spreads blocks of 2**16 neighbouring keys over the parts.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
WHOLE = "^(0|-?[1-9][0-9]*)$"
STATE = "table_id string, col_idx int, part int, n_rows long, n_nulls long, repeated boolean, keys binary, firsts array<struct<first_row:bigint,value:string>>"
MERGED = "table_id string, col_idx int, n_rows long, n_nulls long, repeated boolean, n_distinct long, firsts array<struct<first_row:bigint,value:string>>"
FIRSTS = pa.list_(pa.struct([("first_row", pa.int64()), ("value", pa.string())]))
LAST_ROW = np.iinfo(np.int64).max


def with_key(cells: DataFrame) -> DataFrame:
    """Adds _k1 and _k2, two longs that are equal for equal values and differ for others; null for null."""
    value = F.col("value")
    cells = cells.withColumn("_whole", (F.length(value) <= 18) & F.rlike(value, F.lit(WHOLE)))
    # the test keeps the cast from texts that are no number
    first = F.when(F.col("_whole"), value.cast("bigint")).otherwise(F.xxhash64(value))
    second = F.when(F.col("_whole"), F.lit(0)).otherwise(F.xxhash64(F.lit(1), value))
    return cells.withColumns({"_k1": F.when(value.isNotNull(), first), "_k2": second}).drop("_whole")


def pack(first: np.ndarray, second: np.ndarray) -> bytes:
    """Sorted distinct keys: whole numbers as a bitmap or as offsets of the least width, whichever is shorter, others as they are."""
    if second.any():
        return b"\x10" + first.tobytes() + second.tobytes()
    offsets = first.view(np.uint64) - first[:1].view(np.uint64)
    top = int(offsets[-1])
    width = np.min_scalar_type(top).itemsize
    if top // 8 < len(offsets) * width:
        bits = np.zeros(top + 1, bool)
        bits[offsets.astype(np.int64)] = True
        return b"\x00" + first[:1].tobytes() + np.packbits(bits).tobytes()
    return bytes([width]) + first[:1].tobytes() + offsets.astype(f"u{width}").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[0] == 16:
        both = np.frombuffer(data, np.int64, offset=1)
        return both[: len(both) // 2], both[len(both) // 2 :]
    base = np.frombuffer(data, np.uint64, 1, 1)
    if data[0] == 0:
        offsets = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=9))).astype(np.uint64)
    else:
        offsets = np.frombuffer(data, f"u{data[0]}", offset=9).astype(np.uint64)
    return (offsets + base).view(np.int64), np.zeros(len(offsets), np.int64)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts rows by keys, whether a row in that order is the first of its like)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in keys:
            own = key[order]
            new[1:] |= own[1:] != own[:-1]
    return order, new


class TaskState:
    """What a task knows of the columns it has met."""

    def __init__(self, first: int, keys: str | None, parts: int) -> None:
        self.first, self.keys, self.parts = first, keys, parts
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[tuple[str, int], int] = {}
        self.n_rows = self.n_nulls = np.zeros(0, np.int64)
        self.limit = np.zeros(0, np.int64)  # a later row gives no first value
        self.repeated = np.zeros(0, bool)
        self.firsts: list[dict[str, int]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def _code(self, table: str, number: int) -> int:
        """The code of a column; new ones begin with no cells."""
        code = self.codes.setdefault((table, number), len(self.codes))
        if code == len(self.firsts):
            self.firsts.append({})
            if code >= len(self.n_rows):
                more = np.zeros(max(64, code), np.int64)
                self.n_rows, self.n_nulls = np.append(self.n_rows, more), np.append(self.n_nulls, more)
                self.limit = np.append(self.limit, more + LAST_ROW)
                self.repeated = np.append(self.repeated, more.astype(bool))
        return code

    def add_cells(self, batch: pa.RecordBatch) -> None:
        """Rows of table_id, col_idx, row_id, value and, where keys are wanted, the two parts of the key."""
        if not batch.num_rows:
            return
        numbers = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        names = batch.column(0).dictionary_encode()
        width = int(numbers.max()) + 1
        both, at = np.unique(names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + numbers, return_inverse=True)
        texts = names.dictionary.to_pylist()
        code = np.array([self._code(texts[b // width], b % width) for b in both.tolist()], np.int64)[at]
        self._add(code, *(batch.column(i) for i in range(2, batch.num_columns)))

    def add_column(self, table: str, number: int, rows: pa.Array, values: pa.Array, *keys: pa.Array) -> None:
        """The cells of one column; a second part of the key that is left out is 0."""
        code = self._code(table, number)
        if self.keys == "unrepeated" and self.repeated[code] and not self.first:
            self.n_rows[code] += len(rows)  # nothing else is told of it
        else:
            self._add(np.full(len(rows), code), rows, values, *keys)

    def _add(self, code: np.ndarray, rows: pa.Array, values: pa.Array, *keys: pa.Array) -> None:
        null = values.is_null().to_numpy(zero_copy_only=False)
        size = len(self.n_rows)
        self.n_rows += np.bincount(code, minlength=size)
        self.n_nulls += np.bincount(code[null], minlength=size)
        if self.first:
            at = rows.fill_null(LAST_ROW).to_numpy(zero_copy_only=False)
            self._add_firsts(code, at, values, np.flatnonzero(~null & (at <= self.limit[code])))
        if self.keys == "unrepeated":
            self.repeated |= self.n_nulls > 0
            null = null | self.repeated[code]
        if self.keys:
            at = np.flatnonzero(~null)
            first = keys[0].fill_null(0).to_numpy(zero_copy_only=False)[at]
            second = keys[1].fill_null(0).to_numpy(zero_copy_only=False)[at] if len(keys) > 1 else np.zeros(len(at), np.int64)
            self._add_keys(code[at], first, second)

    def _add_firsts(self, code: np.ndarray, rows: np.ndarray, values: pa.Array, at: np.ndarray) -> None:
        if not len(at):
            return
        code, rows, names = code[at], rows[at], values.take(pa.array(at)).dictionary_encode()
        kind = names.indices.to_numpy(zero_copy_only=False)
        order, new = _distinct(code, kind)
        least = np.minimum.reduceat(rows[order], np.flatnonzero(new))
        order = order[new]
        again = np.lexsort((least, code[order]))
        order, least = order[again], least[again]
        own = code[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(np.append(starts, len(own)))
        # rows as late as the last wanted one tie with it
        last = np.repeat(least[starts + np.minimum(sizes, self.first) - 1], sizes)
        keep = least <= last
        texts = names.dictionary.to_pylist()
        for c, row, k in zip(own[keep].tolist(), least[keep].tolist(), kind[order[keep]].tolist(), strict=True):
            held, text = self.firsts[c], texts[k]
            if row < held.get(text, LAST_ROW + 1):
                held[text] = row
        for c in own[starts].tolist():
            if len(self.firsts[c]) >= self.first:
                best = sorted((row, text) for text, row in self.firsts[c].items())[: self.first]
                self.firsts[c] = {text: row for row, text in best}
                self.limit[c] = best[-1][0]

    def _add_keys(self, code: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self._hold(*self._compact(code, first, second))
        if self.n_held > HELD_KEYS:
            self._join_held()

    def _hold(self, *keys: np.ndarray) -> None:
        self.held.append(keys)
        self.n_held += len(keys[0])

    def _compact(self, code: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        order, new = _distinct(code, first, second)
        if self.keys == "unrepeated":
            self.repeated[code[order[~new]]] = True
            new &= ~self.repeated[code[order]]
        own = order[new]
        return code[own], first[own], second[own]

    def _join_held(self) -> None:
        both = [np.concatenate(x) for x in zip(*self.held, strict=True)] if self.held else [np.zeros(0, np.int64)] * 3
        self.held, self.n_held = [], 0
        self._hold(*self._compact(*both))

    def full(self) -> bool:
        return self.n_held > HELD_KEYS // 2 or len(self.codes) > HELD_COLUMNS

    def give(self) -> pa.RecordBatch:
        """All states, a row per column (part -1) and one per column and part of its keys; the task starts anew."""
        self._join_held()
        names = list(self.codes)
        rows = []
        for c, (table, number) in enumerate(names):
            firsts = [{"first_row": row, "value": text} for text, row in self.firsts[c].items()]
            rows.append((table, number, -1, int(self.n_rows[c]), int(self.n_nulls[c]), bool(self.repeated[c]), None, firsts))
        code, first, second = self.held[0]
        if self.keys == "unrepeated":
            keep = ~self.repeated[code]
            code, first, second = code[keep], first[keep], second[keep]
        part = ((first >> 16).view(np.uint64) * SPREAD >> np.uint64(33)).astype(np.int64) % self.parts
        order = np.lexsort((part, code))  # stable: keys of a part stay sorted
        code, part, first, second = code[order], part[order], first[order], second[order]
        cuts = [*np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)).tolist(), len(code)]
        for f, t in itertools.pairwise(cuts):
            rows.append((*names[code[f]], int(part[f]), 0, 0, False, pack(first[f:t], second[f:t]), None))
        self._reset()
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), FIRSTS]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        fields = ["table_id", "col_idx", "part", "n_rows", "n_nulls", "repeated", "keys", "firsts"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], fields)


def _states(first: int, keys: str | None, parts: int):
    """The states of cells."""

    def run(batches):
        state = TaskState(first, keys, parts)
        for batch in batches:
            state.add_cells(batch)
            if state.full():
                yield state.give()
        yield state.give()

    return run


def _table_states(table: str, layout: list[tuple[int, list[int]]], first: int, keys: str | None, parts: int):
    """The states of a table's columns; layout says at which places of a batch a column's value and keys are."""

    def run(batches):
        state = TaskState(first, keys, parts)
        for batch in batches:
            for number, places in layout:
                state.add_column(table, number, batch.column(0), *(batch.column(i) for i in places))
            if state.full():
                yield state.give()
        yield state.give()

    return run


def _merged(first: int):
    """The sum of all states of a column and part, which come one after the other."""

    def joined(parts):
        both = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order, new = _distinct(*both)
        return (both[0][order[new]], both[1][order[new]]), not new.all()

    def run(batches):
        out, name, sums, repeated, held, waiting, firsts = [], None, [0, 0], False, [], 0, {}

        def closed():
            keys, again = joined(held) if held else ((np.zeros(0, np.int64),) * 2, False)
            best = sorted((row, text) for text, row in firsts.items())[:first]
            shown = [{"first_row": row, "value": text} for row, text in best] if name[2] == -1 else None
            out.append((name[0], name[1], *sums, repeated or again, len(keys[0]), shown))

        for batch in batches:
            for *own, n_rows, n_nulls, again, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if name is not None:
                        closed()
                    name, sums, repeated, held, waiting, firsts = own, [0, 0], False, [], 0, {}
                sums = [sums[0] + n_rows, sums[1] + n_nulls]
                repeated |= again
                for x in values or ():
                    firsts[x["value"]] = min(x["first_row"], firsts.get(x["value"], LAST_ROW))
                if keys is not None:
                    held.append(unpack(keys))
                    waiting += len(held[-1][0])
                    if waiting > 2 * len(held[0][0]) + HELD_KEYS:  # what is held stays near what is different
                        one, again = joined(held)
                        held, waiting, repeated = [one], len(one[0]), repeated or again
                if len(firsts) > 64 * first + 64:
                    firsts = {text: row for row, text in sorted((row, text) for text, row in firsts.items())[:first]}
            if out:
                yield _merged_batch(out)
                out = []
        if name is not None:
            closed()
            yield _merged_batch(out)

    return run


def _merged_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), FIRSTS]
    fields = ["table_id", "col_idx", "n_rows", "n_nulls", "repeated", "n_distinct", "firsts"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)


def typed_key(value: Column, data_type: T.DataType) -> list[Column]:
    """One long where a type's values fit one, else two hashes of the text."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return [value.cast("bigint")]
    if isinstance(data_type, T.DecimalType) and data_type.precision <= 18:
        return [(value * F.lit(10**data_type.scale)).cast("bigint")]
    text = value.cast("string")
    return [F.when(text.isNotNull(), F.xxhash64(text)), F.xxhash64(F.lit(1), text)]


def table_states(df: DataFrame, table_id: str, row_id: Column, values: Mapping[int, Column], first: int = 0, keys: str | None = "all") -> DataFrame:
    """The states of one wide table's columns, by col_idx, for merged_states: its rows are read as they are, without an unpivot."""
    fields, layout = [row_id.cast("bigint").alias("_row")], []
    types = [f.dataType for f in df.select(*[v.alias(f"_{i}") for i, v in values.items()]).schema]
    for (number, value), data_type in zip(values.items(), types, strict=True):
        own = typed_key(value, data_type) if keys else []
        shown = [value.cast("string")] if first or not keys else []
        at = list(range(len(fields), len(fields) + len(shown) + len(own)))
        fields += [place.alias(f"_f{i}") for i, place in zip(at, [*shown, *own], strict=True)]
        # the text is sent for first values only, else the key tells what is null
        layout.append((number, at if shown else [at[0], *at]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*fields).mapInArrow(_table_states(table_id, layout, first, keys, parts), STATE)


def column_states(cells: DataFrame, first: int = 0, keys: str | None = "all") -> DataFrame:
    """merged_states of cells(table_id, row_id, col_idx, value)."""
    read = cells.select(F.col("table_id").cast("string"), F.col("col_idx").cast("int"), F.col("row_id").cast("bigint"), F.col("value").cast("string"))
    read = with_key(read) if keys else read
    if not first:  # the text itself is not sent, only whether it is null
        read = read.withColumn("value", F.when(F.col("value").isNotNull(), F.lit("")))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged_states(read.mapInArrow(_states(first, keys, parts), STATE), first)


def merged_states(states: DataFrame, first: int = 0) -> DataFrame:
    """table_id, col_idx, n_rows, n_nulls, repeated, n_distinct, firsts of each column that has cells.

    firsts are its first distinct values, `first` of them, by the first row they are in, then by text.  With keys "all"
    n_distinct counts the distinct values.  With "unrepeated" only `repeated` is told, whether the column has a null or a value twice;
    a task that finds either forgets the column's keys.  Without keys neither is told (n_distinct is 0).
    """
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = [*COL, "part"]
    merged = states.repartition(parts, *name).sortWithinPartitions(*name).mapInArrow(_merged(first), MERGED)
    return merged.groupBy(*COL).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.bool_or("repeated").alias("repeated"),
        F.sum("n_distinct").alias("n_distinct"),
        F.first("firsts", ignorenulls=True).alias("firsts"),
    )
