"""Conversation structure repair by a lightest-derivation agenda.

Role initials of a repaired conversation read (s?(ua)+)?.  A repair is a derivation in a weighted deduction
system, a hypergraph whose nodes are items:

    row j        the row's first fault and role, an axiom of weight (0, '')
    at j, q      the rows before j are edited and the output stands in state q
    goal         all rows are edited and the output may end

    at j q, row j  |-  at j+1 q'    keep (0, 'K') or rerole (2, 'R'), unless the fault forbids it; 1 more if truncated
    at j q, row j  |-  at j+1 q     delete (3, 'D')
    at j q         |-  at j q'      insert (2, 'I')
    at n q         |-  goal         in a state that may end

A weight is (cost, audit); a deduction adds its cost and appends its letter.  Each is superior, as the result is
greater than both antecedents, and monotone, as audits of one item and one cost are never prefixes of each
other: so items popped from the agenda in order of weight are final, and the goal's weight is the lightest.

A conversation of more than BLOCK rows is edited block by block: the final weights at a block's end are the axioms of the
next, states that can no longer be part of a lightest derivation go, and what all others have in common is settled; rows
whose edits are settled are given out and let go.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Faults in order of precedence, the costs of edits, the roles that edits can give.
CLEAN, BLANK, DUPLICATE, TRUNCATED = "", "blank", "duplicate", "truncated"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
ROLES = {"u": "user", "a": "assistant"}
#: States of the output: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MAY_END = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
BLOCK = 256
#: Rows that are taken from a batch before results are given out.
AT_ONCE = 4096
SOLID = regex.compile(r"[^\x20\x09-\x0D]")

Weight = tuple[int, str]


def wanted(state: int) -> str:
    """The initial that a rerole or an insert gives in a state; no other is legal there."""
    return "a" if state == USER else "u"


def deduce(rows: list[tuple[str, str]], axioms: dict[int, Weight], to_goal: bool) -> dict[int, Weight]:
    """Final weights at the end of rows (initial, fault) from those at their start.

    With to_goal the one entry is that of the goal, by its state; else there is one per state that can be reached.
    """
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    done: set[tuple[int, int]] = set()
    out: dict[int, Weight] = {}
    while agenda:
        cost, audit, j, state = heapq.heappop(agenda)
        if (j, state) in done:
            continue
        done.add((j, state))
        if j == len(rows):
            if not to_goal:
                out[state] = cost, audit
            elif state in MAY_END:
                return {state: (cost, audit)}
        role = wanted(state)
        heapq.heappush(agenda, (cost + COST["I"], audit + "I", j, NEXT[state, role]))
        if j < len(rows):
            initial, fault = rows[j]
            heapq.heappush(agenda, (cost + COST["D"], audit + "D", j + 1, state))
            if fault in (CLEAN, TRUNCATED):
                more = cost + (fault == TRUNCATED)
                kept = NEXT.get((state, initial))
                if kept is not None:
                    heapq.heappush(agenda, (more + COST["K"], audit + "K", j + 1, kept))
                if initial != role:
                    heapq.heappush(agenda, (more + COST["R"], audit + "R", j + 1, NEXT[state, role]))
    return out


def still_open(weights: dict[int, Weight]) -> dict[int, Weight]:
    """The states that can be part of a lightest derivation.

    After an assistant row all that may follow a system row may follow, and all that may follow nothing but a
    system row, whose deletion costs 3; inserts lead to the other states.
    """
    cost = weights[ASSISTANT][0]
    slack = {START: COST["D"], SYSTEM: 0, USER: COST["I"], ASSISTANT: 0}
    return {q: w for q, w in weights.items() if w[0] <= cost + slack[q]}


class Conversation:
    """Takes the rows of a conversation in order, and gives out repaired rows as soon as they are settled."""

    def __init__(self, key, emit: Callable[[str, str, str], None] | None = None) -> None:
        self.key, self.emit = key, emit
        self.turns: set[int] = set()
        self.low = self.high = None
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = 0
        self.last: str | None = None
        self.seen: set[bytes] = set()
        self.block: list[tuple[str, str]] = []
        self.waiting: list[tuple[str, str]] = []  # rows whose edits are not settled
        self.weights: dict[int, Weight] = {START: (0, "")}
        self.audit: list[str] = []
        self.state, self.hash, self.first = START, hashlib.sha256(), True

    def _fault(self, role: str, text: str) -> str:
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        solid = SOLID.search(text)
        if not solid:
            fault = BLANK
        elif name in self.seen:
            fault = DUPLICATE
        else:
            end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1]
            fault = CLEAN if end in ".!?" else TRUNCATED
        self.seen.add(name)
        return fault

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns.add(turn)
            self.low = turn if self.low is None else min(self.low, turn)
            self.high = turn if self.high is None else max(self.high, turn)
        initial, fault = role[:1], self._fault(role, text)
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if len(self.block) == BLOCK:
            self._close_block()
        self.block.append((initial, fault))
        self.waiting.append((role, text))

    def _close_block(self) -> None:
        self.weights = still_open(deduce(self.block, self.weights, False))
        self.block = []
        same = commonprefix([audit for _, audit in self.weights.values()])
        self.weights = {q: (cost, audit[len(same) :]) for q, (cost, audit) in self.weights.items()}
        self._settle(same)

    def _settle(self, edits: str) -> None:
        at = 0
        for edit in edits:
            if edit == "D":
                at += 1
                continue
            role, text = ("", "") if edit == "I" else self.waiting[at]
            at += edit != "I"
            if edit != "K":
                role = ROLES[wanted(self.state)]
            self.state = NEXT[self.state, role[:1]]
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
            if self.emit:
                self.emit(role, text, edit)
        del self.waiting[:at]
        self.audit.append(edits)

    def report(self) -> tuple:
        """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); no row may follow."""
        ((cost, audit),) = deduce(self.block, self.weights, True).values()
        self._settle(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - len(self.turns)
        return (self.key, gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def row_key() -> Column:
    """conv_id:turn as text, nulls as one space."""
    return F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of their key; a row that is dropped stays with alive = false, for its conv_id."""
    kind = F.crc32(row_key().cast("binary")) % 20
    rows = as_rows(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumns({"text": text, "role": role, "alive": F.col("kind") != 0, "copy": times})
    return rows.select("conv_id", "turn", "role", "text", "alive", F.explode("copy").alias("copy"))


def as_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive, with null roles and texts as one space."""
    own = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *own, F.lit(True).alias("alive"))


def _ordered(rows: DataFrame) -> DataFrame:
    rows = rows.select("conv_id", "turn", "role", "text", "alive")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], emit: Callable | None = None) -> Iterator[Conversation | None]:
    """The conversations of a task, each when all its rows are taken, and None after every AT_ONCE rows."""
    held: Conversation | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            for key, turn, role, text, alive in zip(*(c.to_pylist() for c in batch.slice(start, AT_ONCE).columns), strict=True):
                if held is None or held.key != key:
                    if held is not None:
                        yield held
                    held = Conversation(key, emit and emit(key))
                if alive:
                    held.add(turn, role, text)
            yield None
    if held is not None:
        yield held


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches):
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(REPORT))

    out = []
    for conversation in _conversations(batches):
        if conversation:
            out.append(conversation.report())
        elif out:
            yield of(out)
            out = []
    if out:
        yield of(out)


def _repaired_rows(batches):
    out: list[tuple] = []

    def of():
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "position", "role", "text", "edit"])

    def sink(key):
        at = iter(range(1 << 62))
        return lambda role, text, edit: out.append((key, next(at), role, text, edit))

    for conversation in _conversations(batches, sink):
        if conversation:
            conversation.report()
        elif out:
            yield of()
    if out:
        yield of()


def reports(rows: DataFrame) -> DataFrame:
    """A row per conv_id: faults, the cost and audit of the lightest repair, and the digest of what it gives.

    rows hold conv_id, turn, role, text as of as_rows or damaged.  Null roles and texts are one space, which no
    repair keeps; null turns come first; rows of one turn are taken by role, then text; repeated rows are duplicates.  A null
    conv_id is a conversation.  Texts of any length are only hashed and looked at by their ends.  An empty table gives
    no rows; other columns are not read.  A conversation goes through one task, as its one digest asks for, but as a
    stream: no more than its unsettled rows, and a short digest per row, are held.
    """
    return _ordered(rows).mapInArrow(_reports, REPORT_SCHEMA)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the rows of the lightest repair of each conversation, inserted ones with empty text.

    Cases as in reports; conversations that lose all rows are not in it.
    """
    return _ordered(as_rows(conversations)).mapInArrow(_repaired_rows, "conv_id long, position long, role string, text string, edit string")
