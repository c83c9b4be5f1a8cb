import hashlib
import itertools
import random
import re
import zlib

import pytest

from cellweft.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        out.append(fault)
        seen.add((role, text))
    return out


def lightest(rows):
    """(cost, audit, repaired rows) of the lightest of all edits with up to two inserts between rows."""
    faults = faults_of(rows)
    inserts = [(), (("I", "user", ""),), (("I", "assistant", ""),), (("I", "user", ""), ("I", "assistant", "")), (("I", "assistant", ""), ("I", "user", ""))]
    choices = [inserts]
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [(("D", None, None),)]
        if fault in ("", "truncated"):
            own += [(("K", role, text),), (("R", "user", text),), (("R", "assistant", text),)]
        choices += [own, inserts]
    best = None
    for picked in itertools.product(*choices):
        edits = [e for part in picked for e in part]
        out = [(r, t) for _, r, t in edits if r is not None]
        if not LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            continue
        kept = [p[0][0] for p in picked[1::2]]
        cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e, *_ in edits) + sum(f == "truncated" and k != "D" for k, f in zip(kept, faults, strict=True))
        found = (cost, "".join(e for e, *_ in edits), out)
        best = found if best is None or found[:2] < best[:2] else best
    return best


def through(rows, block=None):
    old, repair.BLOCK = repair.BLOCK, block or repair.BLOCK
    try:
        out = []
        conversation = repair.Conversation(1, lambda role, text, edit: out.append((role, text)))
        for i, (role, text) in enumerate(rows):
            conversation.add(i, role, text)
        return conversation.report(), out
    finally:
        repair.BLOCK = old


def drawn(rng, n, roles=("user", "assistant", "system", " ", "tool", "")):
    texts = ["", " ", "a.", "b!", "open", "c? \n", "d"]
    return [(rng.choice(roles[: rng.choice([2, 3, len(roles)])]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(n)]


def test_agenda_finds_the_lightest_of_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = drawn(rng, rng.randrange(4))
        cost, audit, out = lightest(rows)
        got, given = through(rows)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        assert (got[6], got[7], given) == (cost, audit, out)
        assert got[8] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_change_nothing(block):
    rng = random.Random(block)
    for _ in range(60):
        rows = drawn(rng, rng.randrange(40))
        assert through(rows, block) == through(rows, 10**6)


def test_a_very_long_conversation_is_settled_on_the_way():
    conversation = repair.Conversation(1)
    for i in range(20_000):
        conversation.add(i, "user" if i % 2 == 0 or i % 97 == 0 else "assistant", f"text {i}.")
        assert len(conversation.waiting) <= 3 * repair.BLOCK
    assert len(conversation.report()[7]) >= 20_000


def expected(rows):
    """Reports of damaged (conv_id, turn, role, text) rows, by the brute force above."""
    found: dict = {}
    for conv_id, turn, role, text in rows:
        found.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found[conv_id] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain = [r[1:] for r in own]
        faults = faults_of(plain)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(plain))
        cost, audit, kept = lightest(plain)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_reports_over_damaged_rows(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([*range(6), None]), *r) for c in [*range(80), None] for r in drawn(rng, rng.randrange(1, 4))]
    rows += [(500, t, None, None) for t in (1, 9)] + [(501, 2, "user", "x" * 200_000 + "."), (501, 3, "user", "same."), (501, 3, "user", "same.")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS alive", "'x' AS copy", "2 AS kind").repartition(7)
    got = repair.reports(repair.damaged(frame))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_registered_query_against_all_edits(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    small = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in rows) <= 3}
    want = expected([r for r in rows if r[0] in small])
    got = [tuple(r) for r in queries.reg.queries["op12_conversation_repair"](spark, data).collect()]
    assert len(got) == len({r[0] for r in rows})
    assert sorted((r for r in got if r[0] in small), key=repr) == want


def test_repaired_rows_are_legal_and_hash_to_the_report(spark):
    rng = random.Random(3)
    rows = [(c, t, *r) for c in range(40) for t, r in enumerate(drawn(rng, rng.randrange(30)))]
    frame = spark.createDataFrame(rows, SCHEMA)
    sums = {r.conv_id: r for r in repair.reports(repair.as_rows(frame)).collect()}
    out: dict = {}
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: (r.conv_id, r.position)):
        out.setdefault(r.conv_id, []).append(r)
    for conv_id, report in sums.items():
        own = out.get(conv_id, [])
        assert LEGAL.fullmatch("".join(r.role[:1] for r in own))
        assert "".join(r.edit for r in own) == report.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == report.repaired_sha256


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.reports(repair.damaged(empty)).collect() == [] and repair.repaired(empty).collect() == []
