import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cellweft.llm import alignment, queries
from cellweft.llm import pretokens as pt

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def tokens_of(text):
    """(id, bytes) lists of both libraries on the whole text, without the operator's tables."""
    a = Tokenizer.from_file(PATHS[0]) if not hasattr(tokens_of, "a") else tokens_of.a
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]) if not hasattr(tokens_of, "b") else tokens_of.b
    a.encode_special_tokens = True
    tokens_of.a, tokens_of.b = a, b
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    point = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    ours = [(i, bytes(point[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    theirs = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return ours, theirs


def expected(rows):
    found, holders = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ours, theirs = tokens_of(text)
            want = (" " + text).encode()
            if b"".join(x for _, x in ours) == want == b"".join(x for _, x in theirs):
                ends = [list(np.cumsum([len(x) for _, x in side])) for side in (ours, theirs)]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in common]
                for side in (0, 1):
                    at = 0
                    for (i, _), end in zip((ours, theirs)[side], ends[side], strict=True):
                        while common[at] < end:
                            at += 1
                        groups[at][side].append(i)
        found.append((doc_id, groups))
        holders.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, groups in found:
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), digest))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox", "The  quick\n\nbrown\tfox ", " lead", "trail ", "   ", "\n", " \n \n", "a", "", None, "naïve café 中文字符",
    "<|endoftext|> and </s> <s> <unk> <0x41>", "piece ▁ mark", "\U0001f600\U0001f600 ok", "----------------========", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 9,
    "x\x00y", " 　 wide", "don't we'll I'M", "12345678 90", "tab\tand\r\nline", "é ﬁ Ω", "The quick brown fox",
]


def check(spark, rows):
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(5), *PATHS).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_against_plain_loops_over_whole_texts(spark):
    check(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")])


def test_slices_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = [*"The quick brown fox; jumps over\n the lazy dog 12,345 été == ---".split(" "), "  ", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(200)))) for i in range(12)]
    for name, value in (("SLICE_PAIRS", 40), ("AT_ONCE", 7), ("REMEMBERED", 10)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(pt, "SLICE", 100)
    want = expected(rows)
    docs = list(alignment.aligned([t for _, t in rows], *PATHS))
    assert [(d.n_a, d.n_b, d.n_groups, d.n_links) for d in docs] == [r[1:5] for r in sorted(want)]
    assert [d.hash.hexdigest() if d.n_a else "" for d in docs] == [r[-1] for r in sorted(want)]


def test_products_and_overlaps():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((5, 7), (7, 4)))
        left, right = (alignment.csr(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y))
        old, alignment.AT_ONCE = alignment.AT_ONCE, int(rng.integers(1, 6))
        blocks = list(alignment.products(left, right))
        alignment.AT_ONCE = old
        out, at = np.zeros((5, 4), np.int64), 0
        for b in blocks:
            out[alignment._rows(b) + at, b.columns] = b.values
            at += len(b.starts) - 1
        assert at == 5 and (out == x @ y).all()
        ends = [np.append(np.flatnonzero(rng.random(20) < 0.3) + 1, 21) for _ in range(2)]
        got = alignment.overlaps(*ends)
        cuts = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        want = {(i, j): min(b, d) - max(a, c) for i, (a, b) in enumerate(cuts[0]) for j, (c, d) in enumerate(cuts[1]) if min(b, d) > max(a, c)}
        assert dict(zip(zip(alignment._rows(got).tolist(), got.columns.tolist(), strict=True), got.values.tolist(), strict=True)) == want


def test_long_text_and_empty_table(spark):
    rows = [(1, "word " * 300_000 + "end"), (2, "b64" * 40_000)]
    check(spark, rows)
    assert alignment.align(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []


def test_registered_query(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.reg.queries["op13_token_alignment"](spark, data).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
