"""Pre-tokens, byte-pair merges and token files against the public libraries and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from cellweft.llm import bpe, pretokens, remembered, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "r", "e", "v", "l", " ", "\n", "\t", "!", "'s", "'ll", "é", "9", "٣", " ", "\x1c", " ", "日本", "'m ", " '", "😀", "<|endoftext|>", "Hello"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_tokens long, ids string")


def test_split_is_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    every = texts(3000)
    data, marks, counts = pretokens.split(every)
    tokens, at = [data.tobytes()[a:b].decode() for a, b in zip(marks[:-1], marks[1:])], 0
    for text, n in zip(every, counts):
        assert tokens[at : at + n] == pattern.findall(text)
        at += n


def test_long_texts_in_pieces(monkeypatch, library):
    monkeypatch.setattr(pretokens, "SLICE", 50)
    long = " word of's \n\n text 123" * 40 + " " * 70 + "x" * 300
    assert len(list(pretokens.pieces([long]))) > 3
    unbroken = "日本語。" * 30 + "a1b2" * 30 + "--x'll" * 30
    assert max(len(p) for _, p in pretokens.pieces([unbroken])) <= 56
    assert np.concatenate([ids for _, ids in bpe.encoded([unbroken], RANKS)]).tolist() == library.encode_ordinary(unbroken)
    got = np.concatenate([ids for _, ids in bpe.encoded([long], RANKS)])
    assert got.tolist() == library.encode_ordinary(long)


def test_perfect_hash_is_minimal(library):
    table = bpe.codec(RANKS).table
    assert sorted(table.key_at.tolist()) == list(range(table.n))
    assert bpe.codec(RANKS).decode(np.arange(256)) == library.decode_bytes(range(256))


def test_merge_equals_library(library):
    for text in texts(500, 2):
        assert [i for t in regex.findall(public_tokenizers.PATTERN, text) for i in bpe.merge(t.encode(), bpe.codec(RANKS).ranks)] == library.encode_ordinary(text)


def test_round_trip_query(spark, library):
    rows = [*enumerate(texts(200, 3)), (7, None), (None, "no id"), (7, "again"), (7, "again"), (999, "ab " * 70_000)]
    got = sorted(map(tuple, bpe.round_trip(frame(spark, rows), RANKS).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids, raw = library.encode_ordinary(text or ""), (text or "").encode()
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(frame(spark, []), RANKS).collect() == []


def test_encode_documents(spark, library):
    docs = frame(spark, [(1, "two words"), (2, None), (3, "")])
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANKS).collect()}
    assert bpe.decode_ids(bytes(got[1]["ids"]), RANKS) == b"two words" and got[1]["n_tokens"] == 2
    assert got[2]["ids"] is None and got[2]["n_tokens"] is None and got[3]["n_tokens"] == 0


@pytest.mark.parametrize("kind", ["small", "zeros", "mixed", "escapes", "one", "none"])
def test_pack_round_trip(kind):
    rng = np.random.default_rng(5)
    ids = {
        "small": rng.integers(0, 50_000, 20_000),
        "zeros": np.concatenate([np.zeros(9000), [1], np.zeros(500)]),
        "mixed": 2 ** rng.integers(0, 59, 9000),
        "escapes": np.where(rng.random(9000) < 0.1, rng.integers(0, 2**63 - 1, 9000).astype(np.uint64) * 2 + 1, rng.integers(0, 9, 9000)),
        "one": np.array([2]),
        "none": np.array([]),
    }[kind].astype(np.uint64)
    segment = token_files.pack(ids)
    assert (token_files.unpack(segment) == ids).all()
    b = token_files.BLOCK
    assert (token_files.unpack(segment, 1, 2) == ids[b : 2 * b]).all()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 100)
    rows = [*enumerate(texts(150, 4)), (5000, None), (5000, "b"), (5000, "b"), (6000, "ab " * 3000)]
    rows += [(7000, "<|endoftext|>"), (7001, "a <|endoftext|> b<|endoftext|><|endoftext|>"), (7002, "x " * 90 + "<|endoftext|>" + "y " * 90)]
    library = Tokenizer.from_file(JSON)  # as it is: the strings of added tokens are tokens
    start, want = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.write_and_read(frame(spark, rows), JSON).collect()
    assert sorted(map(tuple, got)) == want
    assert token_files.write_and_read(frame(spark, []), JSON).collect() == []


def test_remembered_strings():
    rng = random.Random(6)
    words = [b"", b"a", *(bytes(rng.choices(b"abc ", k=rng.randint(1, 9))) for _ in range(300))]
    sizes = np.array([1] * 256)
    ids_of = lambda texts, _: (np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64), np.array([len(t) for t in texts]))
    memory = remembered.Remembered(ids_of, 100, sizes, np.arange(256).astype(np.uint8))
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        data = np.frombuffer(b"".join(own), np.uint8)
        full = [w for w in own if w]
        marks = np.append(np.cumsum([0, *map(len, full)])[:-1], len(data))
        ids, counts, sound = memory.encode(data, marks, np.array([len(full)]))
        assert bytes(ids.astype(np.uint8)) == b"".join(own) and counts.tolist() == [len(data)] and sound.all()


def test_strings_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    memory = remembered.Remembered(lambda texts, _: (np.array([ord(t[0]) for t in texts]), np.ones(len(texts), np.int64)), 100)
    for text in (b"abcab", b"cba", b"zab", b"abc"):
        data = np.frombuffer(text, np.uint8)
        ids, _, _ = memory.encode(data, np.arange(len(data) + 1), np.array([len(data)]))
        assert bytes(ids.astype(np.uint8)) == text
