"""Reply trees, templates and digests of chat formatting."""

import hashlib
import random

from cellweft.llm import chat

NODES = "tree long, node long, parent long, score double, role string, text string"


def test_branches_of_a_forest(spark):
    rng = random.Random(3)
    nodes, want = [], set()
    for tree in (1, 2, None):
        parents = {0: None}
        for n in range(1, 40):
            parents[n] = rng.randint(max(0, n - 6), n - 1)
        parents[40], parents[41], parents[42] = 77, 42, 41  # an orphan and a circle
        parents[43] = 42
        for n, p in parents.items():
            nodes.append((tree, n, p, float(rng.randint(0, 3)), "user", f"t{n}"))
        for leaf in set(parents) - set(parents.values()) - {43}:
            n, up = leaf, 0
            while n is not None and n in parents:
                want.add((tree, leaf, n, up))
                n, up = parents[n], up + 1
    frame = spark.createDataFrame(nodes, NODES)
    assert {tuple(r) for r in chat.branches(frame).collect()} == want
    best = chat.ranked(frame, 2).collect()
    scores = {(t, n): s for t, n, _, s, _, _ in nodes}
    for tree in (1, 2, None):
        means = {}
        for t, leaf, n, _ in want:
            if t == tree:
                means.setdefault(leaf, []).append(scores[t, n])
        order = sorted(means, key=lambda x: (-sum(means[x]) / len(means[x]), x))
        for rank in (1, 2):
            said = [r["text"] for r in sorted((r for r in best if r["tree"] == tree and r["rank"] == rank), key=lambda r: r["depth"])]
            assert said[-1] == f"t{order[rank - 1]}"
            assert len(said) == len(means[order[rank - 1]])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_read_back(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\l\\b\\g\\", "", None, "é<>\\", "日本</turn>", ">\n"]
    turns = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(6) for t in range(9) for role in [("user", "assistant", "system", None, "a>b<c")[(c * t) % 5]]]
    turns += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (50, 0, "assistant", None), (None, 1, "user", "x"), (None, 0, "assistant", "y" * 50_000), (60, None, "assistant", "no turn")]
    frame = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, node int, score string")
    got = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, row in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: tuple((x is not None, x) for x in t[1:]))
        learnt = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == digest("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), digest(learnt))
    assert chat.format_conversations(frame.filter("false")).collect() == []
