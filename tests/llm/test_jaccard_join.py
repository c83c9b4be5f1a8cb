"""The Jaccard join against all pairs."""

import re

import numpy as np

from cellweft.llm import jaccard_join, shingles


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingle_set(t) if t is not None else None for _, t in rows]
    kinds = [None if t is None else (s or t) for (_, t), s in zip(rows, sets)]
    n = len(rows)
    linked = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if kinds[i] is not None and kinds[j] is not None and kinds[i] != kinds[j] and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    linked[i].add(kinds[j])
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if kinds[i] is not None and (kinds[i] == kinds[j] or kinds[j] in linked[i]) and group[j] < group[i]:
                    group[i], changed = group[j], True
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        copies = sum(kinds[j] == kinds[i] for j in range(n)) if kinds[i] is not None else 1
        out.append((rows[i][0], min(ids) if ids else None, len(linked[i]), copies))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, class int, n_links int, own int")


def samples():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = []
    for f in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(vocabulary))
            rows.append(" ".join(own).upper() if rng.random() < 0.2 else ", ".join(own))
    rows += [None, None, "", "", "!!", "!!", "?", "one two", "One  two", "one", rows[0], rows[0]]
    return [(1000 - i if i % 17 else None, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = samples()
    got = jaccard_join.join_texts(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == brute(rows)


def test_keep_one(spark):
    rows = samples()
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "class", "n_links", "own"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    for r in jaccard_join.join_texts(frame(spark, rows)).collect():
        groups.setdefault(r["group"], set()).add(r["class_id"])
    assert sum(t is None for _, t in got) == 2
    assert len(got) == 2 + len([g for g in groups if g is not None])
    assert jaccard_join.join_texts(frame(spark, [])).collect() == []


def test_shingles_of_slices():
    texts = ["a b c d e f", "", "x", "Ünï côdé 1 2 3 4", "a b c d e f"]
    hashes, n = shingles.shingle_hashes(texts, 5)
    assert n.tolist() == [2, 0, 1, 2, 2] and hashes[:2].tolist() == hashes[-2:].tolist()
    assert len(np.unique(hashes)) == 5


def test_least_matches_never_grows_past_the_threshold():
    table = jaccard_join.least_matches()
    assert all(m < 0.8 * n for n, m in table) and [m for _, m in table] == sorted(m for _, m in table)
