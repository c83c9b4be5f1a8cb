"""License scans: base places against a word search, merged diagonals, edge rows."""

import random
import re

from pyspark.sql import functions as F

from cellweft.llm import licenses


def words(text):
    return re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_places(spark):
    rng = random.Random(5)
    parts = ["GNU", "General", "Public", "License", "Apache", "CC", "BY", "MIT", "x", "Ünder", "the", "-", "\n", "cc-by", "İ"]
    rows = [(i if i % 9 else None, " ".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(7, None), (7, ""), (7, "MIT License"), (7, "MIT License"), (900, "mit license " * 3000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, hash int, own string")
    got = [tuple(r)[:6] for r in licenses.scan(frame).collect()]
    want = []
    for doc_id, text in rows:
        w = words(text)
        hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        want.append((doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(frame.filter("false")).collect() == []


def off(a, b):
    """Words to put in, leave out or change."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def aligned(text):
    """(labels, best score) of all windows, by brute force."""
    w, labels, best = words(text), set(), 0.0
    for phrase, label, core in licenses.TEMPLATES:
        p, c = phrase.split(), core.split()
        edits = len(p) // licenses.WORDS_PER_EDIT
        for size in range(len(p) - edits, len(p) + edits + 1):
            for i in range(len(w) - size + 1):
                x = w[i : i + size]
                wrong = off(x, p)
                if wrong <= edits and any(x[j : j + len(c)] == c for j in range(len(x))):
                    labels.add(label)
                    best = max(best, 1 - wrong / len(p))
    return labels, best


def labelled(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))), r["score"], r["n_base"]) for r in licenses.scan(frame).collect()}


def test_relatives_keep_apart(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
        "Licensed under CC BY-SA 4.0": {"cc-by-sa-4.0"},
        "Licensed under CC BY 4.0": {"cc-by-4.0"},
        "Licensed under the GNU General Public License, version 2": {"gpl-2.0"},
        "licensed under the GNU General Public License version 3.": {"gpl-3.0"},
        "Licensed under the GNU Lesser General Public License": {"lgpl"},
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "licensed under a creative commons attribution noncommercial 4 0 international license": set(),
        "permission is hereby granted free of charge to any person obtaining zzz zzz yyy of this software": set(),
        "permission is hereby granted, free of charge, to any other person obtaining a copy of this software": {"mit"},
        "Redistribution and use in source and binary forms, with or without any modification, are permitted": {"bsd"},
        "redistribution and use in source with or without modification are permitted": set(),
        "use in source and binary forms": set(),
        "cc by cc by licensed under cc by 4 0 cc by cc by cc by": {"cc-by-4.0"},
    }
    got = labelled(spark, list(texts))
    extra = {text: got[i][0] for i, text in enumerate(texts)}
    # a label that is a base label, too, is told by the base
    assert extra == texts


def test_against_all_windows(spark):
    rng = random.Random(7)
    texts = ["", "x " * 30]
    for phrase, _, _ in licenses.TEMPLATES:
        for _ in range(12):
            w = phrase.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + ["word"] + w[i:], w[:i] + w[i + 1 :], w[:i] + [rng.choice(["word", "2", "3", "nc"])] + w[i + 1 :]]) or ["x"]
            texts.append(" ".join([*rng.choices(["some", "text", "under", "the"], k=rng.randrange(6)), *w, *rng.choices(["license", "4", "0"], k=rng.randrange(4))]))
    got = labelled(spark, texts)
    for i, text in enumerate(texts):
        labels, best = aligned(text)
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(words(text))} "}
        assert got[i][0] == labels - base, text
        assert got[i][1] == (1.0 if got[i][2] else best) or abs(got[i][1] - best) < 1e-12, text


def test_the_class_of_words_is_named_by_what_it_holds(spark):
    """Every character on a border of the contract's class, alone and between letters, and no negated class in the plan."""
    marks = [chr(c) for c in [*range(0x82), 0x85, 0xA0, 0xFF, 0x2028, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    texts = [f"a{m}b {m} {m}{m}C" for m in marks]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", licenses.words(F.col("text")).alias("w"))
    assert "[^" not in docs._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.w for r in docs.collect()} == dict(enumerate(map(words, texts)))
