"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined to the positions of the same k-grams in templates.  A
hit votes for the diagonal document position minus template position.  Diagonals that have enough votes, alone or with
their neighbour, are candidates: a word put in or left out moves the rest of a match to the next diagonal.  Each candidate
is verified word by word from its first to its last place: one word in ten may differ from the template, but the words that tell
a license from its relatives must stand there as they are.  Of spans that overlap the best one counts.  Base phrases are templates that must be met word by word on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.llm.common import stored
from cellweft.operators.joins import join_small

#: What a word is, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters by what they are: Java's matcher takes a twentieth of the time for a class that is not negated.
WORD_RUN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices that the method knows by itself, their labels, and the words of each that allow of no change.
TEMPLATES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "gnu general public license version 2"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission is hereby granted free of charge"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "creative commons attribution 4 0 international"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public license v 2 0"),
)
K = 2
#: Diagonals so near may belong together.
NEAR = 2
#: One word in so many of a template may differ.
WORDS_PER_EDIT = 10
#: A template's words are written as characters from this one on, any other word as a space.
FIRST_CHARACTER = 0x4E00


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD_RUN), F.lit(0))


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """template, label, is_base, total, at, gram: a row per k-gram position, as many as the lists have words."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in base), *((p, x, False) for p, x, _ in templates)]):
        w = phrase.split()
        total = len(w) - K + 1
        rows += [(number, label, is_base, total, at, " ".join(w[at : at + K])) for at in range(total)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, total int, at int, gram string")


def template_words(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """template, words, letters, spelled, core, edits: the words of a template and a letter for each place, the template and its core
    in letters (equal words have the first one's), and how many words may differ."""
    rows = []
    for number, (phrase, _, core) in enumerate(templates, len(base)):
        w = phrase.split()
        letters = [chr(FIRST_CHARACTER + i) for i in range(len(w))]
        spelled = ["".join(letters[w.index(x)] for x in part.split()) for part in (phrase, core)]
        rows.append((number, w, "".join(letters), *spelled, len(w) // WORDS_PER_EDIT))
    return spark.createDataFrame(rows, "template int, words array<string>, letters string, spelled string, core string, edits int")


def candidates(votes: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, own, template, label, start, end, edits: where enough k-grams of a template are on one diagonal or on two near ones.

    votes hold, per document, template and diagonal, the template positions of its k-grams; a changed word takes K of them at most.
    """
    line = Window.partitionBy("doc_id", "own", "template").orderBy("diagonal")
    following = F.struct(F.lead("diagonal").over(line).alias("diagonal"), F.lead("ats").over(line).alias("ats"))
    pairs = votes.withColumn("next", F.when(F.lead("diagonal").over(line) - F.col("diagonal") <= NEAR, following))
    own = F.struct(F.col("diagonal"), F.col("ats"))
    options = F.when(F.col("next").isNotNull(), F.array(F.array(own), F.array(own, F.col("next")))).otherwise(F.array(F.array(own)))
    # the templates are a list in the code
    tried = pairs.join(F.broadcast(known.select("template", "edits")), "template")
    tried = tried.select("doc_id", "own", "template", "label", "total", "edits", F.explode(options).alias("lines"))
    tried = tried.where(F.size(F.array_distinct(F.flatten("lines.ats"))) >= F.col("total") - K * F.col("edits"))
    low, high = F.array_min("lines.diagonal"), F.array_max("lines.diagonal")
    return tried.select("doc_id", "own", "template", "label", low.alias("start"), (high + F.col("total") + K - 1).alias("end"), "edits").distinct()


def verified(found: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, own, label, score, start, end: the candidates whose words are right, the best one at a place.

    docs(doc_id, own, text) are read again and split where there are candidates.
    """
    lists = found.groupBy("doc_id", "own").agg(F.collect_list(F.struct("template", "label", "start", "end", "edits")).alias("found"))
    lists = lists.withColumnsRenamed({"doc_id": "d", "own": "o"})
    met = join_small(docs, lists, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["own"] == F.col("o")))
    met = met.select("doc_id", "own", "found", words(F.col("text")).alias("w"))

    def cut(x: Column) -> Column:
        """A candidate with its words, and as many more on both sides as may differ."""
        base = F.greatest(x["start"] - x["edits"], F.lit(0))
        return F.struct(x["template"].alias("template"), x["label"].alias("label"), base.alias("base"), F.slice("w", base + 1, x["end"] + x["edits"] - base).alias("x"))

    spans = met.select("doc_id", "own", F.explode(F.transform("found", cut)).alias("c")).select("doc_id", "own", "c.*").join(F.broadcast(known), "template")
    place = lambda w: F.array_position(F.col("words"), w).cast("int")
    letter = lambda w: F.when(place(w) > 0, F.substr(F.col("letters"), place(w), F.lit(1))).otherwise(" ")
    spans = spans.withColumn("t", F.array_join(F.transform("x", letter), "")).withColumn("n", F.length("spelled"))
    # all windows that have the right number of words, but for those that may differ
    sizes = F.sequence(F.col("n") - F.col("edits"), F.col("n") + F.col("edits"))
    starts = F.when(F.length("t") >= F.col("n") - F.col("edits"), F.sequence(F.lit(0), F.length("t") - F.col("n") + F.col("edits"))).otherwise(F.array().cast("array<int>"))
    windows = F.flatten(F.transform(starts, lambda a: F.transform(sizes, lambda z: F.struct(a.alias("a"), z.alias("z"), F.substr(F.col("t"), a + 1, z).alias("s")))))
    whole = F.filter(windows, lambda x: (F.length(x["s"]) == x["z"]) & F.contains(x["s"], F.col("core")))
    tried = F.transform(whole, lambda x: F.struct(F.levenshtein(x["s"], F.col("spelled")).alias("off"), x["a"].alias("a"), x["z"].alias("z")))
    good = spans.withColumn("best", F.array_min(tried)).where("best.off <= edits")
    start = F.col("base") + F.col("best.a")
    good = good.select("doc_id", "own", "template", "label", "n", start.alias("start"), (start + F.col("best.z")).alias("end"), (1 - F.col("best.off") / F.col("n")).alias("score"))
    good = good.distinct().withColumn("rank", F.struct("score", "n", (-F.col("template")).alias("first")))
    line = Window.partitionBy("doc_id", "own").orderBy("start", "end", "template")
    beaten = ((F.lag("end").over(line) > F.col("start")) & (F.lag("rank").over(line) > F.col("rank"))) | ((F.lead("start").over(line) < F.col("end")) & (F.lead("rank").over(line) > F.col("rank")))
    return good.withColumn("beaten", F.coalesce(beaten, F.lit(False))).where("NOT beaten").select("doc_id", "own", "label", "score", "start", "end")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row per document: word count, base places and labels, all labels, and as score the share of words that the best notice has right.

    Null and empty texts have no words and no labels.  Rows that repeat a doc_id and text get the same answer
    each.  Of overlapping spans that are equally good the longer template counts, then the earlier one of the list.  Long texts
    are taken whole.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("own"), words(F.coalesce("text", F.lit(""))).alias("w"))
    counted = rows.select("doc_id", "own", F.size("w").cast("long").alias("n_words"))
    grams = rows.select("doc_id", "own", F.posexplode(F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))).alias("pos", "gram"))
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    listed = template_grams(spark, base, templates).withColumn("hash", F.xxhash64("gram"))
    # the templates are a list in the code
    hits = grams.join(F.broadcast(listed.withColumnRenamed("gram", "known")), "hash").filter(F.col("gram") == F.col("known"))
    hits = stored(hits.select("doc_id", "own", "template", "label", "is_base", "total", "at", "pos").distinct(), "hits")
    votes = hits.groupBy("doc_id", "own", "template", "label", "is_base", "total", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats")
    )
    places = votes.filter(F.col("is_base") & (F.size("ats") == F.col("total")))
    found = places.groupBy("doc_id", "own").agg(
        F.count("*").alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    known = template_words(spark, base, templates)
    texts = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    spans = verified(candidates(votes.filter(~F.col("is_base")), known), texts, known)
    more = spans.groupBy("doc_id", "own").agg(F.collect_set("label").alias("extra"), F.max("score").alias("best"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"doc_id": "d", "own": "o"})
        return left.join(r, left["doc_id"].eqNullSafe(r["d"]) & (left["own"] == r["o"]), "left").drop("d", "o")

    out = joined(joined(counted, found), more)
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("extra", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
