import pytest
from pyspark.sql import functions as F

from cellweft.functions import sequences as seq
from cellweft.functions import text as tx
from cellweft.operators import examples, prompts

MAP = "array<struct<k:string,v:string>>"


def value(spark, col, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("a ```sql SELECT 1\t``` b", "SELECT 1"),
        ("```SELECT 2``` x", "SELECT 2"),
        ("```sql\nSELECT a\nFROM t;\n```", "SELECT a FROM t"),
        ("so SELECT 3; and more", "SELECT 3"),
        ("SELECT 4 ``` rest", "SELECT 4 "),
        ("nothing", "nothing"),
        ("```sql\nselect 1\n``` ```SELECT 5```", "SELECT 5"),
        ("select 1", "select 1"),
        ("", ""),
    ],
)
def test_extract_sql(spark, text, want):
    assert value(spark, tx.extract_sql("t"), [(text,)], "t string") == want


def test_extract_fenced_reads_over_lines(spark):
    t = "x ```sql\nSELECT 1\n``` y"
    assert value(spark, tx.extract_fenced("t"), [(t,)], "t string") == "SELECT 1"
    assert value(spark, tx.extract_fenced("t", plain_fence=False), [("```a```",)], "t string") == "```a```"


def test_names(spark):
    row = [("SELECT a1, t.a FROM t WHERE a = 'a'", [("a", "b"), ("b", "c")], [("x", "1"), ("y", "2"), ("z", "1")])]
    schema = f"q string, m {MAP}, d {MAP}"
    assert value(spark, tx.restore_names("q", "m"), row, schema) == "SELECT c1, t.c FROM t WHERE c = 'c'"
    renamed = tx.rename_identifiers("q", F.array(F.struct(F.lit("t").alias("k"), F.lit("u").alias("v"))), F.col("m"))
    assert value(spark, renamed, row, schema) == "SELECT a1, u.b FROM t WHERE b = 'a'"
    assert [tuple(e) for e in value(spark, tx.invert_mapping("d"), row, schema)] == [("1", "z"), ("2", "y")]
    assert value(spark, tx.clean_prediction("q"), [("\n a\nb \tc",)], "q string") == "a b "
    assert value(spark, tx.strip_qualifier("q"), [("t.c",)], "q string") == "c"
    assert value(spark, tx.strip_answer_fence("q"), [("```sql\nSELECT 1\n```",)], "q string") == "SELECT 1"


def test_braces_in_values_stay(spark):
    df = spark.createDataFrame([(1, "is {question} kept {schema}?", "S")], "id int, question string, schema_text string")
    out = prompts.build_prompt(df, "text2sql", {"question": "question"}, ["id"]).first().instruction
    assert out.startswith("Database schema:\nS\n") and out.endswith("Question: is {question} kept {schema}?")


def test_sequences(spark):
    ids = F.array(*[F.lit(i) for i in (5, 6, -114, 7)])
    assert value(spark, seq.mask_prompt_labels(ids, F.lit(2))) == [-100, -100, -114, 7]
    assert value(spark, seq.mask_prompt_labels(ids, F.lit(9))) == [-100] * 4
    assert value(spark, seq.splice_placeholders(ids, ids, 2)) == [5, 6, -100, -100, 7]
    assert value(spark, seq.pad_ids(ids, F.lit(6), 0)) == [5, 6, -114, 7, 0, 0]
    assert value(spark, seq.pad_ids(ids, F.lit(6), 0, left=True)) == [0, 0, 5, 6, -114, 7]
    assert value(spark, seq.cut_at_stop(ids, [7, 6])) == [5]
    assert value(spark, seq.cut_at_stop(ids, [99])) == [5, 6, -114, 7]
    assert value(spark, seq.non_pad_length(F.array(F.lit(0), F.lit(0)), 0)) == 0
    pieces = F.array(F.array(F.lit(1), F.lit(8)), F.array(F.lit(1), F.lit(9)), F.array(F.lit(1)))
    assert value(spark, seq.interleave_placeholder(pieces, 1)) == [1, 8, -114, 9, -114]
    assert value(spark, seq.interleave_placeholder(pieces, 2)) == [1, 8, -114, 1, 9, -114, 1]
    assert value(spark, seq.interleave_placeholder(pieces)) == [1, 8, -114, 1, 9, -114, 1]


def test_vocabulary_and_ids(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c  a b")], "doc_id int, text string")
    vocab = examples.vocabulary(docs, "text")
    assert {r.word: r.id for r in vocab.collect()} == {"b": 0, "a": 1, "c": 2}
    ids = examples.tokenise_by_vocabulary(docs, "doc_id", "text", vocab)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: [0, 1, 0], 2: [], 3: [2, 1, 0]}


def test_token_stats(spark):
    cells = spark.createDataFrame([("t", 1, 0, "a b c"), ("t", 2, 0, None), ("t", 1, 1, "12")], "table_id string, row_id int, col_idx int, value string")
    cols = spark.createDataFrame([("t", 0, "a", "object"), ("t", 1, "b", "int64")], "table_id string, col_idx int, col_name string, dtype string")
    got = {r.col_idx: (r.max_tokens, r.n_tokens) for r in examples.token_stats(cells, cols).collect()}
    assert got == {0: (3, 4), 1: (1, 1)}


def test_batches_are_bounded(spark):
    sizes = examples.batched_map(spark.range(0, 25, 1, 1), lambda f: f.assign(n=len(f)), "id bigint, n bigint", 10)
    assert sorted({r.n for r in sizes.collect()}) == [5, 10]


def test_schema_of_the_tables_an_example_names(spark):
    lines = spark.createDataFrame([("a", "line a"), ("b", "line b"), ("c", "line c")], "table_id string, line string")
    rows = [(1, "d", ["b", "a"]), (2, "d", ["b", "a"]), (3, "e", ["c"]), (4, "e", ["c", "gone", "c"]), (5, "d", []), (6, "d", None), (7, None, ["a"])]
    examples = spark.createDataFrame(rows, "k int, db_id string, path_csvs array<string>")
    keys = spark.createDataFrame([("d", "a.x = b.y"), ("d", "a.z = b.y")], "db_id string, fk string")
    got = {(r.db_id, tuple(r.path_csvs or ["?"])): r.schema_text for r in prompts.schema_texts(examples, lines, keys).collect()}
    suffix = "\nForeign keys: [a.x = b.y, a.z = b.y]\n"
    assert got == {
        ("d", ("b", "a")): "line b\nline a" + suffix, ("e", ("c",)): "line c", ("e", ("c", "gone", "c")): "line c\nline c", ("d", ("?",)): suffix, (None, ("a",)): "line a",
    }
    named = examples.where("k < 5").selectExpr("*", "'why' AS question", "'```sql x ```' AS answer")
    built = {r.k: (r.instruction, r.answer) for r in prompts.build_text2sql(named, prompts.schema_texts(named, lines), ["k"]).collect()}
    assert built[4] == ("Database schema:\nline c\nline c\n" + prompts.TEMPLATES["text2sql"][0].format(question="why"), "x") and len(built) == 4


def test_row_summaries_cover_all_rows(spark):
    rows = spark.createDataFrame([(i % 2, i, f"r{i}") for i in range(9)], "t int, i int, x string")
    got = {(r.t, r.part): r.instruction for r in prompts.build_row_summaries(rows, ["t"], ["i"], "x", 2).collect()}
    first = prompts.TEMPLATES["row_summary"][0]
    assert got == {(i % 2, p): first.format(rows=t) for (i, p), t in {(0, 0): "r0; r2", (0, 1): "r4; r6", (0, 2): "r8", (1, 0): "r1; r3", (1, 1): "r5; r7"}.items()}
