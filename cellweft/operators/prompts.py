"""Task prompts from schema text and a row's own fields.

Wordings are ours and can be replaced: `templates` maps a task to its wordings.  A wording is a short
constant, so it is picked inside the row's expression and needs no join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.text import pick, strip_answer_fence
from cellweft.operators.describe import key_suffix
from cellweft.operators.joins import join_small
from cellweft.operators.ordering import with_position

HEADER = "Database schema:\n{schema}\n"

TEMPLATES: dict[str, Sequence[str]] = {
    "text2sql": (
        "Write one SQLite query, and nothing more, for this question.\nQuestion: {question}",
        "Translate the question to SQLite. Return the query alone.\nQuestion: {question}",
        "Which SQLite query answers the question? Leave out any comment.\nQuestion: {question}",
    ),
    "column_prediction": (
        "A row reads {row}. Name the column that {cell_value} was taken from.",
        "In the row {row}, what column does {cell_value} come from? Name it only.",
    ),
    "columns_prediction": (
        "A row reads {row}. Name, in order, the columns that {cell_value} were taken from.",
        "In the row {row}, what columns do {cell_value} come from? Name them in order.",
    ),
    "cell_prediction": (
        "One of the values {cell_value} belongs to column '{col_name}'. Give that value.",
        "Pick from {cell_value} the value of column '{col_name}'.",
    ),
    "recall": (
        "Name the tables and columns needed for: '{question}'\nWrite them as table1.column1, table2.column1, ...",
        "For '{question}', what tables and columns have to be read?\nWrite them as table1.column1, table2.column1, ...",
    ),
    "recall_one_table": (
        "Name the columns needed for: '{question}'\nWrite them as table1.column1, table1.column2, ...",
        "For '{question}', what columns have to be read?\nWrite them as table1.column1, table1.column2, ...",
    ),
    "question_generation": (
        "Write a question about these data whose answer is '{answer}'.",
        "The answer is '{answer}'. What was asked?",
    ),
    "title": ("Give this table a short title.", "What would be a fitting title here?"),
    "code_generation": (
        "The data are in a DataFrame named df. Write Python code for the question.\nPut the code in ```python ```.\nQuestion: {question}",
        "With the data loaded as the DataFrame df, answer in Python.\nPut the code in ```python ```.\nQuestion: {question}",
    ),
    "row_summary": (
        "Say in one sentence what these rows hold; their columns may be in any order. {rows}",
        "Sum up these rows in a single sentence (column order may differ). {rows}",
    ),
}


def _filled(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill a template by concatenation, so braces inside the values are never read as fields."""
    parts = []
    for text in re.split(r"(\{\w+\})", template):
        name = text[1:-1]
        if text.startswith("{") and name in fields:
            parts.append(fields[name])
        elif text:
            parts.append(F.lit(text))
    return F.concat(*parts)


def choose_template(
    task: str, fields: Mapping[str, Column], keys: Sequence[str], seed: int | None = None, templates: Mapping = TEMPLATES
) -> Column:
    """The filled wording that the row's key picks; the first one where no seed is given."""
    wordings = [HEADER + t for t in templates[task]] if "schema" in fields else list(templates[task])
    if seed is None:
        return _filled(wordings[0], fields)
    number = pick(seed, keys, len(wordings))
    out = F.when(number == 0, _filled(wordings[0], fields))
    for i, wording in enumerate(wordings[1:], 1):
        out = out.when(number == i, _filled(wording, fields))
    return out


def schema_texts(examples: DataFrame, lines: DataFrame, foreign_keys: DataFrame | None = None, paths: str = "path_csvs") -> DataFrame:
    """Schema text of the tables that examples name, in their order: (db_id, path_csvs, schema_text), a row per different list.

    lines(table_id, line) are the schema lines of all tables; a name without a line is left out.  The foreign keys(db_id, fk)
    of the example's database follow, if it has any.
    """
    lists = examples.select("db_id", paths).distinct()
    named = lists.select("db_id", paths, F.posexplode_outer(paths).alias("pos", "table_id"))
    found = named.join(lines.select("table_id", "line"), "table_id", "left")
    # an example names few tables, so its lines are few
    texts = found.groupBy("db_id", paths).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    if foreign_keys is None:
        return texts.select("db_id", paths, text.alias("schema_text"))
    with_keys = texts.join(key_suffix(foreign_keys), "db_id", "left")
    return with_keys.select("db_id", paths, F.concat(text, F.coalesce("suffix", F.lit(""))).alias("schema_text"))


def build_prompt(
    examples: DataFrame,
    task: str,
    fields: Mapping[str, str],
    keys: Sequence[str],
    seed: int | None = None,
    schema: DataFrame | None = None,
    templates: Mapping = TEMPLATES,
) -> DataFrame:
    """Add `instruction` to examples.  A schema is (db_id, schema_text), or that of schema_texts for the tables each example names."""
    df = examples if schema is None else _with_schema(examples, schema)
    filled = {name: F.col(c) for name, c in fields.items()}
    filled["schema"] = F.col("schema_text")
    return df.withColumn("instruction", choose_template(task, filled, keys, seed, templates))


def _with_schema(examples: DataFrame, schema: DataFrame) -> DataFrame:
    return join_small(examples, schema, [c for c in schema.columns if c != "schema_text"])


def build_text2sql(examples: DataFrame, schema: DataFrame, keys: Sequence[str], seed: int | None = None) -> DataFrame:
    """(instruction, answer) from question, answer and the schema text, whose lines may show values or not."""
    out = build_prompt(examples, "text2sql", {"question": "question"}, keys, seed, schema)
    return out.withColumn("answer", strip_answer_fence("answer"))


def build_recall(examples: DataFrame, schema: DataFrame, keys: Sequence[str], seed: int | None = None) -> DataFrame:
    """Tables and columns a question needs; an example with one table gets the wording for one table."""
    df = _with_schema(examples, schema)
    fields = {"question": F.col("question"), "schema": F.col("schema_text")}
    one = choose_template("recall_one_table", fields, keys, seed)
    many = choose_template("recall", fields, keys, seed)
    return df.withColumn("instruction", F.when(F.size("path_csvs") == 1, one).otherwise(many))


def build_row_summaries(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, n: int, seed: int | None = None, schema: Column | None = None, templates: Mapping = TEMPLATES
) -> DataFrame:
    """(by, part, instruction): a prompt for every n consecutive rows of a table, so that none grows with its table.

    Rows are in a unique order; the last part of a table may be shorter.
    """
    placed = with_position(rows, order, by=by, name="_at").withColumn("part", F.floor((F.col("_at") - 1) / n))
    lists = placed.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("_at", F.col(text).alias("t")))).alias("l"))
    fields = {"rows": F.array_join(F.transform("l", lambda x: x["t"]), "; ")}
    if schema is not None:
        fields["schema"] = schema
    return lists.select(*by, "part", choose_template("row_summary", fields, [*by, "part"], seed, templates).alias("instruction"))
