"""Text functions as Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fences around generated SQL, and the placeholder spellings in prompts.
SQL_FENCE = "```sql"
FENCE = "```"
PLACEHOLDERS = ("<insert><insert_embs></insert>|", "<insert_embs>|")
MARKERS = ("<insert>", "</insert>")

# Words that are never renamed in a query.
KEYWORDS = (
    "all and as asc avg between by case count cross desc distinct else end except exists from full group having in inner"
    " intersect into is join left like limit max min not null offset on or order outer right select sum then union using"
    " when where with"
).split()

# one token per match, and every character belongs to a token
TOKEN = "'[^']*'|\"[^\"]*\"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+[A-Za-z0-9_]*|[^A-Za-z0-9_]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), "^\\s+|\\s+$", "")


def one_line(text: str | Column) -> Column:
    """Newlines and tabs become spaces."""
    return F.translate(_col(text), "\n\t", "  ")


def _fence(text: Column, mark: str) -> Column:
    """Text between the first mark and its closing fence on the same line, null if there is none."""
    pattern = f"{mark}([^\\n]*?){FENCE}"
    return F.when(F.rlike(text, F.lit(pattern)), trim_space(one_line(F.regexp_extract(text, pattern, 1))))


def extract_sql(text: str | Column) -> Column:
    """SQL in generated text: a sql fence, else a plain fence (only where no sql fence was opened), else
    from the first SELECT up to a fence or a semicolon, else the text itself."""
    t = _col(text)
    opened = F.contains(t, F.lit(SQL_FENCE))
    fenced = F.when(opened, _fence(t, SQL_FENCE)).otherwise(_fence(t, FENCE))
    tail = F.substr(t, F.locate("SELECT", t))
    tail = F.substring_index(F.substring_index(tail, FENCE, 1), ";", 1)
    return F.coalesce(fenced, F.when(F.contains(t, F.lit("SELECT")), one_line(tail)), t)


def extract_fenced(text: str | Column, plain_fence: bool = True) -> Column:
    """SQL in a fence after newlines became spaces; without a fence the text itself."""
    t = F.translate(_col(text), "\n", " ")
    found = [_fence(t, SQL_FENCE)] + ([_fence(t, FENCE)] if plain_fence else [])
    return F.coalesce(*found, t)


def restore_names(query: str | Column, mapping: str | Column) -> Column:
    """Replace each key of array<struct<k, v>> by its value as plain text, entry after entry."""
    return F.aggregate(_col(mapping), _col(query), lambda q, e: F.replace(q, e["k"], e["v"]))


def invert_mapping(mapping: str | Column) -> Column:
    """Values become keys; of equal values the last key wins, at the place of the first."""
    m = _col(mapping)
    values = F.transform(m, lambda e: e["v"])
    firsts = F.filter(m, lambda e, i: F.array_position(values, e["v"]) == i + 1)
    return F.transform(
        firsts,
        lambda e: F.struct(e["v"].alias("k"), F.element_at(F.filter(m, lambda x: x["v"] == e["v"]), -1)["k"].alias("v")),
    )


def rename_identifiers(query: str | Column, tables: str | Column, columns: str | Column) -> Column:
    """Rename whole identifiers only: those before a dot by `tables`, the others by `columns`.

    Quoted text, numbers and keywords stay.
    """
    def look_up(mapping: Column, word: Column) -> Column:
        return F.coalesce(F.get(F.filter(mapping, lambda e: e["k"] == word), F.lit(0))["v"], word)

    def rename_all(tokens: Column) -> Column:
        def rename(word: Column, i: Column) -> Column:
            qualifies = F.coalesce(F.get(tokens, i + 1) == ".", F.lit(False))
            renamed = F.when(qualifies, look_up(_col(tables), word)).otherwise(look_up(_col(columns), word))
            return F.when(F.lower(word).isin(KEYWORDS), word).otherwise(renamed)

        return F.array_join(F.transform(tokens, rename), "")

    # as an element of an array the token list is computed once per row, not once per token
    return F.get(F.transform(F.array(F.regexp_extract_all(_col(query), F.lit(TOKEN), F.lit(0))), rename_all), F.lit(0))


def strip_placeholders(text: str | Column) -> Column:
    out = _col(text)
    for mark in PLACEHOLDERS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def strip_markers(text: str | Column) -> Column:
    """Remove the opening and closing markers around a placeholder."""
    out = _col(text)
    for mark in MARKERS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def format_gold_line(gold: str | Column, db_id: str | Column) -> Column:
    return F.concat_ws("\t", one_line(trim_space(gold)), _col(db_id))


def clean_prediction(pred: str | Column) -> Column:
    """One line, trimmed, up to the first tab."""
    return F.substring_index(trim_space(F.translate(_col(pred), "\n", " ")), "\t", 1)


def strip_qualifier(name: str | Column) -> Column:
    """`t.c` becomes `c`; a name without a dot stays."""
    return F.coalesce(F.get(F.split(_col(name), "\\."), F.lit(1)), _col(name))


def path_parts(path: str | Column) -> tuple[Column, Column]:
    """(database, table) from `.../<database>/<table>.<ext>`."""
    parts = F.split(_col(path), "/")
    return F.try_element_at(parts, F.lit(-2)), F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")


def flatten_name(db_id: str | Column, table: str | Column) -> Column:
    """File name of a table in a flat folder."""
    return F.concat(F.concat_ws("_", _col(db_id), _col(table)), F.lit(".csv"))


def column_key(table_index: str | Column, table_names: str | Column, column: str | Column) -> Column:
    """`__table.column__` in lower case; `__all__` for a negative table index."""
    idx = _col(table_index)
    named = F.lower(F.concat(F.lit("__"), F.get(_col(table_names), F.greatest(idx, F.lit(0))), F.lit("."), _col(column), F.lit("__")))
    return F.when(idx < 0, "__all__").otherwise(named)


def wrap_chat(prompt: str | Column, before: str, after: str) -> Column:
    """One user message in chat form; the role markers are the model's, so they are parameters."""
    return F.concat(F.lit(before), _col(prompt), F.lit(after))


def build_target(answer: str | Column, end_token: str) -> Column:
    return F.concat(_col(answer), F.lit("\n" + end_token))


def strip_answer_fence(answer: str | Column) -> Column:
    """Remove a leading sql fence and a closing fence, then trim."""
    a = F.regexp_replace(_col(answer), "^" + SQL_FENCE, "")
    return trim_space(F.regexp_replace(a, FENCE + "\\z", ""))


def pick(seed: int | str, keys: Sequence[str | Column], n: int) -> Column:
    """A reproducible number from 0 to n-1 for a key."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % n).cast("int")
