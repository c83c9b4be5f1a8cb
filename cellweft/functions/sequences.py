"""Functions on token-id arrays as Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The id that stands for a vector to be put in, and the label that the loss ignores.
PLACEHOLDER_ID = -114
IGNORE_LABEL = -100


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), "[ \\t\\r\\n\\f]+"), lambda w: w != "")


def hashed_ids(tokens: str | Column, vocab_size: int, first_id: int = 0) -> Column:
    """Ids from the hash of each token: no vocabulary, so no shuffle and no join."""
    return F.transform(
        _col(tokens),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % vocab_size + first_id).cast("int"),
    )


def mask_prompt_labels(ids: str | Column, prompt_len: str | Column) -> Column:
    """Labels are the ids with the prompt's part ignored."""
    x, n = _col(ids), F.least(_col(prompt_len), F.size(_col(ids)))
    return F.concat(F.array_repeat(F.lit(IGNORE_LABEL), n), F.slice(x, n + 1, F.size(x)))


def interleave_placeholder(pieces: str | Column, bos_id: int | None = None) -> Column:
    """Join id arrays of the pieces of a prompt with the placeholder id, keeping one leading BOS id."""

    def join(p: Column) -> Column:
        if bos_id is None:
            return F.flatten(F.transform(p, lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(PLACEHOLDER_ID)), x)).otherwise(x)))
        starts = F.coalesce(F.get(F.get(p, F.lit(0)), F.lit(0)) == bos_id, F.lit(False))
        rest = lambda x: F.when(starts, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))).otherwise(x)
        return F.flatten(
            F.transform(p, lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(PLACEHOLDER_ID)), rest(x))).otherwise(x))
        )

    # as an element of an array the pieces are computed once per row, not once per piece
    return F.get(F.transform(F.array(_col(pieces)), join), F.lit(0))


def truncate_ids(ids: str | Column, max_len: int) -> Column:
    return F.slice(_col(ids), 1, max_len)


def pad_ids(ids: str | Column, length: str | Column, pad: int, left: bool = False) -> Column:
    x = _col(ids)
    fill = F.array_repeat(F.lit(pad), (_col(length) - F.size(x)).cast("int"))
    return F.concat(fill, x) if left else F.concat(x, fill)


def attention_mask(ids: str | Column, pad: int) -> Column:
    return F.transform(_col(ids), lambda x: (x != pad).cast("int"))


def non_pad_length(ids: str | Column, pad: int) -> Column:
    return F.size(F.filter(_col(ids), lambda x: x != pad))


def cut_at_stop(ids: str | Column, stop_ids: Sequence[int]) -> Column:
    """Ids before the first stop id."""
    x = _col(ids)
    at = F.array_min(
        F.filter(F.array(*[F.array_position(x, F.lit(s)) for s in stop_ids]), lambda p: p > 0)
    )
    return F.slice(x, F.lit(1), F.coalesce(at.cast("int") - 1, F.size(x)))


def splice_placeholders(ids: str | Column, labels: str | Column, k: int) -> Column:
    """Labels after each placeholder position became k ignored positions."""
    pairs = F.arrays_zip(_col(ids).alias("i"), _col(labels).alias("l"))
    ignored = F.array_repeat(F.lit(IGNORE_LABEL), k)
    return F.flatten(F.transform(pairs, lambda p: F.when(p["i"] == PLACEHOLDER_ID, ignored).otherwise(F.array(p["l"]))))


def id_text(ids: str | Column) -> Column:
    return F.array_join(F.transform(_col(ids), lambda x: x.cast("string")), " ")
