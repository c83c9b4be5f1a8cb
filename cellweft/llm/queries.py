"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import alignment, bpe, chat, decontamination, exact_dedup, jaccard_join, language_id, licenses, nearest, repair, sharding, suffix_dedup, token_files
from cellweft.llm.common import documents
from cellweft.plans.registry import Registry

reg = Registry()


@reg.query(
    "op1_chat_formatting",
    r"""
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + 2 * length(text) - length(translate(text, '\<>', '')) + 16)::BIGINT AS formatted_chars,
      1 AS rank
    FROM turns GROUP BY conv_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(extra))


@reg.query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("own")


@reg.query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@reg.query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def _license_sql() -> str:
    """Base phrases and notices looked up word by word; a notice may be off by its edits, counted over all windows of its length and one word more or less."""
    base = ", ".join(f"({i}, '{phrase}', '{label}')" for i, (phrase, label) in enumerate(licenses.BASE))
    notices = ", ".join(f"({i}, '{phrase}', '{label}', '{core}')" for i, (phrase, label, core) in enumerate(licenses.TEMPLATES))
    return rf"""
    WITH base(number, phrase, label) AS (VALUES {base}), notices(number, phrase, label, core) AS (VALUES {notices}),
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    places AS (SELECT doc_id, label, i - 1 AS place FROM w, base, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i : i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
    found AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
    maybe AS (SELECT doc_id, w, number, label, core, string_split(phrase, ' ') AS p, len(string_split(phrase, ' ')) // {licenses.WORDS_PER_EDIT} AS edits
      FROM w, notices WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || core || ' ')),
    windows AS (SELECT doc_id, number, label, core, p, edits, i, w[i : i + len(p) + d - 1] AS x FROM maybe, unnest(range(1, len(w) + 1)) AS t(i), unnest([-1, 0, 1]) AS u(d)
      WHERE abs(d) <= edits AND i + len(p) + d - 1 <= len(w)),
    off AS (SELECT *, levenshtein(array_to_string(list_transform(x, lambda y: chr(CAST(20000 + coalesce(list_position(list_distinct(list_sort(p)), y), 0) AS INTEGER))), ''),
        array_to_string(list_transform(p, lambda y: chr(CAST(20000 + list_position(list_distinct(list_sort(p)), y) AS INTEGER))), '')) AS wrong
      FROM windows WHERE contains(' ' || array_to_string(x, ' ') || ' ', ' ' || core || ' ')),
    extra AS (SELECT doc_id, list(DISTINCT label) AS labels, max(1 - wrong / len(p)) AS best FROM off WHERE wrong <= edits GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
      last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(found.labels, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(found.labels, []), coalesce(extra.labels, [])))), ',') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN found USING (doc_id) LEFT JOIN extra USING (doc_id)
    """


@reg.query("op5_license_scan", _license_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@reg.query("op6_nearest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(documents(spark, sf_dir, "embeddings"))


@reg.query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@reg.query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


@reg.query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )


@reg.query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_texts(documents(spark, sf_dir)).drop("own", "group")


@reg.query(
    "op11_exact_dedup",
    r"""
    WITH keyed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
    FROM keyed WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


@reg.query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damaged(documents(spark, sf_dir, "conversations")))


@reg.query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
