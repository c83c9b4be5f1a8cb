"""All registered queries."""

from __future__ import annotations

from cellweft.plans import corpus_queries, embedding_queries, sampling_queries, scoring_queries, storage_queries, text_queries
from cellweft.plans.registry import Query

PARTS = (corpus_queries.reg, sampling_queries.reg, text_queries.reg, scoring_queries.reg, embedding_queries.reg, storage_queries.reg)


def queries() -> dict[str, Query]:
    return {name: fn for part in PARTS for name, fn in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle.items()}
