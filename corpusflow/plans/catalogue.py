"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from corpusflow.plans import q_feed, q_sources, q_stats, q_streams, q_text

FAMILIES = (q_feed, q_stats, q_text, q_sources, q_streams)


def queries() -> dict:
    return {k: f for family in FAMILIES for k, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for family in FAMILIES for k, sql in family.SQL.items()}
