"""Every registered query of the engine and the SQL beside it."""

from __future__ import annotations

from folia.plans import document_queries, layout_queries, ledger_queries, match_queries, row_queries, text_queries

MODULES = [text_queries, match_queries, layout_queries, row_queries, ledger_queries, document_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}


def flagship(spark, sf_dir: str):
    """The candidate of each document line: trigram votes, suppression of near diagonals, best first."""
    return match_queries.candidate_topk_nms(spark, sf_dir)
