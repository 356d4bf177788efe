"""Queries for the reference's own operators and problem 1, with their SQL."""

from __future__ import annotations

from lexmill.operators import orphans
from lexmill.plans import audit_queries, graph_queries, model_queries, retrieval_queries, source_queries, text_queries
from lexmill.session import table


def p1_found(spark, root):
    return orphans.legal_orphans(*(table(spark, root, n) for n in ("clause_analyses", "gold_queries", "statute_articles", "judgement_chunks")))


def p1_counts(spark, root):
    return orphans.orphan_counts(p1_found(spark, root), "src_table", "month_key")


_PARTS = (text_queries, retrieval_queries, graph_queries, model_queries, audit_queries, source_queries)
QUERIES: dict = {"p1_found": p1_found, "p1_counts": p1_counts}
SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
