"""All registered queries of the core library, and their SQL."""

from __future__ import annotations

from textloom.plans import function_queries, generator_queries, metric_queries, pair_queries, retrieval_queries, text_queries

FLAGSHIP = "bm25_top1"
_FAMILIES = (text_queries, pair_queries, retrieval_queries, metric_queries, generator_queries, function_queries)
QUERIES: dict = {name: f for m in _FAMILIES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: q for m in _FAMILIES for name, q in m.ORACLE_SQL.items()}
