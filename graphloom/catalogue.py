"""Every query over the driver's tables, by name, with its SQL."""

from __future__ import annotations

from .plans import assurance_queries, graph_queries, operator_queries, parse_queries, text_queries

_PARTS = (graph_queries, text_queries, parse_queries, operator_queries, assurance_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
