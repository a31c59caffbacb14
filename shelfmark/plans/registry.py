"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from shelfmark.plans import catalog_queries, file_queries, golden_queries, nested_queries

_MODULES = [nested_queries, catalog_queries, file_queries, golden_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
