"""Every query of the library by name, and its SQL for a second engine."""

from __future__ import annotations

from corpusql.operators import index_queries, report_queries, result_queries, search_queries, stats_queries, store_queries, version_queries

_MODULES = (index_queries, report_queries, result_queries, search_queries, stats_queries, store_queries, version_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
