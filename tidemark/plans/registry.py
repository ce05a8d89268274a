"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from tidemark.plans import entity_queries, history_queries, kept_queries, pass_queries, result_queries, row_queries, scalar_queries, scan_queries, spatial_queries

_MODULES = (history_queries, entity_queries, spatial_queries, result_queries, scalar_queries, pass_queries, row_queries, scan_queries, kept_queries)

QUERIES = {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
