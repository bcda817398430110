"""Every query over the driver's tables, by name, and its SQL."""

from __future__ import annotations

from partloom.plans import assembly_queries, detail_queries, exchange_queries, mesh_queries, numeric_queries, plumbing_queries, source_queries, stats_queries, summary_queries

MODULES = (assembly_queries, stats_queries, plumbing_queries, numeric_queries, summary_queries, detail_queries, source_queries, exchange_queries, mesh_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
