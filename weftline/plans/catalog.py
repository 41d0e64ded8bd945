"""Registered reference-parity queries and their DuckDB equivalents."""

from __future__ import annotations

from weftline.plans import accounting_queries, collective_queries, shuffle_queries

MODULES = (shuffle_queries, collective_queries, accounting_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
