"""All core queries and their SQL, by name."""

from __future__ import annotations

from lexitide.plans import context_queries, delivery_queries, io_queries, series_queries, text_queries, vector_queries

MODULES = (text_queries, series_queries, context_queries, vector_queries, delivery_queries, io_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
