"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from lexipress.plans import table_queries, text_queries


def queries() -> dict:
    return text_queries.QUERIES | table_queries.QUERIES


def oracle_sql() -> dict:
    return text_queries.SQL | table_queries.SQL
