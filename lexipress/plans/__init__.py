"""Registered queries and their DuckDB counterparts, by area."""
