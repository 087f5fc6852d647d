"""Registered queries over the test tables and their DuckDB oracle SQL."""
from .registry import oracle_sql, queries  # noqa: F401
