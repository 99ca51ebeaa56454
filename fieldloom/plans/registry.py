"""Queries over the test tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f
    return add


from fieldloom.plans import catalogue_queries, context_queries, keyed_queries, log_queries, run_queries, text_queries  # noqa: E402, F401
