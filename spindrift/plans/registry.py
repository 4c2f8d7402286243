"""Registered queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import array_queries, event_queries, model_queries, signal_queries, source_queries  # noqa: E402,F401
