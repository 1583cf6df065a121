"""Queries over the test tables, each with its oracle SQL. Import loomspan.plans.catalog to fill it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) and, where SQL can express it, its DuckDB text."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep
