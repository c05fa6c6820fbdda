"""Queries by name, each (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows.

Query modules register themselves with `query`; importing this module imports them.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with SQL that DuckDB runs on the same tables (none where SQL is no match)."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


from . import admission, analysis, corpus, curation, evaluation, extras, incremental, matching, streams  # noqa: E402, F401
