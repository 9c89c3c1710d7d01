"""A register of queries: name, function, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return queries, sqls, query
