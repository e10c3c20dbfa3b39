"""Where queries and their SQL meet under one name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function (spark, sf) -> DataFrame under its name, with its DuckDB SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
