"""The registered queries over the given tables, and the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register
