"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _SQL


def load() -> None:
    """Registers every query of the library."""
    from . import eval_queries, fit_queries, history_queries, model_queries, person_queries, search_queries, store_queries  # noqa: F401
