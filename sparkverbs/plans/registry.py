"""Name -> query and name -> SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bundle import Bundle, load_bundle

_QUERIES: dict[str, Callable[[Bundle], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table bundle under a name."""

    def add(f: Callable[[Bundle], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, folder: f(load_bundle(spark, folder))

    return {name: bind(f) for name, f in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
