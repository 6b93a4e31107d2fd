"""Names of the engine's queries: each with a function (spark, sf_dir) -> DataFrame and, where SQL has it, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its DuckDB statement."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def statement(name: str) -> str:
    """The statement of a query that is registered already."""
    return _ORACLES[name]


def queries() -> dict[str, Query]:
    from fieldglass import plans

    plans.load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
