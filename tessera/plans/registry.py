"""Registry of the engine's own queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its oracle SQL where there is one."""

    def put(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def _load() -> None:
    from tessera.plans import catalog_queries, compare_queries, extra_queries, graph_queries, model_queries, planning_queries, quality_queries, source_queries, stored_queries, trace_queries  # noqa: F401


_load()
