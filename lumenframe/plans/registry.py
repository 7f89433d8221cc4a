"""The library's named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, neighbour_queries, series_queries, signal_queries, source_queries

_ALL = series_queries.Q | catalog_queries.Q | source_queries.Q | neighbour_queries.Q | signal_queries.Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
