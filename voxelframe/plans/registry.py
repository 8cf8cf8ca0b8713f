"""Names of queries, their Spark form and, where SQL can express it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Query, views: list[str] | None = None, sql: str | None = None, recursive: bool = False) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_views(views, sql, recursive) if views else sql
