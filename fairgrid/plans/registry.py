"""Registration of queries: a function over views and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairgrid.plans.views import TABLES, ctes, frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named tables and views under its own name, and the SQL that follows their CTEs."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(*frames(spark, sf_dir, *views))
        if sql:
            SQL[build.__name__] = sql if set(views) <= set(TABLES) else ctes(*views) + sql
        return build

    return register
