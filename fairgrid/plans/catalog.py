"""The registry of the calendar engine's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairgrid.plans import geo_queries, ingest_queries, log_queries, search_queries, store_queries, upkeep_queries
from fairgrid.plans.registry import QUERIES, SQL

_MODULES = (geo_queries, ingest_queries, log_queries, search_queries, store_queries, upkeep_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by name."""
    return dict(SQL)
