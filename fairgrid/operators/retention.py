"""Retention and backfills: age, expiry, stale rows, eviction, orphans, geohashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import geo, temporal


def purge_older_than(events: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Events that start no earlier than ``days`` before ``as_of``."""
    return events.where(F.col("start_date") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def unexpired(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows whose expiry is after ``as_of``."""
    return events.where(temporal.ttl_epoch(F.col("start_date"), days) > F.unix_seconds(F.lit(as_of).cast("timestamp")))


def drop_stale(events: DataFrame, seen: DataFrame, as_of: str, complete: bool) -> DataFrame:
    """Drop future events that a complete snapshot didn't hold; an incomplete or empty one drops nothing."""
    if not complete:
        return events
    future = F.col("start_date") >= F.lit(as_of).cast("timestamp_ntz")
    seen_ids = seen.select("external_id", F.lit(True).alias("_seen")).distinct()
    some = seen.select(F.lit(True).alias("_any")).limit(1).agg(F.count(F.lit(1)).alias("_some"))  # one row
    told = events.join(seen_ids, "external_id", "left").join(F.broadcast(some))
    return told.where(~future | F.col("_seen").isNotNull() | (F.col("_some") == 0)).select(events.columns)


def cleanup_due(last_run: Column, as_of: Column, hours: int = 24) -> Column:
    """Whether a cleanup may run: never run before, or at least ``hours`` ago."""
    return F.coalesce(temporal.hours_since(last_run, as_of) >= hours, F.lit(True))


def drop_orphans(events: DataFrame, column: str = "shop_id") -> DataFrame:
    """Rows with a shop."""
    return events.where(F.col(column).isNotNull())


def evict_least_recent(cache: DataFrame, key: str, accessed: str, most: int = 10_000, batch: int = 100) -> DataFrame:
    """When ``cache`` holds more than ``most`` rows, drop the ``batch`` least recently used ones."""
    oldest = cache.orderBy(accessed, key).limit(batch).select(key)  # a top-k of ``batch`` rows
    over = cache.agg((F.count(F.lit(1)) > most).alias("_over"))
    return cache.join(F.broadcast(oldest.join(F.broadcast(over)).where("_over").select(key)), key, "left_anti")


def delete_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def backfilled(existing: Column, lat: Column, lng: Column, precision: int) -> Column:
    """The stored geohash, else the one of the coordinates."""
    return F.coalesce(existing, geo.geohash(lat, lng, precision))


RUN_LOG = "run_id long, at timestamp, status string, events_found long, events_created long, events_updated long, error_message string"


def run_transition(runs: DataFrame, run_id: int, status: str, as_of: str, found: int = 0, created: int = 0, updated: int = 0, error: str | None = None) -> DataFrame:
    """Append a run's new state to a log of ``RUN_LOG`` rows; :func:`latest_runs` reads it."""
    if status not in ("running", "completed", "failed"):
        raise ValueError(status)
    row = runs.sparkSession.createDataFrame([(run_id, as_of, status, found, created, updated, error)], RUN_LOG.replace("timestamp", "string"))
    return runs.unionByName(row.withColumn("at", F.to_timestamp("at")))


def latest_runs(log: DataFrame) -> DataFrame:
    """A row a run: its start, its end where it has one, and its last state."""
    last = F.max_by(F.struct("status", "events_found", "events_created", "events_updated", "error_message"), F.struct("at", (F.col("status") != "running").alias("ended")))
    told = log.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("completed_at"), last.alias("_l"))
    return told.select("run_id", "started_at", "completed_at", "_l.*")
