"""Calendar views: duplicates, full events, records, days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairgrid.functions import temporal, text


def first_in_group(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_latest(events: DataFrame) -> DataFrame:
    """One event of each place, name and start: the latest created, of equals the first seen (least id)."""
    place = F.coalesce(text.blank_to_null(F.col("location")), text.blank_to_null(F.col("organizer")), F.lit(""))
    return first_in_group(events, [place, F.col("name"), F.col("start_date")], [F.desc("created_at"), F.col("external_id")])


def is_full(players: Column, capacity: Column) -> Column:
    """Every seat is taken; unknown or zero capacity is never full."""
    return F.coalesce((capacity > 0) & (players >= capacity), F.lit(False))


def hide_full(events: DataFrame) -> DataFrame:
    """Events with a seat left."""
    return events.where(~is_full(F.col("player_count"), F.col("capacity")))


def records(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """What a calendar shows: id, title, start, colour."""
    colours = F.create_map(*(F.lit(x) for kv in text.COLOURS.items() for x in kv))
    colour = F.coalesce(F.try_element_at(colours, F.coalesce("event_type", F.lit(text.OTHER))), F.lit(text.COLOURS[text.OTHER]))
    title = text.event_title(temporal.local_time(F.col("start_date"), zone), F.col("organizer"), F.col("city"))
    return events.select("external_id", title.alias("title"), F.col("start_date").alias("start"), colour.alias("colour"))


def on_day(events: DataFrame, day: str) -> DataFrame:
    """Events of one UTC day by start and id."""
    return events.where(F.to_date("start_date") == F.to_date(F.lit(day))).orderBy("start_date", "external_id")
