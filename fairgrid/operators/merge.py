"""Snapshot merges: canonical rows, change detection, upserts, insert-ignore."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import geo, text
from fairgrid.operators.calendar import first_in_group
from fairgrid.operators.search import if_small
from fairgrid.schema import COMPARED_SHOP

#: Where an event's own page is.
EVENT_PAGES = "https://events.example.org/"


def canonical_events(raw: DataFrame, templates: DataFrame) -> DataFrame:
    """Wire events (one row each, as in ``schema.WIRE_EVENT``) to event rows; ``templates`` is (id, name)."""
    known = templates.select(F.col("id").alias("event_configuration_template"), text.template_category(F.col("name")).alias("_category")).where("_category is not null")
    rows = raw.join(if_small(known), "event_configuration_template", "left")
    address = F.coalesce("full_address", "store.full_address")
    latitude, longitude = F.coalesce("latitude", "store.latitude"), F.coalesce("longitude", "store.longitude")
    return rows.select(
        F.col("id").cast("string").alias("external_id"), "name", "description", F.col("store.name").alias("location"), address.alias("address"),
        text.city_from_address(address, F.col("store.city"), F.col("store.state")).alias("city"), F.col("store.state").alias("state"), F.col("store.country").alias("country"),
        latitude.alias("latitude"), longitude.alias("longitude"),
        F.try_to_timestamp("start_datetime").alias("start_date"), F.lit(None).cast("string").alias("start_time"), F.try_to_timestamp("end_datetime").alias("end_date"),
        F.coalesce("_category", text.infer_category(F.col("name"), F.col("description"))).alias("event_type"), F.col("store.name").alias("organizer"),
        F.col("registered_user_count").alias("player_count"), "capacity", text.format_price(F.col("cost_in_cents"), F.col("currency")).alias("price"),
        F.concat(F.lit(EVENT_PAGES), F.col("id").cast("string")).alias("url"), F.col("full_header_image_url").alias("image_url"), F.col("store.id").cast("string").alias("shop_id"),
        geo.geohash(latitude, longitude, 3).alias("geohash3"), F.col("store.name").alias("shop_name"), F.col("store.latitude").alias("shop_latitude"), F.col("store.longitude").alias("shop_longitude"),
    )


def last_of_batch(incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key the last in batch order wins."""
    return first_in_group(incoming, [F.col(key)], [F.desc(c) for c in order])


def changed(left: str, right: str, columns: list[str]) -> Column:
    """Some compared column differs; null equals null only."""
    return reduce(or_, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def without_key(incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows that no merge can take, since their key is null."""
    return incoming.where(F.col(key).isNull())


def merge(stored: DataFrame, incoming: DataFrame, key: str, compared: list[str], as_of: object = None) -> DataFrame:
    """Post-state with ``_status``: ``kept`` (not incoming), ``created``, ``skipped`` (nothing changed) or ``updated``.

    ``incoming`` has one row a key; rows with a null key are left out, see :func:`without_key`. Columns of ``stored``
    that ``incoming`` lacks keep their stored values. With ``as_of``, new rows get it as ``created_at`` and new and
    updated ones as ``updated_at`` and ``scraped_at``, where ``stored`` has these columns and ``incoming`` doesn't.
    """
    s, i = stored.withColumn("_stored", F.lit(True)).alias("s"), incoming.where(F.col(key).isNotNull()).withColumn("_incoming", F.lit(True)).alias("i")
    both = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    is_new, is_gone = F.col("s._stored").isNull(), F.col("i._incoming").isNull()
    status = F.when(is_gone, "kept").when(is_new, "created").when(changed("s", "i", compared), "updated").otherwise("skipped")
    out = []
    for c in stored.columns:
        if c not in incoming.columns:
            at = {"created_at": status == "created", "updated_at": status.isin("created", "updated"), "scraped_at": status.isin("created", "updated")}.get(c)
            own = F.col(f"s.{c}")
            out.append((own if as_of is None or at is None else F.when(at, F.lit(as_of).cast(stored.schema[c].dataType)).otherwise(own)).alias(c))
        else:
            out.append(F.when(status.isin("kept", "skipped"), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c))
    return both.select(*out, status.alias("_status"))


def status_counts(merged: DataFrame) -> DataFrame:
    """Rows by status."""
    return merged.groupBy("_status").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_status", "status")


def wire_shops(raw: DataFrame) -> DataFrame:
    """The stores of wire events as shop rows, each once, the last in order of the rows' ``page`` and ``position`` winning: ``shop_id, name, location_text, latitude, longitude, geohash3, geohash4``.

    Stores without an id are left out; a zero or missing coordinate has no geohash.
    """
    last = raw.where("store.id is not null").groupBy(F.col("store.id").alias("shop_id")).agg(F.max_by("store", F.struct("page", "position")).alias("s"))
    lat, lng = F.nullif(F.col("s.latitude"), F.lit(0.0)), F.nullif(F.col("s.longitude"), F.lit(0.0))
    return last.select("shop_id", "s.name", F.col("s.full_address").alias("location_text"), "s.latitude", "s.longitude", geo.geohash(lat, lng, 3).alias("geohash3"), geo.geohash(lat, lng, 4).alias("geohash4"))


def merge_shops(stored: DataFrame, incoming: DataFrame, as_of: object = None) -> DataFrame:
    """:func:`merge` of shops on all compared columns, with ``needs_city``, null for shops that don't come in.

    What is written has its geocode completed and no error; a skipped shop keeps both, and all keep their display city.
    """
    merged = merge(stored, incoming, "shop_id", COMPARED_SHOP, as_of)
    written = F.col("_status").isin("created", "updated")
    done = merged.withColumn("geocode_status", F.when(written, F.lit("completed")).otherwise(F.col("geocode_status"))).withColumn("geocode_error", F.when(~written, F.col("geocode_error")))
    return done.withColumn("needs_city", F.when(F.col("_status") != "kept", text.blank_to_null(F.col("display_city")).isNull()))


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``target`` and the first incoming row of each new key."""
    fresh = first_in_group(incoming, [F.col(key)], [F.col(c) for c in order]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(target.columns))


def ingestion_counters(merged: DataFrame, incoming: DataFrame, store: str = "shop_name") -> DataFrame:
    """One row: found, created, updated, skipped, stores by name, and the rounded percent skipped."""
    told = merged.agg(*(F.count_if(F.col("_status") == s).alias(s) for s in ("created", "updated", "skipped")))
    stores = incoming.agg(F.count(F.lit(1)).alias("found"), F.count_distinct(store).alias("stores"))
    return stores.join(F.broadcast(told)).withColumn("skip_rate", F.floor(F.try_divide(100.0 * F.col("skipped"), F.col("found")) + 0.5))  # one row each
