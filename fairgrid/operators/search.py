"""Event search: optional filters, radius, order, paging, totals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import geo, text
from fairgrid.schema import EventQuery

#: A dimension of at most this many bytes by the optimiser (compressed, for Parquet) is broadcast; larger ones are left to adaptive execution.
BROADCAST_BYTES = 8 << 20


def if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where the optimiser's size for it is within BROADCAST_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def event_predicates(q: EventQuery, as_of: str | None = None) -> list[Column]:
    """Conjuncts on event columns; a default window needs ``as_of`` where a bound is missing."""
    if q.default_window_days and as_of is None and not (q.start_from and q.start_to):
        raise ValueError("a default window needs as_of")
    out = [text.contains_text(F.col(c), getattr(q, c), q.wildcards) for c in ("city", "state", "country") if getattr(q, c)]
    if q.search:
        out.append(reduce(lambda a, b: a | b, [text.contains_text(F.col(c), q.search, q.wildcards) for c in ("name", "description", "location")]))
    start = F.col("start_date")
    low, high = q.start_from, q.start_to
    if low:
        out.append(start >= F.lit(low).cast("timestamp_ntz"))
    elif q.default_window_days:
        out.append(start >= F.lit(as_of).cast("timestamp_ntz"))
    if high:
        out.append(start <= F.lit(high).cast("timestamp_ntz"))
    elif q.default_window_days:
        out.append(start <= F.lit(as_of).cast("timestamp_ntz") + F.expr(f"interval {int(q.default_window_days)} days"))
    if q.event_type:
        out.append(F.col("event_type") == q.event_type)
    return out


def matching(events: DataFrame, shops: DataFrame, q: EventQuery, as_of: str | None = None) -> DataFrame:
    """All matching events with their shop's coordinates; ``distance_km`` where a point is given."""
    found = events.where(reduce(and_, event_predicates(q, as_of), F.lit(True)))
    near = shops.select("shop_id", F.col("latitude").alias("shop_latitude"), F.col("longitude").alias("shop_longitude"))
    if q.lat is None or q.lng is None:
        return found.join(if_small(near), "shop_id", "left")
    lat, lng = F.col("shop_latitude"), F.col("shop_longitude")
    boxed = near.where(geo.in_box(lat, lng, geo.bounding_box(q.lat, q.lng, q.radius_km, exact=True)))
    boxed = boxed.withColumn("distance_km", geo.haversine_km(F.lit(q.lat), F.lit(q.lng), lat, lng)).where(F.col("distance_km") <= q.radius_km)
    return found.join(if_small(boxed), "shop_id")


def total(events: DataFrame, shops: DataFrame, q: EventQuery, as_of: str | None = None) -> DataFrame:
    """Count before paging and pages of ``limit``; the shops are joined only where a filter needs them."""
    rows = matching(events, shops, q, as_of) if q.lat is not None else events.where(reduce(and_, event_predicates(q, as_of), F.lit(True)))
    counted = rows.agg(F.count(F.lit(1)).alias("total"))
    return counted.withColumn("pages", F.ceil(F.try_divide(F.col("total"), F.lit(q.limit))).cast("long"))


def page(found: DataFrame, q: EventQuery) -> DataFrame:
    """The asked page in order of start, ties by id."""
    limit, offset = q.window
    return found.orderBy("start_date", "external_id").offset(offset).limit(limit)


def search(events: DataFrame, shops: DataFrame, q: EventQuery, as_of: str | None = None) -> DataFrame:
    """Filter, join, order and page."""
    return page(matching(events, shops, q, as_of), q)


def by_id(events: DataFrame, external_id: int | str) -> DataFrame:
    """The event with this id."""
    return events.where(F.col("external_id") == external_id)


def in_cells(rows: DataFrame, cells: list[str], precision: int = 3, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Rows whose geohash is one of ``cells``."""
    return rows.where(geo.geohash(F.col(lat), F.col(lng), precision).isin(cells))


def events_for_shops(events: DataFrame, shops: DataFrame, start: str, end: str) -> DataFrame:
    """Events of the given shops between two times."""
    inside = F.col("start_date").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return events.where(inside).join(if_small(shops.select("shop_id").distinct()), "shop_id", "left_semi")


def events_by_day(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events on whole days from start to end."""
    return events.where(F.to_date("start_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
