"""Queries of event search and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import temporal, text
from fairgrid.operators import calendar, search
from fairgrid.plans.registry import query
from fairgrid.schema import EventQuery

AS_OF = "2024-01-15 00:00:00"


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """SQL of the haversine distance."""
    a = f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2))"
    return f"(2 * 6371.0e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def _told(df: DataFrame) -> DataFrame:
    return df.select("external_id", "shop_id", "start_date", "name", F.round("distance_km", 6).alias("distance_km"))


def near_sql(radius_km: int) -> str:
    """SQL of all events in a circle around one point."""
    return f"""SELECT e.external_id, e.shop_id, e.start_date, e.name, round({km("40.0e0", "-95.0e0", "latitude", "longitude")}, 6) AS distance_km
FROM cal_events e JOIN shops s ON e.shop_id = s.shop_id WHERE latitude IS NOT NULL AND {km("40.0e0", "-95.0e0", "latitude", "longitude")} <= {radius_km}"""


NEAR = near_sql(500)


@query("cal_events", "shops", sql=f"SELECT * FROM ({near_sql(2500)}) WHERE contains(lower(name), 'nexus night') AND start_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY start_date, external_id LIMIT 20")
def search_radius(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Text, dates and radius together, first page."""
    return _told(search.search(events, shops, EventQuery(search="nexus NIGHT", lat=40.0, lng=-95.0, radius_km=2500, start_from="2024-01-05", start_to="2024-01-25")))


@query("cal_events", "shops", sql=NEAR)
def bbox_prefilter(events: DataFrame, shops: DataFrame) -> DataFrame:
    """All events in the circle, by box and exact distance."""
    return _told(search.matching(events, shops, EventQuery(lat=40.0, lng=-95.0, radius_km=500)))


@query("cal_events", "shops", sql="SELECT external_id, name FROM cal_events WHERE contains(lower(name), 'deck_box') OR contains(lower(description), 'deck_box') OR contains(lower(location), 'deck_box')")
def search_text_multi(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Literal text over name, description and location."""
    return search.matching(events, shops, EventQuery(search="DECK_box")).select("external_id", "name")


@query("cal_events", "shops", sql="SELECT external_id, name FROM cal_events WHERE name ILIKE '%N_ght%' OR description ILIKE '%N_ght%' OR location ILIKE '%N_ght%'")
def search_wildcard_mode(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Wildcards live in the term."""
    return search.matching(events, shops, EventQuery(search="N_ght", wildcards=True)).select("external_id", "name")


@query("cal_events", "shops", sql="SELECT external_id, city, state, country FROM cal_events WHERE contains(lower(city), 'city1') AND contains(lower(state), 'state') AND contains(lower(country), 'österreich')")
def search_city_state_country(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Three place filters, case folded beyond ASCII."""
    return search.matching(events, shops, EventQuery(city="CITY1", state="state", country="ÖSTERREICH")).select("external_id", "city", "state", "country")


@query("cal_events", "shops", sql="SELECT external_id, start_date FROM cal_events WHERE start_date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND event_type = 'Nexus Night'")
def search_date_range(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Inclusive dates and one type."""
    return search.matching(events, shops, EventQuery(start_from="2024-01-10", start_to="2024-01-12", event_type="Nexus Night")).select("external_id", "start_date")


@query("cal_events", "shops", sql=f"SELECT external_id FROM cal_events WHERE start_date BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 90 DAY")
def search_default_window(events: DataFrame, shops: DataFrame) -> DataFrame:
    """From now to 90 days on where no dates are given."""
    return search.matching(events, shops, EventQuery(default_window_days=90), AS_OF).select("external_id")


@query("cal_events", "shops", sql=f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM ({NEAR})")
def search_total(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Total and pages before paging."""
    return search.total(events, shops, EventQuery(lat=40.0, lng=-95.0, radius_km=500))


@query("cal_events", "shops", sql="SELECT external_id, start_date FROM cal_events ORDER BY start_date, external_id LIMIT 20 OFFSET 20")
def search_page2(events: DataFrame, shops: DataFrame) -> DataFrame:
    """The second page."""
    return search.search(events, shops, EventQuery(page=2)).select("external_id", "start_date")


@query("cal_events", "shops", sql="SELECT external_id FROM cal_events ORDER BY start_date, external_id LIMIT 1000")
def search_calendar_mode(events: DataFrame, shops: DataFrame) -> DataFrame:
    """The calendar's first thousand."""
    return search.search(events, shops, EventQuery(calendar_mode=True, page=3)).select("external_id")


@query("cal_events", sql="SELECT count(*) AS total, count(*) >= 1000 AS too_many FROM cal_events")
def too_many_flag(events: DataFrame) -> DataFrame:
    """Whether the calendar's cap is reached."""
    return events.agg(F.count(F.lit(1)).alias("total")).withColumn("too_many", F.col("total") >= 1000)


@query("cal_events", sql="SELECT external_id, name FROM cal_events WHERE external_id = 17")
def event_by_id(events: DataFrame) -> DataFrame:
    """Point look-up."""
    return search.by_id(events, 17).select("external_id", "name")


@query("cal_events", "shops", sql="SELECT e.external_id, s.latitude AS shop_latitude, s.longitude AS shop_longitude FROM cal_events e LEFT JOIN shops s ON e.shop_id = s.shop_id")
def left_join_shops(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Every event with its shop's coordinates."""
    return search.matching(events, shops, EventQuery()).select("external_id", "shop_latitude", "shop_longitude")


@query("cal_events", "shops", sql="SELECT external_id FROM cal_events WHERE shop_id IN (SELECT shop_id FROM shops WHERE state LIKE '%A%') AND start_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'")
def events_for_shops(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Events of chosen shops in a range."""
    return search.events_for_shops(events, shops.where(F.col("state").contains("A")), "2024-01-03", "2024-01-20").select("external_id")


@query("cal_events", sql="SELECT external_id FROM cal_events WHERE CAST(start_date AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
def events_by_whole_days(events: DataFrame) -> DataFrame:
    """Day-granular range."""
    return search.events_by_day(events, "2024-01-03", "2024-01-05").select("external_id")


@query("runs", "cal_events", sql="SELECT (SELECT max(completed_at) FROM runs WHERE status = 'completed') AS last_scrape_at, count(*) AS total_events FROM cal_events")
def scrape_info(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Latest completed run and number of events."""
    last = runs.where("status = 'completed'").agg(F.max("completed_at").alias("last_scrape_at"))
    return last.join(F.broadcast(events.agg(F.count(F.lit(1)).alias("total_events"))))  # one row each


@query("runs", sql="SELECT run_id, started_at, completed_at FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 20) WHERE status = 'completed' ORDER BY started_at DESC, run_id LIMIT 1")
def latest_completed_of_newest(runs: DataFrame) -> DataFrame:
    """First completed of the 20 newest runs."""
    newest = runs.orderBy(F.desc("started_at"), "run_id").limit(20)
    return newest.where("status = 'completed'").orderBy(F.desc("started_at"), "run_id").limit(1).select("run_id", "started_at", "completed_at")


@query("runs", sql="SELECT run_id, started_at, status, events_found FROM runs ORDER BY started_at DESC, run_id LIMIT 15")
def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest 15 runs."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(15).select("run_id", "started_at", "status", "events_found")


LATEST = "SELECT * FROM cal_events QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(location, ''), nullif(organizer, ''), ''), name, start_date ORDER BY created_at DESC, external_id) = 1"


@query("cal_events", sql=f"SELECT external_id, name FROM ({LATEST})")
def keep_latest_dedupe(events: DataFrame) -> DataFrame:
    """One event of each place, name and start."""
    return calendar.keep_latest(events).select("external_id", "name")


@query("documents", sql="SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) = 1")
def keep_first_text(docs: DataFrame) -> DataFrame:
    """First row of each text."""
    best = docs.groupBy(F.sha2("text", 256).alias("_text")).agg(F.min_by("source", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("source"), F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id"))
    return best.select("doc_id", "source")  # texts are told apart by digest, so no text is shuffled


@query("cal_events", sql="SELECT external_id, player_count, capacity FROM cal_events WHERE NOT coalesce(capacity > 0 AND player_count >= capacity, false)")
def hide_full(events: DataFrame) -> DataFrame:
    """Events with a seat left."""
    return calendar.hide_full(events).select("external_id", "player_count", "capacity")


@query("cal_events", sql=f"""SELECT external_id, strftime(start_date, '%-I:%M %p') || ' | ' || coalesce(nullif(organizer, ''), nullif(city, ''), 'Event') AS title, start_date AS start,
CASE coalesce(event_type, 'Other') WHEN 'Nexus Night' THEN '#bd93f9' WHEN 'Summoner Skirmish' THEN '#ff79c6' WHEN 'Pre-Rift' THEN '#73d393' ELSE '#6272a4' END AS colour
FROM ({LATEST}) WHERE NOT coalesce(capacity > 0 AND player_count >= capacity, false)""")
def calendar_records(events: DataFrame) -> DataFrame:
    """Deduplicated, open events as calendar records."""
    return calendar.records(calendar.hide_full(calendar.keep_latest(events)))


@query("cal_events", sql="SELECT external_id, start_date FROM cal_events WHERE CAST(start_date AS DATE) = DATE '2024-01-09' ORDER BY start_date, external_id")
def day_listing(events: DataFrame) -> DataFrame:
    """One day's events."""
    return calendar.on_day(events, "2024-01-09").select("external_id", "start_date")


@query("cal_events", sql="""SELECT DISTINCT CAST(CAST(date_trunc('month', CAST(start_date AS DATE) - INTERVAL 1 MONTH) AS DATE) AS STRING) AS first_day, CAST(CAST(last_day(CAST(start_date AS DATE) + INTERVAL 2 MONTH) AS DATE) AS STRING) AS last_day, CAST(CAST(start_date AS DATE) AS STRING) AS day,
strftime(start_date, '%Y-%m') AS month FROM cal_events""")
def month_bounds(events: DataFrame) -> DataFrame:
    """The calendar's range for each day."""
    first, last = temporal.month_bounds(F.col("day"))
    return events.select(F.to_date("start_date").alias("day"), temporal.month_key(F.col("start_date")).alias("month")).distinct().select(
        first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), F.col("day").cast("string").alias("day"), "month"
    )


@query("cal_events", sql="SELECT external_id, strftime(start_date - INTERVAL 5 HOUR, '%-I:%M %p') AS local_time FROM cal_events")
def local_time_format(events: DataFrame) -> DataFrame:
    """Start in New York's (winter) time."""
    return events.select("external_id", temporal.local_time(F.col("start_date"), "America/New_York").alias("local_time"))


@query("cal_events", sql="SELECT external_id, coalesce(CAST(player_count AS STRING), '?') || '/' || coalesce(CAST(capacity AS STRING), '?') AS occupancy, concat_ws(', ', nullif(location, ''), nullif(city, ''), nullif(state, '')) AS label FROM cal_events")
def occupancy_and_label(events: DataFrame) -> DataFrame:
    """Seats and place label."""
    label = text.display_name(F.col("location"), F.col("city"), F.col("state"), distinct=False)
    return events.select("external_id", text.occupancy(F.col("player_count"), F.col("capacity")).alias("occupancy"), label.alias("label"))


@query("cal_events", sql="""SELECT external_id, CASE WHEN regexp_matches(name || ' ' || coalesce(description, ''), '(?i)pre[\\s-]?rift') THEN 'Pre-Rift' WHEN contains(lower(name), 'summoner skirmish') THEN 'Summoner Skirmish'
WHEN contains(lower(name), 'nexus night') THEN 'Nexus Night' ELSE 'Other' END AS category FROM cal_events""")
def category_infer(events: DataFrame) -> DataFrame:
    """Category told from texts."""
    return events.select("external_id", text.infer_category(F.col("name"), F.col("description")).alias("category"))


@query("cal_events", "places", sql="""SELECT e.external_id, coalesce(CASE WHEN p.place_id % 2 = 0 THEN 'Nexus Night' END, e.event_type, 'Other') AS category FROM cal_events e LEFT JOIN places p ON e.shop_id = p.place_id""")
def template_category_join(events: DataFrame, places: DataFrame) -> DataFrame:
    """Template's category first, the event's own else."""
    names = places.select(F.col("place_id").alias("shop_id"), text.template_category(F.when(F.col("place_id") % 2 == 0, F.concat(F.lit("Weekly nexus NIGHT "), "name")).otherwise(F.col("name"))).alias("_told"))
    return events.join(search.if_small(names), "shop_id", "left").select("external_id", F.coalesce("_told", "event_type", F.lit(text.OTHER)).alias("category"))


@query("cal_events", sql="""SELECT external_id, CASE WHEN cost_in_cents = 0 THEN 'Free' ELSE CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE '' END ||
CAST(cost_in_cents // 100 AS STRING) || '.' || lpad(CAST(cost_in_cents % 100 AS STRING), 2, '0') END AS price FROM cal_events WHERE cost_in_cents >= 0""")
def format_price(events: DataFrame) -> DataFrame:
    """Price texts."""
    return events.where("cost_in_cents >= 0").select("external_id", text.format_price(F.col("cost_in_cents"), F.col("currency")).alias("price"))


@query("cal_events", sql="""SELECT external_id, CASE external_id % 5 WHEN 0 THEN city WHEN 1 THEN city WHEN 2 THEN 'TX' ELSE 'Big Town' END AS parsed FROM cal_events""")
def city_from_address(events: DataFrame) -> DataFrame:
    """City by store, else by address: the five shapes of an address in turn."""
    k = F.col("external_id") % 5
    address = F.when(k == 2, F.lit("1 Road, TX, US")).when(k == 3, F.lit("1 Road, Ste 4, Big Town, TX, 78701, US")).otherwise(F.lit("1 Road, Big Town, TX 78701, US"))
    city = F.when(k < 2, F.col("city")).when(k == 2, F.lit("TX")).when(k == 3, F.lit("TX")).otherwise(F.lit(None).cast("string"))
    return events.select("external_id", text.city_from_address(address, city, F.lit("TX")).alias("parsed"))


@query("cal_events", sql="SELECT currency, total, round(total * 100.0e0 / sum(total) OVER (), 4) AS share FROM (SELECT currency, count(*) AS total FROM cal_events GROUP BY currency)")
def share_of_total(events: DataFrame) -> DataFrame:
    """Percent of all rows by currency."""
    counts = events.groupBy("currency").agg(F.count(F.lit(1)).alias("total"))
    whole = counts.agg(F.sum("total").alias("_all"))  # one row
    return counts.join(F.broadcast(whole)).select("currency", "total", F.round(F.col("total") * 100.0 / F.col("_all"), 4).alias("share"))
