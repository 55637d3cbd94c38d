"""Queries of shop upkeep, keys, migrations, ingestion and the remaining reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import geo, temporal, text
from fairgrid.operators import geocode, merge, pricing, retention, traffic, upkeep
from fairgrid.plans.geo_queries import geohash_sql
from fairgrid.plans.log_queries import PAGE
from fairgrid.plans.registry import query
from fairgrid.plans.search_queries import km
from fairgrid.schema import COMPARED_EVENT


@query("shop_state", sql="SELECT shop_id, location_text FROM shop_state WHERE geocode_status = 'pending' AND location_text IS NOT NULL AND location_text <> ''")
def pending_geocodes(shops: DataFrame) -> DataFrame:
    """Shops that wait for a geocode."""
    return upkeep.pending_shops(shops).select("shop_id", "location_text")


@query("shop_state", "geocode_results", sql="""SELECT s.shop_id, CASE WHEN r.shop_id IS NOT NULL AND r.error IS NULL THEN r.latitude ELSE s.latitude END AS latitude,
CASE WHEN r.error IS NOT NULL THEN 'failed' WHEN r.shop_id IS NOT NULL THEN 'completed' ELSE geocode_status END AS geocode_status,
CASE WHEN r.error IS NOT NULL THEN r.error WHEN r.shop_id IS NULL THEN geocode_error END AS geocode_error FROM shop_state s LEFT JOIN geocode_results r ON s.shop_id = r.shop_id""")
def shop_geocode_update(shops: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes of geocoding written to the shops."""
    return upkeep.apply_geocodes(shops, results).select("shop_id", "latitude", "geocode_status", "geocode_error")


@query("shop_state", "geocode_results", sql="SELECT s.shop_id, coalesce(r.display_city, s.display_city) AS display_city FROM shop_state s LEFT JOIN geocode_results r ON s.shop_id = r.shop_id")
def display_city_update(shops: DataFrame, results: DataFrame) -> DataFrame:
    """Display cities set by key."""
    return upkeep.set_column(shops, results, "shop_id", "display_city").select("shop_id", "display_city")


@query("shop_state", sql="SELECT CAST(created_on AS STRING) AS day, count(*) AS shops_added FROM shop_state WHERE created_on >= DATE '2024-01-06' GROUP BY created_on ORDER BY created_on DESC")
def shops_per_day(shops: DataFrame) -> DataFrame:
    """Shops by day of creation, newest first."""
    return shops.where("created_on >= date'2024-01-06'").groupBy(F.col("created_on").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("shops_added")).orderBy(F.desc("day"))


@query("cal_events", sql="""SELECT external_id, 'EVENT#' || CAST(external_id AS STRING) AS pk, 'DATE#' || strftime(start_date, '%Y-%m-%d') AS date_pk, 'EVENT#' || CAST(external_id AS STRING) AS date_sk,
'SHOP#' || CAST(shop_id AS STRING) AS shop_pk, strftime(start_date, '%Y-%m-%dT%H:%M:%S') AS shop_sk FROM cal_events""")
def event_index_keys(events: DataFrame) -> DataFrame:
    """Keys of events."""
    return upkeep.event_keys(events)


@query("items", sql="SELECT entity_type, id, coalesce(index_key, CASE WHEN entity_type = 'EVENT' AND shop_id IS NOT NULL AND start_date IS NOT NULL THEN 'SHOP#' || shop_id END) AS index_key FROM items")
def backfill_index_keys(items: DataFrame) -> DataFrame:
    """Missing shop keys of events."""
    return upkeep.backfill_index_keys(items).select("entity_type", "id", "index_key")


@query("items", sql="SELECT entity_type, count(*) AS n FROM items GROUP BY entity_type")
def split_by_entity(items: DataFrame) -> DataFrame:
    """Rows of each kind of a mixed table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("entity_type"), "n") for kind, df in upkeep.by_entity(items).items()]
    return upkeep.migrated(*parts)


@query("cal_events", "shops", sql="SELECT external_id, s.shop_id * 10 + 1 AS shop_id FROM cal_events e LEFT JOIN shops s ON e.shop_id = s.shop_id")
def surrogate_keys(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Shops' own ids in place of the source's; unknown shops become null."""
    keys = shops.select(F.col("shop_id").alias("natural"), (F.col("shop_id") * 10 + 1).alias("surrogate"))
    return upkeep.translated(events.select("external_id", "shop_id"), keys, "shop_id")


@query("shops", "cal_events", sql="SELECT shop_id, name, state, CAST(NULL AS STRING) AS city FROM shops UNION ALL SELECT shop_id, name, NULL, city FROM cal_events")
def schema_migration(shops: DataFrame, events: DataFrame) -> DataFrame:
    """Tables of two schemas as one."""
    return upkeep.migrated(shops.select("shop_id", "name", "state"), events.select("shop_id", "name", "city"))


@query("runs", sql="SELECT run_id, coalesce((epoch(TIMESTAMP '2024-01-15') - epoch(completed_at)) / 3600 >= 24, true) AS due, round((epoch(TIMESTAMP '2024-01-15') - epoch(completed_at)) / 3600, 4) AS hours FROM runs")
def cleanup_gate(runs: DataFrame) -> DataFrame:
    """Whether a day has passed since the last cleanup."""
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return runs.select("run_id", retention.cleanup_due(F.col("completed_at"), now).alias("due"), F.round(temporal.hours_since(F.col("completed_at"), now), 4).alias("hours"))


@query("runs", sql="SELECT run_id, CASE WHEN events_found = 0 THEN 300000 ELSE CAST(greatest(2000, least(floor(60 * 60000 * 0.9e0 / events_found), 300000)) AS BIGINT) END AS delay_ms, round(events_created * 1.60934e0, 6) AS km FROM runs")
def page_pacing(runs: DataFrame) -> DataFrame:
    """Pause between pages of a cycle, and miles as kilometres."""
    return runs.select("run_id", temporal.page_delay_ms(F.col("events_found"), 60).alias("delay_ms"), F.round(geo.miles_to_km(F.col("events_created")), 6).alias("km"))


@query("prices", "part", sql="""WITH c AS (SELECT upper(p_name || ' ' || CAST(p_partkey AS STRING)) || ' ' AS card, p_size * 1.0e0 AS price_usd, p_partkey + 2000000 AS updated_at FROM part WHERE p_partkey % 4 = 0)
SELECT card, price_usd, price_cny FROM prices WHERE lower(trim(card)) NOT IN (SELECT lower(trim(card)) FROM c) UNION ALL SELECT trim(card), price_usd, NULL FROM c""".replace("WITH c AS (", "SELECT * FROM (WITH c AS (") + ")")
def set_prices(prices: DataFrame, parts: DataFrame) -> DataFrame:
    """New prices over the old ones by normalised name."""
    card = F.concat(F.upper(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))), F.lit(" "))
    changes = parts.where("p_partkey % 4 = 0").select(card.alias("card"), F.col("p_size").cast("double").alias("price_usd"), (F.col("p_partkey") + 2_000_000).alias("updated_at"))
    return pricing.set_prices(prices, changes).select("card", "price_usd", "price_cny")


@query("places", sql="""SELECT place_id, coalesce(type, osm_value) AS kind FROM (SELECT place_id, CASE place_id % 3 WHEN 0 THEN 'City' WHEN 2 THEN 'house' END AS type, CASE WHEN place_id % 3 = 1 THEN 'village' ELSE 'town' END AS osm_value FROM places)
WHERE lower(coalesce(nullif(type, ''), nullif(osm_value, ''))) IN ('city', 'town', 'village', 'hamlet', 'suburb', 'neighbourhood', 'borough', 'county', 'district', 'state', 'province', 'region', 'country', 'municipality', 'locality')""")
def indexable_places(places: DataFrame) -> DataFrame:
    """Places worth indexing, by type or else by value."""
    k = F.col("place_id") % 3
    told = places.select("place_id", F.when(k == 0, F.lit("City")).when(k == 2, F.lit("house")).alias("type"), F.when(k == 1, F.lit("village")).otherwise(F.lit("town")).alias("osm_value"))
    return geocode.indexable(told).select("place_id", F.coalesce("type", "osm_value").alias("kind"))


@query("geo_queries", "zipcodes", "geocache", "places", sql="""SELECT query, latitude, accessed FROM geocache WHERE query NOT IN (SELECT lower(trim(query)) FROM geo_queries WHERE lower(trim(query)) IN (SELECT lower(name) FROM places))
UNION ALL SELECT DISTINCT lower(trim(q.query)), p.latitude, 5000 FROM geo_queries q JOIN places p ON lower(trim(q.query)) = lower(p.name) WHERE lower(trim(q.query)) NOT IN (SELECT query FROM geocache)""")
def geocache_write_back(queries: DataFrame, zips: DataFrame, cache: DataFrame, places: DataFrame) -> DataFrame:
    """The cache after the providers' answers."""
    local = places.select(F.lower("name").alias("query"), "latitude", "longitude")
    answered = geocode.geocode(queries, zips, cache, local, local.limit(0))
    return geocode.replaced(cache, geocode.cache_entries(queries, answered, 5000)).select("query", "latitude", "accessed")


_CITIES = """SELECT 0 AS rank, name AS city, region AS country, 'S' || CAST(place_id % 3 AS STRING) AS state, 'coords' AS source FROM places UNION ALL SELECT 1, state, country, 'K', 'known' FROM shops
UNION ALL SELECT 2, city, country, 'F', 'forward' FROM cal_events UNION ALL SELECT 2, state, country, 'F', 'forward' FROM shops"""


@query("places", "shops", "cal_events", sql=f"SELECT city, country, state, source FROM ({_CITIES}) QUALIFY row_number() OVER (PARTITION BY city, country ORDER BY rank, state) = 1")
def combined_cities(places: DataFrame, shops: DataFrame, events: DataFrame) -> DataFrame:
    """Cities of three sources, each once."""
    coords = places.select(F.col("name").alias("city"), F.concat(F.lit("S"), (F.col("place_id") % 3).cast("string")).alias("state"), F.col("region").alias("country"))
    known = shops.select(F.col("state").alias("city"), F.lit("K").alias("state"), "country")
    forward = events.select("city", F.lit("F").alias("state"), "country").unionByName(known.withColumn("state", F.lit("F")))
    return geocode.city_list(coords, known, forward).select("city", "country", "state", "source")


_NEAREST = f"""SELECT s.shop_id, p.place_id, p.name, p.region FROM (SELECT min(shop_id) AS shop_id, lat, lng FROM (SELECT shop_id, round(latitude, 2) AS lat, round(longitude, 2) AS lng FROM shops WHERE latitude IS NOT NULL) GROUP BY lat, lng) s, places p
QUALIFY row_number() OVER (PARTITION BY lat, lng ORDER BY {km("lat", "lng", "p.latitude", "p.longitude")}, p.place_id) = 1"""


@query("places", "shops", sql=f"""SELECT * FROM (WITH reversed AS (SELECT DISTINCT name AS city, region AS country FROM ({_NEAREST})), every AS (SELECT * FROM reversed UNION SELECT state, country FROM shops),
found AS (SELECT lower(e.city || ', ' || e.country) AS query, e.city, p.place_id // 2 AS osm_id FROM every e JOIN places p ON lower(e.city || ', ' || e.country) = lower(p.name || ', ' || p.region) WHERE p.place_id % 7 <> 0),
once AS (SELECT * FROM found WHERE osm_id NOT IN (3, 4) QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY query) = 1) SELECT 899999999 + row_number() OVER (ORDER BY query) AS place_id, osm_id, city AS name FROM once)""")
def city_documents(places: DataFrame, shops: DataFrame) -> DataFrame:
    """The city list's chain: coordinates of stores to cities, known ones after, looked up, numbered, without those that are there."""
    known = places.select(F.col("place_id").alias("row_id"), F.col("name").alias("city"), F.lit(None).cast("string").alias("state"), F.col("region").alias("country"), "latitude", "longitude")
    listed = shops.select(F.col("state").alias("city"), F.lit(None).cast("string").alias("state"), "country")
    cities = geocode.city_list(geocode.store_cities(shops, known), listed, listed.limit(0))
    none = F.lit(None).cast("string")
    feature = F.struct(F.floor(F.col("place_id") / 2).alias("osm_id"), none.alias("osm_type"), none.alias("osm_value"), "type", "name", none.alias("city"), none.alias("county"), none.alias("state"), F.col("region").alias("country"), none.alias("countrycode"))
    features = places.where("place_id % 7 <> 0").select(F.lower(F.concat_ws(", ", "name", "region")).alias("query"), feature.alias("feature"))
    there = places.where("place_id in (3, 4)").select(F.col("place_id").cast("long").alias("osm_id"))
    return geocode.city_documents(cities, features, there).select("place_id", "osm_id", F.get_json_object("doc", "$.name").alias("name"))


@query("geo_log", "access_log", sql="""SELECT *, CAST(floor(calls * 1000 / visitors) AS DOUBLE) / 1000 AS calls_per_visitor, CASE WHEN searches > 0 THEN CAST(floor(calls * 1000 / searches) AS DOUBLE) / 10 END AS calls_per_search, searches - calls AS saved_calls FROM
(SELECT count(*) FILTER (contains(line, 'type=mapbox_autocomplete')) AS calls FROM (SELECT replace(line, 'mapbox_reverse', 'mapbox_autocomplete') AS line FROM geo_log)),
(SELECT count(DISTINCT ip) AS visitors, count(*) FILTER (starts_with(uri, '/api/events/geocode')) AS searches FROM access_log)""")
def geocode_correlation(geo_log: DataFrame, log: DataFrame) -> DataFrame:
    """Provider calls against visitors and searches."""
    return traffic.geocode_correlation(geo_log.select(F.replace("line", F.lit("mapbox_reverse"), F.lit("mapbox_autocomplete")).alias("line")), log)


@query("access_log", sql=f"SELECT uri, count(*) AS n FROM access_log WHERE {PAGE} GROUP BY uri ORDER BY n DESC, uri LIMIT 10")
def top_event_pages(log: DataFrame) -> DataFrame:
    """The ten event pages with most views."""
    from fairgrid.functions.weblog import EVENT_PAGE

    return traffic.top(log.where(F.col("uri").rlike(EVENT_PAGE)), "uri", 10)


@query("access_log", sql=f"SELECT count(*) AS views, count(DISTINCT ip) AS ips, count(DISTINCT uri) AS pages FROM access_log WHERE {PAGE}")
def event_view_totals(log: DataFrame) -> DataFrame:
    """All views of event pages."""
    from fairgrid.functions.weblog import EVENT_PAGE

    return log.where(F.col("uri").rlike(EVENT_PAGE)).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("ip").alias("ips"), F.count_distinct("uri").alias("pages"))


@query("cal_events", sql="SELECT count(*) AS total_events FROM cal_events WHERE start_date BETWEEN TIMESTAMP '2024-04-12' - INTERVAL 3 MONTH AND TIMESTAMP '2024-04-12'")
def events_of_three_months(events: DataFrame) -> DataFrame:
    """Events of the three months before a time."""
    now = F.lit("2024-04-12").cast("timestamp_ntz")
    return events.where(F.col("start_date").between(now - F.expr("interval 3 months"), now)).agg(F.count(F.lit(1)).alias("total_events"))


@query("cal_events", sql="SELECT external_id, created_at FROM cal_events ORDER BY created_at, external_id LIMIT 100")
def queue_order(events: DataFrame) -> DataFrame:
    """The head of a queue: oldest first."""
    return events.orderBy("created_at", "external_id").limit(100).select("external_id", "created_at")


@query("cal_events", sql="SELECT external_id, 'https://events.example.org/' || CAST(external_id AS STRING) AS url FROM cal_events")
def redirect_urls(events: DataFrame) -> DataFrame:
    """Events' own pages."""
    return events.select("external_id", F.concat(F.lit(merge.EVENT_PAGES), F.col("external_id").cast("string")).alias("url"))


# Names of categories and signs of currencies, as in functions/text.py.
_SIGN = "CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE '' END"
CANONICAL = f"""(SELECT CAST(id AS STRING) AS external_id, w.name, description, store_name AS location, full_address AS address, CASE WHEN store_name IS NOT NULL AND store_city <> 'TX' THEN store_city ELSE city END AS city,
CASE WHEN store_name IS NOT NULL THEN 'TX' END AS state, CASE WHEN store_name IS NOT NULL THEN 'US' END AS country, latitude, longitude, strftime(start_date, '%Y-%m-%d %H:%M:%S') AS start_date, CAST(NULL AS STRING) AS start_time, CAST(NULL AS STRING) AS end_date,
CASE WHEN template = 'T1' THEN 'Nexus Night' WHEN regexp_matches(w.name || ' ' || coalesce(description, ''), '(?i)pre[\\s-]?rift') THEN 'Pre-Rift' WHEN contains(lower(w.name), 'summoner skirmish') THEN 'Summoner Skirmish'
WHEN contains(lower(w.name), 'nexus night') THEN 'Nexus Night' ELSE 'Other' END AS event_type, store_name AS organizer, player_count, capacity,
CASE WHEN cost_in_cents = 0 THEN 'Free' ELSE {_SIGN} || CASE WHEN cost_in_cents < 0 THEN '-' ELSE '' END || CAST(abs(cost_in_cents) // 100 AS STRING) || '.' || lpad(CAST(abs(cost_in_cents) % 100 AS STRING), 2, '0') END AS price,
'https://events.example.org/' || CAST(id AS STRING) AS url, CAST(NULL AS STRING) AS image_url, CASE WHEN store_name IS NOT NULL THEN CAST(shop_id AS STRING) END AS shop_id, CASE WHEN latitude IS NOT NULL THEN {geohash_sql(3)} END AS geohash3,
store_name AS shop_name, CASE WHEN store_name IS NOT NULL THEN store_latitude END AS shop_latitude, CASE WHEN store_name IS NOT NULL THEN longitude END AS shop_longitude
FROM (SELECT * REPLACE (CASE WHEN latitude IS NULL AND store_name IS NOT NULL THEN store_latitude ELSE latitude END AS latitude) FROM wire) w)"""


def canonical_wire(wire: DataFrame) -> DataFrame:
    """The view ``wire`` as canonical event rows."""
    none = F.lit(None).cast("string")
    store = F.struct(
        F.col("shop_id").alias("id"), F.col("store_name").alias("name"), none.alias("full_address"), F.col("store_city").alias("city"), F.lit("TX").alias("state"), F.lit("US").alias("country"),
        F.col("store_latitude").alias("latitude"), F.col("longitude").alias("longitude"),
    )
    raw = wire.select(
        "id", "name", "description", F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss").alias("start_datetime"), none.alias("end_datetime"), "full_address", "latitude", "longitude", "cost_in_cents", "currency", "capacity",
        F.col("player_count").alias("registered_user_count"), none.alias("full_header_image_url"), F.col("template").alias("event_configuration_template"), F.when(F.col("store_name").isNotNull(), store).alias("store"),
    )
    templates = wire.sparkSession.range(4).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") == 1, F.lit("NEXUS night kit")).otherwise(F.lit("plain")).alias("name"))
    return merge.canonical_events(raw, templates)


@query("wire", sql=f"SELECT * FROM {CANONICAL}")
def canonical_events(wire: DataFrame) -> DataFrame:
    """Wire events as event rows, all columns."""
    return canonical_wire(wire).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_date", "end_date")})


@query("wire", sql="""SELECT count(*) AS found, count(DISTINCT store_name) AS stores, count(*) FILTER (id % 3 = 0) AS created, count(*) FILTER (id % 3 = 1 AND id % 10 = 1) AS updated,
count(*) FILTER (id % 3 <> 0 AND NOT (id % 3 = 1 AND id % 10 = 1)) AS skipped, CAST(floor(100.0e0 * count(*) FILTER (id % 3 <> 0 AND NOT (id % 3 = 1 AND id % 10 = 1)) / count(*) + 0.5) AS BIGINT) AS skip_rate FROM wire""")
def ingestion_counters(wire: DataFrame) -> DataFrame:
    """A whole cycle: wire rows to events, merged with what is stored by all compared columns, and counted."""
    events = canonical_wire(wire)
    key = F.col("external_id").cast("long")
    old = F.when((key % 3 == 1) & (key % 10 == 1), F.coalesce("shop_latitude", F.lit(0.0)) + 1).otherwise(F.col("shop_latitude"))
    stored = events.where(key % 3 != 0).withColumn("shop_latitude", old).withColumn("image_url", F.lit("another"))
    return merge.ingestion_counters(merge.merge(stored, events, "external_id", COMPARED_EVENT), events)
