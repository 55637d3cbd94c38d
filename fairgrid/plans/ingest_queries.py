"""Queries of ingestion: bucketed upserts, shops, validation, surrogate keys, mixed items, limits by first request, reports by day, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgrid.operators import geocode, limits, merge, traffic, upkeep, validation
from fairgrid.operators.buckets import BucketedTable
from fairgrid.plans.geo_queries import geohash_sql
from fairgrid.plans.registry import query
from fairgrid.plans.store_queries import COMPARED, JOINED, STATUS
from fairgrid.plans.upkeep_queries import canonical_wire
from fairgrid.schema import COMPARED_EVENT, COMPARED_SHOP
from fairgrid.session import shared_folder


def _bucketed(stored: DataFrame) -> BucketedTable:
    table = BucketedTable(stored.sparkSession, shared_folder(stored.sparkSession, "bucketed"), "external_id", stored.schema, 16)
    table.upsert(stored, COMPARED, 0)
    return table


@query("stored", "incoming", sql="""SELECT coalesce(i.external_id, s.external_id) AS external_id, CASE WHEN i.external_id IS NULL THEN s.name ELSE i.name END AS name, CASE WHEN i.external_id IS NULL THEN s.description ELSE i.description END AS description,
coalesce(s.created_at, 20000 + i.external_id % 4 // 2) AS created_at FROM stored s FULL JOIN incoming i ON s.external_id = i.external_id""")
def bucketed_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after two batches into buckets; the second is published under its number twice."""
    table = _bucketed(stored)
    for version, rest in ((1, 0), (2, 2), (2, 2)):
        table.upsert(incoming.where(F.col("external_id") % 4 == rest), COMPARED, version, as_of=19_999 + version)
    return table.read().select("external_id", "name", "description", "created_at")


@query("stored", "incoming", sql=f"SELECT * FROM (SELECT coalesce(i.external_id, s.external_id) AS external_id, {STATUS} AS status FROM {JOINED}) WHERE status IN ('created', 'updated')")
def bucketed_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What one batch created and updated, as the table keeps it beside its rows."""
    table = _bucketed(stored)
    table.upsert(incoming, COMPARED, 1)
    return table.changes(1).select("external_id", F.col("_status").alias("status"))


@query("stored", "incoming", sql=f"""SELECT coalesce(i.external_id, s.external_id) AS external_id, coalesce(s.created_at, 20000) AS created_at, CASE WHEN {STATUS} IN ('created', 'updated') THEN 20000 ELSE s.created_at + 1 END AS updated_at,
CASE WHEN {STATUS} IN ('created', 'updated') THEN 20000 ELSE s.created_at + 2 END AS scraped_at FROM {JOINED}""")
def upsert_times(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Creation times stay, written rows get the time of the upsert as theirs, skipped ones keep all three."""
    timed = stored.withColumn("updated_at", F.col("created_at") + 1).withColumn("scraped_at", F.col("created_at") + 2)
    return merge.merge(timed, incoming, "external_id", COMPARED, as_of=20_000).select("external_id", "created_at", "updated_at", "scraped_at")


@query("wire", sql=f"SELECT id AS external_id, CASE WHEN id % {len(COMPARED_EVENT) + 2} < {len(COMPARED_EVENT)} THEN 'updated' ELSE 'skipped' END AS status FROM wire")
def each_compared_column(wire: DataFrame) -> DataFrame:
    """Each compared column in turn differs from what is stored, and that alone makes an update; pictures and nothing at all don't."""
    events = canonical_wire(wire)
    turn = F.col("external_id").cast("long") % (len(COMPARED_EVENT) + 2)

    def other(name: str) -> F.Column:
        kind = events.schema[name].dataType.typeName()
        value = F.col(name)
        if kind == "string":
            return F.concat(F.coalesce(value, F.lit("")), F.lit("!"))
        return F.coalesce(value + F.expr("interval 1 day"), F.lit("2020-01-01").cast(kind)) if kind.startswith("timestamp") else (F.coalesce(value, F.lit(0)) + 1).cast(kind)

    last = len(COMPARED_EVENT)
    stored = events.select(*(F.when(turn == (COMPARED_EVENT.index(c) if c in COMPARED_EVENT else last), other(c)).otherwise(F.col(c)).alias(c) if c in (*COMPARED_EVENT, "image_url") else F.col(c) for c in events.columns))
    return merge.merge(stored, events, "external_id", COMPARED_EVENT).select(F.col("external_id").cast("long").alias("external_id"), F.col("_status").alias("status"))


INCOMING_SHOPS = f"""incoming_shops AS (SELECT *, CASE WHEN latitude IS NOT NULL AND latitude <> 0 THEN {geohash_sql(3)} END AS geohash3, CASE WHEN latitude IS NOT NULL AND latitude <> 0 THEN {geohash_sql(4)} END AS geohash4 FROM (
SELECT shop_id, store_name AS name, full_address AS location_text, CASE WHEN shop_id % 9 = 4 THEN 0 ELSE latitude END AS latitude, longitude FROM wire WHERE store_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY id DESC) = 1)),
stored_shops AS (SELECT s.shop_id, CASE WHEN k = 1 THEN 'old' ELSE i.name END AS name, CASE WHEN k = 2 THEN NULL ELSE i.location_text END AS location_text, CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN i.latitude + 1 ELSE i.latitude END AS latitude,
CASE WHEN k = 5 THEN 7 ELSE i.longitude END AS longitude, CASE WHEN k = 6 THEN 'old' ELSE i.geohash3 END AS geohash3, CASE WHEN k = 7 THEN NULL ELSE i.geohash4 END AS geohash4, s.geocode_status, s.geocode_error, s.display_city
FROM (SELECT *, shop_id % 10 AS k FROM shop_state) s LEFT JOIN incoming_shops i ON s.shop_id = i.shop_id)"""
_SHOP_DIFFERS = " OR ".join(f"s.{c} IS DISTINCT FROM i.{c}" for c in COMPARED_SHOP)
SHOPS_SQL = f"""SELECT * FROM (WITH {INCOMING_SHOPS}, told AS (SELECT coalesce(s.shop_id, i.shop_id) AS shop_id, {", ".join(f"s.{c} AS s_{c}, i.{c} AS i_{c}" for c in COMPARED_SHOP)}, s.geocode_status, s.geocode_error, s.display_city,
CASE WHEN i.shop_id IS NULL THEN 'kept' WHEN s.shop_id IS NULL THEN 'created' WHEN {_SHOP_DIFFERS} THEN 'updated' ELSE 'skipped' END AS status FROM stored_shops s FULL JOIN incoming_shops i ON s.shop_id = i.shop_id)
SELECT shop_id, {", ".join(f"CASE WHEN status IN ('kept', 'skipped') THEN s_{c} ELSE i_{c} END AS {c}" for c in COMPARED_SHOP)}, display_city, CASE WHEN status IN ('created', 'updated') THEN 'completed' ELSE geocode_status END AS geocode_status,
CASE WHEN status NOT IN ('created', 'updated') THEN geocode_error END AS geocode_error, status, CASE WHEN status <> 'kept' THEN coalesce(display_city, '') = '' END AS needs_city FROM told)"""


@query("wire", "shop_state", sql=SHOPS_SQL)
def shop_merge(wire: DataFrame, shops: DataFrame) -> DataFrame:
    """Shops of wire events merged on all six compared columns, each of which differs somewhere."""
    place = F.struct(
        F.col("shop_id").alias("id"), F.col("store_name").alias("name"), "full_address", F.when(F.col("shop_id") % 9 == 4, F.lit(0.0)).otherwise(F.col("latitude")).alias("latitude"), "longitude",
    )
    raw = wire.select(F.floor(F.col("id") / 250).alias("page"), (F.col("id") % 250).alias("position"), F.when(F.col("store_name").isNotNull(), place).alias("store"))
    incoming = merge.wire_shops(raw)
    k, i = F.col("shop_id") % 10, {c: F.col(f"i.{c}") for c in COMPARED_SHOP}
    old = {
        "name": F.when(k == 1, F.lit("old")).otherwise(i["name"]), "location_text": F.when(k != 2, i["location_text"]), "latitude": F.when(k == 4, i["latitude"] + 1).when(k != 3, i["latitude"]),
        "longitude": F.when(k == 5, F.lit(7.0)).otherwise(i["longitude"]), "geohash3": F.when(k == 6, F.lit("old")).otherwise(i["geohash3"]), "geohash4": F.when(k != 7, i["geohash4"]),
    }
    stored = shops.alias("s").join(incoming.alias("i"), "shop_id", "left").select("shop_id", *(c.alias(n) for n, c in old.items()), "geocode_status", "geocode_error", "display_city")
    return merge.merge_shops(stored, incoming).withColumnRenamed("_status", "status")


_RULES = {
    "no id": "id IS NULL", "no name": "coalesce(trim(name), '') = ''", "unreadable start": "start_date IS NULL", "ends before it starts": "ends < start_date", "latitude out of range": "lat < -90 OR lat > 90",
    "longitude out of range": "lng < -180 OR lng > 180", "half a coordinate": "(lat IS NULL) <> (lng IS NULL)", "negative cost": "cost_in_cents < 0", "cost without currency": "cost_in_cents > 0 AND coalesce(trim(currency), '') = ''",
    "more players than seats": "capacity > 0 AND player_count > capacity", "store without a name": "store AND coalesce(trim(store_name), '') = ''",
}
_BROKEN_WIRE = """SELECT CASE WHEN id % 101 = 5 THEN NULL ELSE id END AS id, CASE WHEN id % 11 = 1 THEN '  ' ELSE name END AS name, CASE WHEN id % 13 = 2 THEN NULL ELSE start_date END AS start_date, CASE WHEN id % 17 = 3 THEN start_date - INTERVAL 1 DAY END AS ends,
CASE WHEN id % 19 = 4 THEN 91 WHEN id % 19 = 5 THEN NULL ELSE 30.5e0 END AS lat, CASE WHEN id % 23 = 5 THEN -181 ELSE 9.5e0 END AS lng, CASE WHEN id % 29 = 6 THEN -5 ELSE cost_in_cents END AS cost_in_cents, CASE WHEN id % 7 = 0 THEN ' ' ELSE currency END AS currency,
capacity, player_count, id % 3 = 0 AS store, CASE WHEN id % 31 = 7 THEN '' ELSE store_name END AS store_name, id AS line FROM wire"""
_ERRORS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + ")"


def _broken(wire: DataFrame) -> DataFrame:
    n = F.col("id")
    start = F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss")
    earlier = F.date_format(F.col("start_date") - F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss")
    lat, lng = F.when(n % 19 == 4, F.lit(91.0)).when(n % 19 != 5, F.lit(30.5)), F.when(n % 23 == 5, F.lit(-181.0)).otherwise(F.lit(9.5))
    name = F.when(n % 31 == 7, F.lit("")).otherwise(F.col("store_name"))
    store = F.when(n % 3 == 0, F.struct(name.alias("name"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude")))
    return wire.select(
        F.when(n % 101 != 5, n).alias("id"), F.when(n % 11 == 1, F.lit("  ")).otherwise(F.col("name")).alias("name"), F.when(n % 13 == 2, F.lit("soon")).otherwise(start).alias("start_datetime"), F.when(n % 17 == 3, earlier).alias("end_datetime"),
        lat.alias("latitude"), lng.alias("longitude"), F.when(n % 29 == 6, F.lit(-5)).otherwise(F.col("cost_in_cents")).alias("cost_in_cents"), F.when(n % 7 == 0, F.lit(" ")).otherwise(F.col("currency")).alias("currency"),
        "capacity", F.col("player_count").alias("registered_user_count"), store.alias("store"), n.alias("line"),
    )


@query("wire", sql=f"SELECT line, {_ERRORS} AS errors, {_ERRORS} = '' AS valid FROM ({_BROKEN_WIRE})")
def row_validation(wire: DataFrame) -> DataFrame:
    """What is wrong with each wire event."""
    checked = validation.validated(_broken(wire), validation.wire_rules())
    return checked.select("line", F.array_join("errors", ",").alias("errors"), "valid")


@query("wire", sql="SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n FROM ({_BROKEN_WIRE})" for n, c in _RULES.items()) + ")")
def broken_rule_counts(wire: DataFrame) -> DataFrame:
    """Rows that break each rule."""
    return validation.broken_rules(validation.validated(_broken(wire), validation.wire_rules()), validation.wire_rules())


@query("cal_events", "shops", sql="""SELECT 0 - shop_id AS natural, shop_id * 2 AS surrogate FROM shops UNION ALL
SELECT n, (SELECT max(shop_id * 2) FROM shops) + row_number() OVER (ORDER BY n) FROM (SELECT DISTINCT external_id * 7 % 5003 - 20 AS n FROM cal_events) WHERE n NOT IN (SELECT 0 - shop_id FROM shops)""")
def assigned_surrogates(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Known keys and, after the largest, new ones without a gap."""
    known = shops.select((-F.col("shop_id")).alias("natural"), (F.col("shop_id") * 2).alias("surrogate"))
    return known.unionByName(upkeep.new_surrogates(known, events.select((F.col("external_id") * 7 % 5003 - 20).alias("natural"))))


@query("json_items", "shops", "cal_events", "geocache", "runs", "zipcodes", sql="""SELECT 'SHOP' AS kind, CAST(shop_id AS VARCHAR) AS id, name AS label, latitude, shop_id AS number, CAST(NULL AS TIMESTAMP) AS at, 'n' || shop_id AS note FROM shops
UNION ALL SELECT 'EVENT', CAST(external_id AS VARCHAR), name, NULL, shop_id, start_date, NULL FROM cal_events UNION ALL SELECT 'GEOCACHE', query, query, latitude, NULL, NULL, 'g' FROM geocache
UNION ALL SELECT 'SCRAPE_RUN', CAST(run_id AS VARCHAR), status, NULL, CASE WHEN run_id % 5 <> 0 THEN events_found END, CAST(started_at AS TIMESTAMP), NULL FROM runs
UNION ALL SELECT 'ZIPCODE', zipcode, city, latitude, NULL, NULL, NULL FROM zipcodes UNION ALL SELECT 'OTHER', NULL, 'not JSON ' || zipcode, NULL, NULL, NULL, NULL FROM zipcodes""")
def typed_items(items: DataFrame, *_: DataFrame) -> DataFrame:
    """Items of five kinds with other attributes each, read once into typed tables."""
    tables = upkeep.typed_items(items, shared_folder(items.sparkSession, "typed-items"))
    label = {"SHOP": "name", "EVENT": "name", "GEOCACHE": "query", "SCRAPE_RUN": "status", "ZIPCODE": "city", "OTHER": "item"}
    number, at = {"SHOP": "externalId", "EVENT": "shopExternalId", "SCRAPE_RUN": "eventsFound"}, {"EVENT": "startDate", "SCRAPE_RUN": "startedAt"}

    def shown(kind: str) -> DataFrame:
        rows = tables[kind]
        own = lambda names, t: F.col(names[kind]).cast(t) if kind in names else F.lit(None).cast(t)
        return rows.select(
            F.lit(kind).alias("kind"), (F.col("id") if "id" in rows.columns else F.lit(None).cast("string")).alias("id"), F.col(label[kind]).alias("label"), (F.col("latitude") if "latitude" in rows.columns else F.lit(None).cast("double")).alias("latitude"),
            own(number, "long").alias("number"), own(at, "timestamp_ntz").alias("at"), (F.try_element_at("other", F.lit("note")) if "other" in rows.columns else F.lit(None).cast("string")).alias("note"),
        )

    return upkeep.migrated(*(shown(kind) for kind in tables))


@query("events", sql="""WITH RECURSIVE starts AS (SELECT user_id, min(ts) AS start FROM events GROUP BY user_id UNION ALL
SELECT s.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 6 HOUR) FROM starts s WHERE s.start IS NOT NULL),
opened AS (SELECT e.event_id, e.user_id, e.ts, s.start FROM events e ASOF JOIN (SELECT * FROM starts WHERE start IS NOT NULL) s ON e.user_id = s.user_id AND e.ts >= s.start)
SELECT event_id, row_number() OVER (PARTITION BY user_id, start ORDER BY ts, event_id) <= 2 AS allowed FROM opened""")
def limit_from_first_hit(events: DataFrame) -> DataFrame:
    """Two requests a window of six hours that a user's own requests open."""
    return limits.limited(events, "user_id", "ts", "event_id", 2, seconds=6 * 3600, chunk_seconds=24 * 3600).select("event_id", "allowed")


@query("access_log", sql="""SELECT count(DISTINCT date) AS days, count(*) AS requests, count(*) FILTER (status LIKE '2%' OR status = '304') AS successful, CAST(sum(bytes) AS BIGINT) AS bytes, true AS visitors_near, true AS pages_near FROM access_log WHERE date BETWEEN '2024-01-05' AND '2024-01-20'""")
def report_from_days(log: DataFrame) -> DataFrame:
    """A report from the rows of days, of which three were counted on half their lines first and replaced later; distinct numbers within 3 %."""
    early = traffic.daily_partials(log.where("date < '2024-01-12' or event_id % 2 = 0"))
    state = traffic.with_days(early.where("date < '2024-01-15'"), traffic.daily_partials(log.where("date >= '2024-01-12'")))
    told = traffic.report_of_days(state, "2024-01-05", "2024-01-20")
    page = F.when(F.col("uri").rlike("^/events?/[a-f0-9-]+$"), F.col("uri"))
    true = traffic.with_visitor(log.where(F.col("date").between("2024-01-05", "2024-01-20"))).agg(F.count_distinct("visitor").alias("_v"), F.count_distinct(page).alias("_p"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.03
    return told.join(F.broadcast(true)).select("days", "requests", "successful", "bytes", near("visitors", "_v").alias("visitors_near"), near("event_pages", "_p").alias("pages_near"))


_ASKED = "SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN ' ' || lpad(CAST(c_custkey * 2 AS STRING), 5, '0') WHEN 1 THEN substr(upper(c_name), 1, 1 + c_custkey % 18) || ' ' WHEN 2 THEN substr(p_name, 1, 2 + c_custkey % 7) WHEN 3 THEN 'zz top' ELSE substr(p_name, 1, 14) END AS query FROM customer JOIN part ON p_partkey = c_custkey"
_NAMED = "SELECT c_custkey AS place_id, c_name AS name, 'city' AS type, c_mktsegment AS label FROM customer UNION ALL SELECT p_partkey + 1000000, p_name, p_brand, p_type FROM part"


@query("customer", "part", "zipcodes", sql=f"""SELECT * FROM (WITH asked AS (SELECT query_id, trim(query) AS q FROM ({_ASKED.replace("STRING", "VARCHAR")}) WHERE length(query) >= 2), named AS ({_NAMED})
SELECT query_id, 1 AS rank, zipcode AS name, 'postcode' AS type, city || ', TX ' || zipcode AS label FROM asked JOIN zipcodes ON q = zipcode
UNION ALL SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place_id) AS INT) AS rank, name, type, label FROM (
SELECT query_id, min(place_id) AS place_id, min_by(name, place_id) AS name, type, label FROM asked JOIN named ON length(q) >= 2 AND NOT regexp_matches(q, '^[0-9]{{5}}$') AND starts_with(lower(name), lower(q)) GROUP BY query_id, type, label) QUALIFY rank <= 4)""")
def prefix_suggestions(customers: DataFrame, parts: DataFrame, zips: DataFrame) -> DataFrame:
    """Suggestions for a table of prefixes, short and long, and ZIP codes."""
    spark = customers.sparkSession
    asked, places = spark.sql(_ASKED.replace("customer", "{customer}").replace("JOIN part", "JOIN {part}"), customer=customers, part=parts), spark.sql(_NAMED.replace("FROM customer", "FROM {customer}").replace("FROM part", "FROM {part}"), customer=customers, part=parts)
    return geocode.suggest_all(asked, places, zips.withColumn("state_code", F.lit("TX")), every=True)
