"""Queries of merges, retention, pricing, sinks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import geo, text
from fairgrid.operators import merge, pricing, retention
from fairgrid.plans.geo_queries import geohash_sql
from fairgrid.plans.registry import query

COMPARED = ["name", "description", "start_date", "player_count", "shop_id"]
_DIFFERS = " OR ".join(f"s.{c} IS DISTINCT FROM i.{c}" for c in COMPARED)
STATUS = f"CASE WHEN i.external_id IS NULL THEN 'kept' WHEN s.external_id IS NULL THEN 'created' WHEN {_DIFFERS} THEN 'updated' ELSE 'skipped' END"
JOINED = "stored s FULL JOIN incoming i ON s.external_id = i.external_id"


@query("stored", "incoming", sql=f"SELECT {STATUS} AS status, count(*) AS n FROM {JOINED} GROUP BY 1")
def upsert_status_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of a change-detecting upsert."""
    return merge.status_counts(merge.merge(stored, incoming, "external_id", COMPARED))


@query("stored", "incoming", sql="SELECT coalesce(i.external_id, s.external_id) AS external_id, CASE WHEN i.external_id IS NULL THEN s.name ELSE i.name END AS name, CASE WHEN i.external_id IS NULL THEN s.description ELSE i.description END AS description, CASE WHEN s.external_id IS NULL THEN 20000 ELSE s.created_at END AS created_at FROM " + JOINED)
def upsert_post_state(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Table after the upsert; creation times stay, new rows get the time of the upsert."""
    return merge.merge(stored, incoming, "external_id", COMPARED, as_of=20_000).select("external_id", "name", "description", "created_at")


@query("cal_events", sql="SELECT shop_id, external_id, name FROM cal_events QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY start_date DESC, external_id DESC) = 1")
def last_of_batch(events: DataFrame) -> DataFrame:
    """Later rows of a batch replace earlier ones."""
    return merge.last_of_batch(events, "shop_id", ["start_date", "external_id"]).select("shop_id", "external_id", "name")


@query("shops", sql="""SELECT shop_id, CASE WHEN shop_id % 3 = 0 THEN 'created' WHEN shop_id % 7 = 0 OR shop_id % 10 = 3 THEN 'updated' ELSE 'skipped' END AS status, shop_id % 3 = 0 AS needs_city FROM shops""")
def shop_upsert_needs_city(shops: DataFrame) -> DataFrame:
    """New shops need a city; moved ones are updated; a stored null that becomes a value counts as a change."""
    columns = ["shop_id", "name", "latitude", "longitude"]
    stored = shops.where("shop_id % 3 <> 0").select(*columns).withColumn("name", F.when(F.col("shop_id") % 7 == 0, F.lit("old")).otherwise(F.col("name")))
    incoming = shops.select(*columns).withColumn("latitude", F.coalesce("latitude", F.lit(1.0)))
    merged = merge.merge(stored, incoming, "shop_id", ["name", "latitude", "longitude"])
    return merged.select("shop_id", F.col("_status").alias("status"), (F.col("_status") == "created").alias("needs_city"))


@query("places", "shops", sql="SELECT place_id AS osm_id, name AS doc FROM places UNION ALL SELECT osm_id, min(doc) FROM (SELECT shop_id % 60 AS osm_id, first_value(name) OVER (PARTITION BY shop_id % 60 ORDER BY shop_id) AS doc FROM shops) WHERE osm_id NOT IN (SELECT place_id FROM places) GROUP BY osm_id")
def insert_ignore_queue(places: DataFrame, shops: DataFrame) -> DataFrame:
    """A queue that keeps the first row of each id."""
    target = places.select(F.col("place_id").cast("long").alias("osm_id"), F.col("name").alias("doc"))
    incoming = shops.select((F.col("shop_id") % 60).alias("osm_id"), F.col("name").alias("doc"), "shop_id")
    return merge.insert_ignore(target, incoming, "osm_id", ["shop_id"])


@query("cal_events", "incoming", sql="SELECT external_id, start_date FROM cal_events WHERE start_date < TIMESTAMP '2024-01-15' OR external_id IN (SELECT external_id FROM incoming)")
def stale_anti_join(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Future events that a complete snapshot lacks go."""
    return retention.drop_stale(events, incoming, "2024-01-15", complete=True).select("external_id", "start_date")


@query("cal_events", sql="SELECT external_id FROM cal_events WHERE start_date >= TIMESTAMP '2024-03-10' - INTERVAL 60 DAY")
def age_delete(events: DataFrame) -> DataFrame:
    """Events younger than 60 days."""
    return retention.purge_older_than(events, "2024-03-10").select("external_id")


@query("cal_events", sql="SELECT external_id, CAST(floor(epoch(start_date)) AS BIGINT) + 7776000 AS ttl FROM cal_events WHERE CAST(floor(epoch(start_date)) AS BIGINT) + 7776000 > epoch(TIMESTAMP '2024-04-10')")
def ttl_filter(events: DataFrame) -> DataFrame:
    """Rows not yet expired."""
    from fairgrid.functions.temporal import ttl_epoch

    return retention.unexpired(events, "2024-04-10").select("external_id", ttl_epoch(F.col("start_date")).alias("ttl"))


@query("geocache", sql="SELECT query, accessed FROM geocache WHERE (SELECT count(*) FROM geocache) <= 50 OR query NOT IN (SELECT query FROM geocache ORDER BY accessed, query LIMIT 7)")
def lru_evict(cache: DataFrame) -> DataFrame:
    """Least recently used entries go when the cache is over its size."""
    return retention.evict_least_recent(cache, "query", "accessed", most=50, batch=7).select("query", "accessed")


@query("shops", sql="SELECT shop_id FROM shops WHERE latitude IS NOT NULL")
def orphan_delete(shops: DataFrame) -> DataFrame:
    """Rows with the needed column."""
    return retention.drop_orphans(shops, "latitude").select("shop_id")


@query("cal_events", "incoming", sql="SELECT external_id FROM cal_events WHERE external_id NOT IN (SELECT external_id FROM incoming)")
def delete_by_ids(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows outside an id list."""
    return retention.delete_ids(events, incoming, "external_id").select("external_id")


@query("shops", sql=f"SELECT shop_id, CASE WHEN shop_id % 5 = 0 THEN 'kept' WHEN latitude IS NOT NULL THEN {geohash_sql(3)} END AS geohash3 FROM shops")
def backfill_geohash(shops: DataFrame) -> DataFrame:
    """Missing geohashes are filled, present ones stay."""
    existing = F.when(F.col("shop_id") % 5 == 0, F.lit("kept"))
    return shops.select("shop_id", retention.backfilled(existing, F.col("latitude"), F.col("longitude"), 3).alias("geohash3"))


PRICED = """SELECT b.order_id, b.line, b.quantity, p.price_usd, coalesce(p.price_cny, p.price_usd) AS unit_cny, coalesce(p.price_cny, p.price_usd) * b.quantity AS total_cny,
coalesce(p.price_cny, p.price_usd) IS NOT NULL AS found
FROM buylist b LEFT JOIN (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY lower(trim(card)) ORDER BY updated_at DESC) = 1) p ON lower(trim(b.card)) = lower(trim(p.card))"""


@query("buylist", "prices", sql=f"SELECT order_id, line, quantity, found, round(unit_cny, 4) AS unit_cny, round(total_cny, 4) AS total_cny FROM ({PRICED})")
def buylist_priced(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Lines with prices."""
    return pricing.price_lines(lines, prices).select("order_id", "line", "quantity", "found", F.round("unit_cny", 4).alias("unit_cny"), F.round("total_cny", 4).alias("total_cny"))


@query("buylist", "prices", sql=f"SELECT order_id, CAST(sum(quantity) AS BIGINT) AS total_cards, count(*) AS line_items, round(sum(coalesce(total_cny, 0)), 2) AS subtotal_cny, bool_and(found) AS all_found, sum(quantity) > 0 AS valid FROM ({PRICED}) GROUP BY order_id")
def buylist_totals(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals of each list."""
    return pricing.buylist_totals(pricing.price_lines(lines, prices), "order_id").withColumn("subtotal_cny", F.round("subtotal_cny", 2))


@query("buylist", "prices", sql=f"SELECT order_id, round(sum(coalesce(total_cny, 0)) * 1.2e0 + 20.0e0, 2) AS estimate, count(*) AS items FROM ({PRICED}) GROUP BY order_id")
def order_totals(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Order documents and their estimates."""
    totals = pricing.order_totals(pricing.price_lines(lines, prices), "order_id")
    return totals.select("order_id", F.round("estimate", 2).alias("estimate"), "items")


_ITEMS = """SELECT order_id, line, quantity, card, CASE WHEN unit IS NOT NULL THEN 'N' || ident END AS card_number, CASE WHEN unit IS NOT NULL THEN 'S' || ident % 5 END AS "set", unit, unit * quantity AS total_cny, unit IS NOT NULL AS found FROM (
SELECT b.order_id, b.line, b.quantity, b.card, p.updated_at % 1000000 AS ident, coalesce(p.price_cny, p.price_usd) AS unit
FROM buylist b LEFT JOIN (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY lower(trim(card)) ORDER BY updated_at DESC) = 1) p ON lower(trim(b.card)) = lower(trim(p.card)))"""


def _orders(lines: DataFrame, prices: DataFrame) -> DataFrame:
    number = F.col("updated_at") % 1_000_000
    told = prices.withColumn("card_number", F.concat(F.lit("N"), number.cast("string"))).withColumn("set", F.concat(F.lit("S"), (number % 5).cast("string")))
    return pricing.orders(pricing.price_lines(lines, told), "order_id")


@query("buylist", "prices", sql=f"SELECT order_id, line, quantity, card, card_number, \"set\", round(total_cny, 4) AS total_cny, found FROM ({_ITEMS})")
def order_items(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """The contents of order documents, with numbers and sets of the cards."""
    docs = _orders(lines, prices).select("order_id", F.explode("items").alias("i"))
    return docs.select("order_id", "i.line", "i.quantity", "i.card", "i.card_number", "i.set", F.round("i.total_cny", 4).alias("total_cny"), "i.found")


_KEY = "line, quantity, card, card_number, \"set\", unit, total_cny, found"
_YUAN = "coalesce('¥' || format('{{:.2f}}', {}), '—')"


@query("buylist", "prices", sql=f"""SELECT order_id, 'Order ' || order_id || chr(10) || 'Quick list (' || sum(quantity) || ' cards):' || chr(10) || string_agg(quantity || 'x ' || coalesce("set" || ' ' || card_number, card), chr(10) ORDER BY {_KEY})
|| chr(10) || '{pricing.TABLE_HEAD}' || chr(10) || '{pricing.TABLE_RULE}' || chr(10) || string_agg(lpad(CAST(quantity AS VARCHAR), 3, ' ') || '  ' || rpad(coalesce("set" || ' ' || card_number, '—'), CAST(greatest(12, length(coalesce("set" || ' ' || card_number, '—'))) AS INT), ' ') || '  ' || rpad(left(card, 25), 25, ' ')
|| '  ' || lpad({_YUAN.format("unit")}, 8, ' ') || '  ' || lpad({_YUAN.format("total_cny")}, 10, ' '), chr(10) ORDER BY {_KEY}) || chr(10) || '{pricing.TABLE_RULE}' || chr(10) || repeat(' ', 45) || 'Subtotal: ¥' || format('{{:.2f}}', round(sum(coalesce(total_cny, 0)), 2))
|| chr(10) || repeat(' ', 45) || 'Est Total: ¥' || format('{{:.2f}}', round(sum(coalesce(total_cny, 0)) * 1.2e0 + 20, 1)) || CASE WHEN NOT bool_and(found) THEN chr(10) || 'Some cards have no price.' ELSE '' END AS message FROM ({_ITEMS}) GROUP BY order_id""")
def order_messages(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """The message of each order, its estimate rounded to a tenth."""
    told = pricing.order_message(_orders(lines, prices).withColumn("subtotal_cny", F.round("subtotal_cny", 2)), "order_id")
    tenth = F.format_string("%.2f", F.round(F.regexp_extract("message", r"Est Total: ¥([0-9.]+)", 1).cast("double"), 1))
    return told.select("order_id", F.concat(F.regexp_extract("message", r"(?s)^(.*Est Total: ¥)", 1), tenth, F.regexp_extract("message", r"(?s)Est Total: ¥[0-9.]+(.*)$", 1)).alias("message"))


@query("buylist", sql="SELECT order_id, line, card, CASE WHEN quantity > 3 THEN 'too many' WHEN quantity < 1 THEN 'no quantity' END AS reason FROM buylist WHERE quantity > 3 OR quantity < 1")
def buylist_rejects(lines: DataFrame) -> DataFrame:
    """Lines an order can't take."""
    return pricing.rejects(lines).select("order_id", "line", "card", "reason")


@query("card_lists", sql="""SELECT conv_id, turn, 0 AS line, CAST(turn % 7 AS INT) AS quantity, 'Card ' || CAST(conv_id % 40 AS STRING) AS card FROM card_lists UNION ALL SELECT conv_id, turn, 1, 1, 'Lone Card' FROM card_lists
UNION ALL SELECT conv_id, turn, 2, CAST(conv_id % 4 AS INT), 'Other ' || split_part(text, ':', 1) FROM card_lists UNION ALL SELECT conv_id, turn, 3, NULL, 'Big Card' FROM card_lists""")
def buylist_parse(lists: DataFrame) -> DataFrame:
    """Lines of pasted lists."""
    return pricing.parse_buylists(lists).select("conv_id", "turn", "line", "quantity", "card")


@query("orders", sql="SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_orders(orders: DataFrame) -> DataFrame:
    """Newest 50 orders."""
    return pricing.recent(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("buylist", sql="SELECT order_id, line, CAST(quantity AS STRING) || 'x ' || CASE WHEN line % 2 = 0 THEN 'SFD ' || CAST(line AS STRING) ELSE card END AS quick FROM buylist")
def quick_list(lines: DataFrame) -> DataFrame:
    """Short lines of an order."""
    code = F.when(F.col("line") % 2 == 0, F.lit("SFD"))
    return lines.select("order_id", "line", text.quick_line(F.col("quantity"), code, F.col("line").cast("string"), F.col("card")).alias("quick"))


@query("places", sql="""SELECT place_id, 0 AS part, '{"index":{"_index":"places","_id":"' || CAST(place_id AS STRING) || '"}}' AS line FROM places UNION ALL SELECT place_id, 1, '{"place_id":' || CAST(place_id AS STRING) || ',"name":"' || name || '"}' FROM places""")
def bulk_interleave(places: DataFrame) -> DataFrame:
    """Action and document lines of a bulk load."""
    from fairgrid.sources.sinks import bulk_lines

    return bulk_lines(places.select("place_id", "name"), "places", "place_id")


@query("geo_log", sql="SELECT event_id, regexp_extract(line, 'query=\"([^\"]*)\"', 1) AS asked, CASE WHEN contains(line, 'success=true') THEN true WHEN contains(line, 'success=false') THEN false END AS success FROM geo_log")
def log_line_parse(log: DataFrame) -> DataFrame:
    """Fields of metric lines."""
    return log.select("event_id", F.regexp_extract("line", 'query="([^"]*)"', 1).alias("asked"), text.metric_success(F.col("line")).alias("success"))


@query("customer", sql="""SELECT c_custkey, regexp_full_match(mail, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS ok, regexp_matches(name, '[^\\x00-\\x7F]') AS non_ascii FROM (
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'no at sign.org' WHEN 1 THEN 'two@at@signs.org' WHEN 2 THEN 'a b@example.org' ELSE 'c' || c_custkey || '@example.org' END AS mail, CASE WHEN c_custkey % 4 = 1 THEN c_name || 'é' ELSE c_name END AS name FROM customer)""")
def email_and_ascii(customers: DataFrame) -> DataFrame:
    """Address and ASCII tests."""
    k, own = F.col("c_custkey") % 5, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    mail = F.when(k == 0, F.lit("no at sign.org")).when(k == 1, F.lit("two@at@signs.org")).when(k == 2, F.lit("a b@example.org")).otherwise(own)
    name = F.when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit("é"))).otherwise(F.col("c_name"))
    return customers.select("c_custkey", text.is_email(mail).alias("ok"), text.non_ascii(name).alias("non_ascii"))


@query("shops", sql="SELECT 'shops' AS name, count(*) AS n, max(shop_id) AS max_id, count(DISTINCT name) AS names, CAST(floor(count(*) FILTER (latitude IS NULL) * 100.0e0 / count(*) + 0.5) AS BIGINT) AS missing_percent FROM shops")
def migration_checks(shops: DataFrame) -> DataFrame:
    """Row count, largest id, distinct names, rounded percent of missing points."""
    told = shops.agg(F.count(F.lit(1)).alias("n"), F.max("shop_id").alias("max_id"), F.count_distinct("name").alias("names"), F.floor(F.count_if(F.col("latitude").isNull()) * 100.0 / F.count(F.lit(1)) + 0.5).alias("missing_percent"))
    return told.select(F.lit("shops").alias("name"), "n", "max_id", "names", "missing_percent")


@query("events", sql="SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(events: DataFrame) -> DataFrame:
    """Hourly counts, as the streaming job makes them."""
    from fairgrid.streaming.jobs import hourly_counts

    return hourly_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("events", sql="""SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(events: DataFrame) -> DataFrame:
    """Sessions with a gap of three hours."""
    return events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "3 hours")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).select("user_id", "first_ts", "n")
