"""Adapter views: the calendar's tables told from the driver's tables.

A view's text is valid in Spark and in DuckDB; ``{table}`` names a base table or another view. Spark runs it over
DataFrames, ``ctes`` gives the same views as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "shops": """
SELECT s_suppkey AS shop_id, s_name AS name, n_name AS state, r_name AS country,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 30 + (s_suppkey * 37 % 2000) / 100.0e0 END AS latitude,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE -120 + (s_suppkey * 91 % 5000) / 100.0e0 END AS longitude
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "cal_events": """
SELECT event_id AS external_id, user_id % 120 AS shop_id, ts AS start_date, event_id * 7919 % 10007 AS created_at,
       CASE event_type WHEN 'signup' THEN 'Pre-Rift party ' WHEN 'click' THEN 'Nexus Night ' WHEN 'view' THEN 'Summoner Skirmish ' ELSE 'Casual ' END || CAST(user_id % 9 AS STRING) AS name,
       CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'Weekly 100% fun' ELSE 'Bring a deck_box' END AS description,
       CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE 'Store ' || CAST(user_id % 40 AS STRING) END AS location,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'Org ' || CAST(user_id % 25 AS STRING) END AS organizer,
       'City' || CAST(user_id % 30 AS STRING) AS city, 'State' || CAST(user_id % 7 AS STRING) AS state,
       CASE WHEN user_id % 7 < 5 THEN 'United States' ELSE 'Österreich' END AS country,
       CASE event_type WHEN 'signup' THEN 'Pre-Rift' WHEN 'click' THEN 'Nexus Night' WHEN 'view' THEN 'Summoner Skirmish' WHEN 'error' THEN NULL ELSE 'Other' END AS event_type,
       CAST(user_id % 33 AS INT) AS player_count, CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(user_id % 17 AS INT) END AS capacity,
       CAST(floor(value * 100) AS BIGINT) AS cost_in_cents, CASE user_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'AUD' END AS currency
FROM {events}""",
    "runs": """
SELECT o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 9 <> 0 THEN o_orderdate END AS completed_at, o_custkey % 300 AS events_found, o_custkey % 50 AS events_created
FROM {orders}""",
    "access_log": """
SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS date, '10.0.0.' || CAST(user_id AS STRING) AS ip, 'EDGE' || CAST(user_id % 12 AS STRING) AS edge,
       CASE WHEN event_id % 17 = 0 THEN '/assets/app.js' WHEN event_id % 19 = 0 THEN '/about' WHEN event_type = 'click' THEN '/event/ab-' || CAST(user_id % 50 AS STRING)
            WHEN event_type = 'view' THEN '/' WHEN event_type = 'signup' THEN '/api/events/geocode' WHEN event_type = 'purchase' THEN '/api/events'
            ELSE '/api/events/' || CAST(event_id % 20 AS STRING) || '/visit' END AS uri,
       CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 23 = 0 THEN '304' ELSE '200' END AS status,
       CASE event_id % 7 WHEN 0 THEN 'Mozilla Chrome/1 Safari/2' WHEN 1 THEN 'Mozilla Firefox/3' WHEN 2 THEN 'Mozilla Safari/4' WHEN 3 THEN 'Mozilla Chrome/1 Safari/2 Edg/5'
            WHEN 4 THEN 'Googlebot Chrome/1' WHEN 5 THEN 'a Crawler' ELSE 'curl' END AS agent,
       CASE WHEN event_id % 4 = 0 THEN 'sid=1; mid=ab-' || CAST(user_id % 60 AS STRING) ELSE '-' END AS cookie, CAST(floor(value * 1000) AS BIGINT) AS bytes
FROM {events}""",
    "geo_log": """
SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS date, '[GEOCODE] type=' || CASE event_id % 6 WHEN 0 THEN 'cache_hit' WHEN 1 THEN 'cache_miss' WHEN 2 THEN 'cache_hit' WHEN 3 THEN 'mapbox_forward'
       WHEN 4 THEN 'mapbox_reverse' ELSE 'zip_lookup' END || ' query="q' || CAST(user_id AS STRING) || '"' ||
       CASE WHEN event_id % 6 IN (3, 4) THEN CASE WHEN event_id % 13 = 0 THEN ' success=false' ELSE ' success=true' END ELSE '' END AS line
FROM {events}""",
    "prices": """
SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS card, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price_usd,
       CASE WHEN p_size % 3 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_retailprice * 7 END AS price_cny, p_partkey AS updated_at FROM {part}
UNION ALL SELECT ' ' || upper(p_name || ' ' || CAST(p_partkey AS STRING)), p_retailprice + 1, p_retailprice * 8, p_partkey + 1000000 FROM {part} WHERE p_partkey % 7 = 0""",
    "buylist": """
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS INT) % 5 AS quantity,
       CASE WHEN l_partkey % 20 = 0 THEN 'Unknown ' || CAST(l_partkey AS STRING) ELSE '  ' || upper(p_name) || ' ' || CAST(l_partkey AS STRING) END AS card
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "stored": """
SELECT external_id, name, description, start_date, player_count, shop_id, created_at FROM {cal_events} WHERE external_id % 3 <> 0""",
    "incoming": """
SELECT external_id, CASE WHEN external_id % 8 = 0 THEN name || ' (moved)' ELSE name END AS name, CASE WHEN external_id % 10 = 0 THEN NULL ELSE description END AS description,
       start_date, player_count, shop_id FROM {cal_events} WHERE external_id % 2 = 0""",
    "places": """
SELECT n_nationkey AS place_id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'city' ELSE 'town' END AS type, r_name AS region,
       25 + (n_nationkey * 53 % 31) * 1.0e0 AS latitude, -125 + (n_nationkey * 17 % 59) * 1.0e0 AS longitude
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "zipcodes": """
SELECT lpad(CAST(c_custkey AS STRING), 5, '0') AS zipcode, c_name AS city, 20 + (c_custkey % 50) * 0.5e0 AS latitude, -110 + (c_custkey % 90) * 0.5e0 AS longitude FROM {customer}""",
    "geocache": """
SELECT lower(s_name) AS query, 10 + (s_suppkey % 60) * 0.5e0 AS latitude, (s_suppkey % 120) * 0.5e0 AS longitude, s_suppkey * 31 % 1009 AS accessed FROM {supplier}""",
    "geo_queries": """
SELECT c_custkey AS query_id, CASE c_custkey % 6 WHEN 0 THEN ' ' || lpad(CAST(c_custkey * 2 AS STRING), 5, '0') WHEN 1 THEN 'SUPPLIER#' || lpad(CAST(c_custkey % 300 AS STRING), 9, '0') WHEN 2 THEN n_name || ' '
       WHEN 3 THEN n_name || ', uk' WHEN 4 THEN 'ukraine ' || n_name ELSE 'nowhere' END AS query
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "shop_state": """
SELECT shop_id, name, CASE WHEN shop_id % 6 = 0 THEN NULL WHEN shop_id % 6 = 1 THEN '' ELSE state || ', ' || country END AS location_text, latitude, longitude,
       CASE WHEN shop_id % 4 = 0 THEN 'completed' ELSE 'pending' END AS geocode_status, CASE WHEN shop_id % 9 = 0 THEN 'old error' END AS geocode_error,
       CASE WHEN shop_id % 5 = 0 THEN 'Old City' END AS display_city, CAST('2024-01-01' AS DATE) + CAST(shop_id % 20 AS INT) AS created_on
FROM {shops}""",
    "geocode_results": """
SELECT shop_id, CASE WHEN shop_id % 3 = 0 THEN NULL ELSE 10.5e0 END AS latitude, CASE WHEN shop_id % 3 = 0 THEN NULL ELSE 20.5e0 END AS longitude, CASE WHEN shop_id % 3 = 0 THEN 'no result' END AS error,
       CASE WHEN shop_id % 10 = 0 THEN 'New City' END AS display_city
FROM {shops} WHERE shop_id % 2 = 0""",
    "wire": """
SELECT external_id AS id, name, description, start_date, cost_in_cents, currency, capacity, player_count, city, shop_id, 'T' || CAST(external_id % 4 AS STRING) AS template,
       CASE WHEN external_id % 13 = 0 THEN NULL ELSE 'Store ' || CAST(shop_id AS STRING) END AS store_name, CASE WHEN external_id % 3 = 0 THEN 'TX' ELSE 'Store Town' END AS store_city,
       '1 Road, ' || city || ', TX 78701, US' AS full_address, CASE WHEN external_id % 5 = 0 THEN NULL ELSE 30 + (shop_id * 37 % 2000) / 100.0e0 END AS latitude, 31.25e0 AS store_latitude, -97.75e0 AS longitude
FROM {cal_events}""",
    "items": """
SELECT 'SHOP' AS entity_type, CAST(shop_id AS STRING) AS id, CAST(NULL AS STRING) AS shop_id, CAST(NULL AS TIMESTAMP) AS start_date, CAST(NULL AS STRING) AS index_key FROM {shops}
UNION ALL SELECT 'EVENT', CAST(external_id AS STRING), CASE WHEN external_id % 7 = 0 THEN NULL ELSE CAST(shop_id AS STRING) END, CAST(start_date AS TIMESTAMP), CASE WHEN external_id % 4 = 0 THEN 'SHOP#kept' END FROM {cal_events}
UNION ALL SELECT 'GEOCACHE', query, NULL, NULL, NULL FROM {geocache} UNION ALL SELECT 'SCRAPE_RUN', CAST(run_id AS STRING), NULL, CAST(started_at AS TIMESTAMP), NULL FROM {runs}
UNION ALL SELECT 'ZIPCODE', zipcode, NULL, NULL, NULL FROM {zipcodes}""",
    "json_items": """
SELECT '{{"entityType":"SHOP","PK":"SHOP#' || CAST(shop_id AS STRING) || '","SK":"SHOP","externalId":' || CAST(shop_id AS STRING) || ',"name":"' || name || '","latitude":' || coalesce(CAST(latitude AS STRING), 'null') || ',"note":"n' || CAST(shop_id AS STRING) || '"}}' AS item FROM {shops}
UNION ALL SELECT '{{"entityType":"EVENT","PK":"EVENT#' || CAST(external_id AS STRING) || '","name":"' || name || '","startDate":"' || CAST(start_date AS STRING) || '","shopExternalId":' || CAST(shop_id AS STRING) || ',"playerCount":' || CAST(player_count AS STRING) || ',"extra":[1,2]}}' FROM {cal_events}
UNION ALL SELECT '{{"PK":"GEOCACHE#' || query || '","query":"' || query || '","latitude":' || CAST(latitude AS STRING) || ',"entityType":"GEOCACHE","note":"g"}}' FROM {geocache}
UNION ALL SELECT '{{"entityType":"SCRAPE_RUN","PK":"RUN#' || CAST(run_id AS STRING) || '","startedAt":"' || CAST(started_at AS STRING) || '","status":"' || status || '","eventsFound":' || CASE WHEN run_id % 5 = 0 THEN '"many"' ELSE CAST(events_found AS STRING) END || '}}' FROM {runs}
UNION ALL SELECT '{{"entityType":"ZIPCODE","PK":"ZIP#' || zipcode || '","zipcode":"' || zipcode || '","city":"' || city || '","latitude":' || CAST(latitude AS STRING) || '}}' FROM {zipcodes}
UNION ALL SELECT 'not JSON ' || zipcode FROM {zipcodes}""",
    "card_lists": """
SELECT conv_id, turn, role || ':' || chr(10) || CAST(turn % 7 AS STRING) || 'x Card ' || CAST(conv_id % 40 AS STRING) || chr(10) || 'MainDeck' || chr(10) || chr(10) || '  Lone Card  ' || chr(10) ||
       CAST(conv_id % 4 AS STRING) || ' Other ' || role || chr(10) || '99999999999 Big Card' AS text FROM {conversations}""",
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    """The named tables and views as DataFrames."""
    return tuple(_frame(spark, sf_dir, n) for n in names)


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = re.findall(r"\{(\w+)\}", VIEWS[name])
    return spark.sql(VIEWS[name], **{n: _frame(spark, sf_dir, n) for n in needed})


def ctes(*names: str) -> str:
    """``WITH`` and the named views, with the views that they need before them."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
            need(n)
        order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format_map({t: t for t in [*TABLES, *VIEWS]}).strip()})" for n in order) + "\n"
