"""Queries of traffic, geocoder and database reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import temporal, text, weblog
from fairgrid.operators import traffic
from fairgrid.plans.registry import query

# Patterns and names of the access-log classes, as in functions/weblog.py.
VISITOR = "coalesce(nullif(regexp_extract(cookie, 'mid=([a-f0-9-]+)', 1), ''), ip)"
PAGE = "regexp_matches(uri, '^/events?/[a-f0-9-]+$')"
VISIT = "regexp_matches(uri, '/(visit|register)$')"
HOME = "uri IN ('/', '/index.html')"
CATEGORY = f"""CASE WHEN {HOME} THEN 'Homepage' WHEN {PAGE} THEN 'Event Detail' WHEN uri = '/api/events' THEN 'Calendar API' WHEN uri LIKE '/api/events/geocode%' THEN 'Location Search'
WHEN uri LIKE '/api/%' THEN 'Other API' WHEN uri LIKE '/assets/%' OR regexp_matches(uri, '\\.(js|css|png|ico)$') THEN 'Static Assets' ELSE 'Other' END"""


@query("access_log", sql=f"""SELECT count(*) AS requests, count(DISTINCT {VISITOR}) AS visitors, count(*) FILTER (regexp_matches(status, '^[23]')) AS successful, count(*) FILTER ({HOME}) AS homepage,
count(DISTINCT CASE WHEN {HOME} THEN {VISITOR} END) AS homepage_visitors, count(*) FILTER ({PAGE}) AS event_pages, count(DISTINCT CASE WHEN {PAGE} THEN {VISITOR} END) AS event_page_visitors,
count(DISTINCT CASE WHEN {PAGE} THEN uri END) AS events_viewed, count(*) FILTER (uri LIKE '/api/%') AS api_calls, count(*) FILTER (uri = '/api/events') AS calendar_api,
count(*) FILTER (uri LIKE '/api/events/geocode%') AS geocode_api, count(*) FILTER ({VISIT}) AS visits, count(DISTINCT CASE WHEN {VISIT} THEN {VISITOR} END) AS visit_visitors,
min(date) AS first_date, max(date) AS last_date FROM access_log""")
def traffic_report_wide(log: DataFrame) -> DataFrame:
    """All single-number metrics."""
    return traffic.wide_report(log)


@query("access_log", sql=f"SELECT {VISITOR} AS visitor, count(*) AS requests FROM access_log GROUP BY 1")
def visitor_distinct(log: DataFrame) -> DataFrame:
    """Requests of each visitor."""
    return traffic.with_visitor(log).groupBy("visitor").agg(F.count(F.lit(1)).alias("requests"))


@query("access_log", sql=f"SELECT date, count(*) AS requests, count(DISTINCT {VISITOR}) AS visitors, CAST(sum(bytes) AS BIGINT) AS bytes FROM access_log GROUP BY date")
def daily_traffic(log: DataFrame) -> DataFrame:
    """By day."""
    return traffic.daily(log)


@query("access_log", sql=f"""SELECT round(avg(requests), 4) AS mean_requests, round(avg(visitors), 4) AS mean_visitors, round(sum(bytes) / 1e9, 2) AS total_gb FROM
(SELECT date, count(*) AS requests, count(DISTINCT {VISITOR}) AS visitors, sum(bytes) AS bytes FROM access_log GROUP BY date)""")
def daily_traffic_mean(log: DataFrame) -> DataFrame:
    """Means over days."""
    return traffic.daily(log).agg(F.round(F.avg("requests"), 4).alias("mean_requests"), F.round(F.avg("visitors"), 4).alias("mean_visitors"), F.round(F.sum("bytes") / 1e9, 2).alias("total_gb"))


@query("access_log", sql="SELECT * FROM (SELECT date, count(*) AS n FROM access_log GROUP BY date ORDER BY date DESC LIMIT 14) ORDER BY date")
def last_14_days(log: DataFrame) -> DataFrame:
    """The report's tail."""
    return log.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("date")).limit(14).orderBy("date")


@query("access_log", sql="SELECT count(*) AS n FROM access_log WHERE date >= '2024-01-08'")
def recent_rows(log: DataFrame) -> DataFrame:
    """Rows of the last week before 15 January."""
    return traffic.since(log, "2024-01-15", 7).agg(F.count(F.lit(1)).alias("n"))


def _counted(label: str, total: str, unique: str | None = None) -> str:
    seen = f" || ' (' || format('{{:,}}', count(DISTINCT CASE WHEN {total} THEN {unique} END)) || ' unique)'" if unique else ""
    return f"rpad('{label}:', 21, ' ') || format('{{:,}}', count(*) FILTER ({total})){seen}"


_NUMBERS = [
    _counted("Total requests", "true"), f"rpad('Unique visitors:', 21, ' ') || format('{{:,}}', count(DISTINCT {VISITOR}))", _counted("Successful requests", "regexp_matches(status, '^[23]')"), _counted("Homepage", HOME, VISITOR),
    _counted("Event details", PAGE, VISITOR), f"rpad('Unique events viewed:', 21, ' ') || format('{{:,}}', count(DISTINCT CASE WHEN {PAGE} THEN uri END))", _counted("Total API calls", "uri LIKE '/api/%'"),
    _counted("Calendar requests", "uri = '/api/events'"), _counted("Location searches", "uri LIKE '/api/events/geocode%'"), _counted("Visit store clicks", VISIT, VISITOR),
]


@query("access_log", sql="SELECT 0 AS section, 1 AS place, 'Date range: ' || min(date) || ' to ' || max(date) AS line FROM access_log UNION ALL " + " UNION ALL ".join(f"SELECT 1, {k + 1}, {line} FROM access_log" for k, line in enumerate(_NUMBERS)) + f""" UNION ALL
SELECT 2, CAST(row_number() OVER (ORDER BY n DESC, uri) AS INT), lpad(CAST(n AS VARCHAR), 8, ' ') || '  ' || uri FROM (SELECT uri, count(*) AS n FROM access_log GROUP BY uri ORDER BY n DESC, uri LIMIT 10) UNION ALL
SELECT 3, CAST(row_number() OVER (ORDER BY date) AS INT), date || ': ' || lpad(CAST(n AS VARCHAR), 6, ' ') || ' requests, ' || lpad(CAST(v AS VARCHAR), 5, ' ') || ' unique' FROM (SELECT date, count(*) AS n, count(DISTINCT {VISITOR}) AS v FROM access_log GROUP BY date ORDER BY date DESC LIMIT 14)
UNION ALL SELECT 4, CAST(row_number() OVER (ORDER BY n DESC, browser) AS INT), lpad(browser, 10, ' ') || ': ' || lpad(CAST(n AS VARCHAR), 8, ' ') || ' (' || format('{{:.1f}}', n * 100.0e0 / (SELECT count(*) FROM access_log)) || '%)' FROM (
SELECT CASE WHEN contains(agent, 'Chrome') THEN 'Chrome' WHEN contains(agent, 'Firefox') THEN 'Firefox' WHEN contains(agent, 'Safari') THEN 'Safari' WHEN contains(agent, 'Edge') THEN 'Edge' WHEN regexp_matches(lower(agent), 'bot|crawler') THEN 'Bot' ELSE 'Other' END AS browser, count(*) AS n FROM access_log GROUP BY 1)""")
def report_lines(log: DataFrame) -> DataFrame:
    """The traffic report as a document of lines."""
    return traffic.report_lines(log)


@query("access_log", sql="SELECT uri, count(*) AS n FROM access_log GROUP BY uri ORDER BY n DESC, uri LIMIT 15")
def top_pages(log: DataFrame) -> DataFrame:
    """Top 15 paths."""
    return traffic.top(log, "uri", 15)


@query("access_log", sql="SELECT edge, count(*) AS n FROM access_log GROUP BY edge ORDER BY n DESC, edge LIMIT 10")
def top_edges(log: DataFrame) -> DataFrame:
    """Top 10 edges."""
    return traffic.top(log, "edge", 10)


@query("access_log", sql="""SELECT CASE WHEN contains(agent, 'Chrome') THEN 'Chrome' WHEN contains(agent, 'Firefox') THEN 'Firefox' WHEN contains(agent, 'Safari') THEN 'Safari' WHEN contains(agent, 'Edge') THEN 'Edge'
WHEN regexp_matches(lower(agent), 'bot|crawler') THEN 'Bot' ELSE 'Other' END AS browser, count(*) AS n FROM access_log GROUP BY 1""")
def browser_a(log: DataFrame) -> DataFrame:
    """Browsers, Chrome tested first."""
    return log.groupBy(weblog.browser(F.col("agent"), "A").alias("browser")).agg(F.count(F.lit(1)).alias("n"))


@query("access_log", sql="""SELECT CASE WHEN regexp_matches(lower(agent), 'bot|crawler|spider') THEN 'Bot' WHEN contains(agent, 'Chrome') AND NOT contains(agent, 'Edg') THEN 'Chrome' WHEN contains(agent, 'Firefox') THEN 'Firefox'
WHEN contains(agent, 'Safari') AND NOT contains(agent, 'Chrome') THEN 'Safari' WHEN contains(agent, 'Edg') THEN 'Edge' ELSE 'Other' END AS browser, count(*) AS n FROM access_log GROUP BY 1""")
def browser_b(log: DataFrame) -> DataFrame:
    """Browsers, bots tested first."""
    return log.groupBy(weblog.browser(F.col("agent")).alias("browser")).agg(F.count(F.lit(1)).alias("n"))


@query("access_log", sql=f"SELECT {CATEGORY} AS category, count(*) AS requests, count(DISTINCT ip) AS ips FROM access_log WHERE {CATEGORY} <> 'Static Assets' GROUP BY 1")
def path_category_stats(log: DataFrame) -> DataFrame:
    """Requests and addresses by kind of page, static files aside."""
    told = log.select(weblog.path_category(F.col("uri")).alias("category"), "ip").where("category <> 'Static Assets'")
    return told.groupBy("category").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"))


@query("access_log", sql=f"SELECT date, count(*) AS views, count(DISTINCT ip) AS ips, count(DISTINCT uri) AS pages FROM access_log WHERE {PAGE} GROUP BY date")
def event_view_metrics(log: DataFrame) -> DataFrame:
    """Event pages by day."""
    return log.where(F.col("uri").rlike(weblog.EVENT_PAGE)).groupBy("date").agg(F.count(F.lit(1)).alias("views"), F.count_distinct("ip").alias("ips"), F.count_distinct("uri").alias("pages"))


@query("access_log", sql=f"SELECT count(*) FILTER ({HOME}) AS homepage, count(*) FILTER ({PAGE}) AS event_page, count(*) FILTER (uri LIKE '/api/%') AS api, count(*) FILTER ({VISIT}) AS visit FROM access_log WHERE regexp_matches(status, '^[23]')")
def page_class_counts(log: DataFrame) -> DataFrame:
    """Classes of successful requests."""
    uri = F.col("uri")
    return log.where(weblog.is_success(F.col("status"))).agg(
        F.count_if(uri.isin("/", "/index.html")).alias("homepage"), F.count_if(uri.rlike(weblog.EVENT_PAGE)).alias("event_page"), F.count_if(uri.startswith("/api/")).alias("api"), F.count_if(uri.rlike("/(visit|register)$")).alias("visit")
    )


@query("geo_log", sql="SELECT regexp_extract(line, 'type=([a-z_]+)', 1) AS type, count(*) AS n FROM geo_log GROUP BY 1")
def geocode_by_type(log: DataFrame) -> DataFrame:
    """Metric lines by type."""
    return log.groupBy(text.metric_type(F.col("line")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("geo_log", sql="""SELECT *, CASE WHEN hits + misses > 0 THEN CAST(hits * 1000 // (hits + misses) AS DOUBLE) / 10 END AS hit_rate, CASE WHEN errors + successes > 0 THEN CAST(errors * 1000 // (errors + successes) AS DOUBLE) / 10 END AS error_rate FROM
(SELECT count(*) FILTER (contains(line, 'type=cache_hit')) AS hits, count(*) FILTER (contains(line, 'type=cache_miss')) AS misses, count(*) FILTER (contains(line, 'type=mapbox_')) AS provider_calls,
count(*) FILTER (contains(line, 'type=mapbox_forward')) AS forward, count(*) FILTER (contains(line, 'type=mapbox_reverse')) AS reverse, count(*) FILTER (contains(line, 'type=mapbox_autocomplete')) AS autocomplete,
count(*) FILTER (contains(line, 'success=true')) AS successes, count(*) FILTER (contains(line, 'success=false')) AS errors FROM geo_log)""")
def geocode_report(log: DataFrame) -> DataFrame:
    """Hit and error rates."""
    return traffic.geocode_report(log)


@query("access_log", "geo_log", sql=f"""SELECT calls, visitors, CAST(calls * 1000 // visitors AS DOUBLE) / 1000 AS calls_per_visitor FROM (SELECT count(*) FILTER (contains(line, 'type=mapbox_')) AS calls FROM geo_log),
(SELECT count(DISTINCT {VISITOR}) AS visitors FROM access_log)""")
def calls_per_visitor(log: DataFrame, geo_log: DataFrame) -> DataFrame:
    """Provider calls against visitors: two one-row results."""
    calls = geo_log.agg(F.count_if(F.col("line").contains("type=mapbox_")).alias("calls"))
    visitors = traffic.with_visitor(log).agg(F.count_distinct("visitor").alias("visitors"))
    return calls.join(F.broadcast(visitors)).withColumn("calls_per_visitor", temporal.percent_truncated(F.col("calls") / 100.0, F.col("visitors"), 3))


@query("events", sql="""SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 minute', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_limit_windows(events: DataFrame) -> DataFrame:
    """Requests allowed within each user's minute."""
    return traffic.rate_limited(events, "user_id", "ts", "event_id", 2).select("event_id", "allowed")


@query("cal_events", "shops", "runs", sql="""SELECT 'events' AS metric, count(*) AS n FROM cal_events UNION ALL SELECT 'shops', count(*) FROM shops UNION ALL SELECT 'geocoded_shops', count(*) FROM shops WHERE latitude IS NOT NULL
UNION ALL SELECT 'completed_runs', count(*) FROM runs WHERE status = 'completed'""")
def overview_union_all(events: DataFrame, shops: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts by name."""
    parts = {"events": events, "shops": shops, "geocoded_shops": shops.where("latitude is not null"), "completed_runs": runs.where("status = 'completed'")}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in parts.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


@query("cal_events", sql="SELECT CAST(CAST(start_date AS DATE) AS STRING) AS day, count(*) AS n FROM cal_events WHERE start_date >= TIMESTAMP '2024-01-08' GROUP BY 1 ORDER BY 1")
def events_per_day(events: DataFrame) -> DataFrame:
    """By day from a cutoff."""
    return events.where(F.col("start_date") >= F.lit("2024-01-08").cast("timestamp_ntz")).groupBy(F.to_date("start_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day")


@query("cal_events", sql="SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean FROM (SELECT CAST(start_date AS DATE) AS day, count(*) AS n FROM cal_events GROUP BY 1)")
def daily_total_and_mean(events: DataFrame) -> DataFrame:
    """Sum and mean of the daily series."""
    days = events.groupBy(F.to_date("start_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 4).alias("mean"))


@query("cal_events", sql="SELECT coalesce(event_type, 'Unknown') AS type, count(*) AS n FROM cal_events GROUP BY 1 ORDER BY n DESC, type LIMIT 15")
def events_by_type_top15(events: DataFrame) -> DataFrame:
    """Types by count."""
    return traffic.top(events.select(F.coalesce("event_type", F.lit("Unknown")).alias("type")), "type", 15)


@query("shops", sql="SELECT state, count(*) AS n FROM shops WHERE country = 'AMERICA' OR country IS NULL GROUP BY state ORDER BY n DESC, state LIMIT 20")
def shops_by_state_top(shops: DataFrame) -> DataFrame:
    """Shops of one country by state."""
    return traffic.top(shops.where("country = 'AMERICA' or country is null"), "state", 20)


@query("runs", sql="SELECT CAST(CAST(started_at AS DATE) AS STRING) AS day, count(*) AS runs, CAST(sum(events_found) AS BIGINT) AS found, CAST(sum(events_created) AS BIGINT) AS created FROM runs GROUP BY 1")
def runs_per_day(runs: DataFrame) -> DataFrame:
    """Run counters by day."""
    return runs.groupBy(F.to_date("started_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("events_found").alias("found"), F.sum("events_created").alias("created"))


@query("access_log", sql=f"SELECT event_id, split_part(ip || ', 10.1.1.1', ',', 1) AS client, {CATEGORY} AS category FROM access_log")
def first_forwarded_ip(log: DataFrame) -> DataFrame:
    """The client's address of a forwarding header."""
    return log.select("event_id", text.first_forwarded(F.concat("ip", F.lit(", 10.1.1.1"))).alias("client"), weblog.path_category(F.col("uri")).alias("category"))
