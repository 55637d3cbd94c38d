"""Access-log and geocoder reports, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairgrid.functions import temporal, text, weblog

#: Registers of a distinct-count sketch, as a power of two.
SKETCH_BITS = 14


def with_visitor(log: DataFrame) -> DataFrame:
    """Add ``visitor``."""
    return log.withColumn("visitor", weblog.visitor_id(F.col("cookie"), F.col("ip")))


def since(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return log.where(F.col("date") >= F.date_sub(F.to_date(F.lit(as_of)), days).cast("string"))


def wide_report(log: DataFrame) -> DataFrame:
    """All single-number metrics: each visitor's counts first, so that distinct visitors are counted on one row a visitor."""
    uri = F.col("uri")
    home, page, visit = uri.isin("/", "/index.html"), uri.rlike(weblog.EVENT_PAGE), uri.rlike("/(visit|register)$")
    counted = {
        "requests": F.lit(True), "successful": weblog.is_success(F.col("status")), "homepage": home, "event_pages": page, "api_calls": uri.startswith("/api/"),
        "calendar_api": uri == "/api/events", "geocode_api": uri.startswith("/api/events/geocode"), "visits": visit,
    }
    each = with_visitor(log).groupBy("visitor").agg(*(F.count_if(c).alias(n) for n, c in counted.items()), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    seen = {"homepage_visitors": "homepage", "event_page_visitors": "event_pages", "visit_visitors": "visits"}
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counted]
    told = each.agg(*sums, F.count("visitor").alias("visitors"), *(F.count_if(F.col("visitor").isNotNull() & (F.col(c) > 0)).alias(n) for n, c in seen.items()), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    pages = log.where(page).select("uri").distinct().agg(F.count(F.lit(1)).alias("events_viewed"))
    return told.join(F.broadcast(pages))  # one row each


def daily(log: DataFrame) -> DataFrame:
    """Requests, visitors and bytes by day."""
    return with_visitor(log).groupBy("date").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("visitor").alias("visitors"), F.sum("bytes").alias("bytes"))


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def geocode_report(log: DataFrame) -> DataFrame:
    """Cache hit rate and provider error rate, cut to one decimal; null without calls."""
    kind, success = text.metric_type(F.col("line")), text.metric_success(F.col("line"))
    counts = log.agg(
        F.count_if(kind == "cache_hit").alias("hits"), F.count_if(kind == "cache_miss").alias("misses"), F.count_if(kind.startswith("mapbox_")).alias("provider_calls"),
        F.count_if(success).alias("successes"), F.count_if(~success).alias("errors"),
        *(F.count_if(kind == f"mapbox_{name}").alias(name) for name in ("forward", "reverse", "autocomplete")),
    )
    hit_rate = temporal.percent_truncated(F.col("hits"), F.col("hits") + F.col("misses"))
    return counts.withColumn("hit_rate", hit_rate).withColumn("error_rate", temporal.percent_truncated(F.col("errors"), F.col("errors") + F.col("successes")))


def geocode_correlation(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Autocomplete calls of the geocoder log against visitors (by address) and location searches of the access log, cut ratios."""
    calls = log.agg(F.count_if(text.metric_type(F.col("line")) == "mapbox_autocomplete").alias("calls"))
    asked = requests.agg(F.count_distinct("ip").alias("visitors"), F.count_if(F.col("uri").startswith("/api/events/geocode")).alias("searches"))
    told = calls.join(F.broadcast(asked))  # one row each
    return told.select(
        "calls", "visitors", "searches", temporal.percent_truncated(F.col("calls") / 100.0, F.col("visitors"), 3).alias("calls_per_visitor"),
        temporal.percent_truncated(F.col("calls"), F.col("searches")).alias("calls_per_search"), (F.col("searches") - F.col("calls")).alias("saved_calls"),
    )


def daily_partials(log: DataFrame) -> DataFrame:
    """What reports need of each day, a row a day: sums, and sketches of distinct visitors and event pages that can be united."""
    page = F.when(F.col("uri").rlike(weblog.EVENT_PAGE), F.col("uri"))
    return with_visitor(log).groupBy("date").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(weblog.is_success(F.col("status"))).alias("successful"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.hll_sketch_agg("visitor", SKETCH_BITS).alias("visitors"), F.hll_sketch_agg(page, SKETCH_BITS).alias("event_pages"),
    )


def with_days(state: DataFrame, days: DataFrame) -> DataFrame:
    """``state`` with the rows of ``days`` in place of its own of these dates: a late or repeated day is replaced, never added twice."""
    return state.join(F.broadcast(days.select("date")), "date", "left_anti").unionByName(days)  # a row a day


def report_of_days(state: DataFrame, first: str, last: str) -> DataFrame:
    """One row over the days from ``first`` to ``last``: days, exact sums, and distinct visitors and event pages to about 0.8 % (one standard deviation)."""
    inside = state.where(F.col("date").between(first, last))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "successful", "bytes")]
    united = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in ("visitors", "event_pages")]
    return inside.agg(F.count(F.lit(1)).alias("days"), *sums, *united)


def trailing_reports(state: DataFrame, days: int = 7) -> DataFrame:
    """:func:`report_of_days` for the ``days`` days up to each date: each day's row goes to the windows that hold it, and these are united."""
    ends = F.explode(F.sequence(F.to_date("date"), F.date_add(F.to_date("date"), days - 1)))
    spread = state.withColumn("end", ends).withColumn("end", F.col("end").cast("string")).join(F.broadcast(state.select(F.col("date").alias("end"))), "end")
    sums = [F.sum(c).alias(c) for c in ("requests", "successful", "bytes")]
    return spread.groupBy("end").agg(F.count(F.lit(1)).alias("days"), *sums, *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("visitors", "event_pages")))


# The labels of the report's lines, each padded to 21 letters, and how its tables' lines are laid out.
REPORT_LABELS = {
    "Total requests": "requests", "Unique visitors": "visitors", "Successful requests": "successful", "Homepage": ("homepage", "homepage_visitors"), "Event details": ("event_pages", "event_page_visitors"),
    "Unique events viewed": "events_viewed", "Total API calls": "api_calls", "Calendar requests": "calendar_api", "Location searches": "geocode_api", "Visit store clicks": ("visits", "visit_visitors"),
}
PAGE_LINE, DAY_LINE, BROWSER_LINE = "%8d  %s", "%s: %6d requests, %5d unique", "%10s: %8d (%.1f%%)"


def report_lines(log: DataFrame, pages: int = 10, days: int = 14) -> DataFrame:
    """The traffic report as lines: ``section, place, line``; in that order they are the document.

    Sections: 0 dates, 1 numbers (with distinct visitors where they are told), 2 the most requested ``pages``, 3 the
    last ``days`` by date, 4 browsers by requests with their share. Parts are aggregates of the log, a few rows each.
    """
    wide = wide_report(log)
    number = lambda c: F.format_number(F.col(c), 0)
    told = []
    for label, names in REPORT_LABELS.items():
        one, unique = names if isinstance(names, tuple) else (names, None)
        own = F.concat(F.rpad(F.lit(f"{label}:"), 21, " "), number(one))
        told.append(F.concat(own, F.lit(" ("), number(unique), F.lit(" unique)")) if unique else own)
    dates = F.concat(F.lit("Date range: "), F.col("first_date"), F.lit(" to "), F.col("last_date"))
    lines = F.array(F.struct(F.lit(0).alias("section"), F.lit(1).alias("place"), dates.alias("line")), *(F.struct(F.lit(1).alias("section"), F.lit(k + 1).alias("place"), line.alias("line")) for k, line in enumerate(told)))
    out = wide.select(F.inline(lines))

    def ranked(rows: DataFrame, section: int, order: list[Column], line: Column) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))  # few rows
        return rows.select(F.lit(section).alias("section"), place.alias("place"), line.alias("line"))

    by_day = daily(log).orderBy(F.desc("date")).limit(days)
    by_browser = log.groupBy(weblog.browser(F.col("agent"), "A").alias("browser")).agg(F.count(F.lit(1)).alias("n"))
    share = by_browser.join(F.broadcast(wide.select(F.col("requests").alias("_all"))))  # one row
    return (
        out.unionByName(ranked(top(log, "uri", pages), 2, [F.desc("n"), F.col("uri")], F.format_string(PAGE_LINE, "n", "uri")))
        .unionByName(ranked(by_day, 3, [F.col("date")], F.format_string(DAY_LINE, "date", "requests", "visitors")))
        .unionByName(ranked(share, 4, [F.desc("n"), F.col("browser")], F.format_string(BROWSER_LINE, "browser", "n", F.col("n") * 100.0 / F.col("_all"))))
    )


def rate_limited(rows: DataFrame, key: str, ts: str, order: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Add ``allowed``: whether the row is among the first ``limit`` of its key and epoch-aligned window."""
    framed = rows.withColumn("_w", F.window(ts, window)["start"])
    return framed.withColumn("allowed", F.row_number().over(Window.partitionBy(key, "_w").orderBy(ts, order)) <= limit).drop("_w")
