"""Merges, retention, spatial joins, plans, sources, sinks and streams."""

import gzip
import itertools
import json
import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fairgrid import schema
from fairgrid.functions import temporal
from fairgrid.operators import merge, pricing, retention, search, spatial, traffic
from fairgrid.plans.views import frames
from fairgrid.schema import EventQuery
from fairgrid.sources import readers, sinks
from fairgrid.streaming import jobs

SCHEMA = "external_id long, name string, start_date timestamp_ntz"


def table(spark, rows, schema="external_id long, name string"):
    return spark.createDataFrame(rows, schema)


def test_merge_is_idempotent_and_null_aware(spark):
    stored = table(spark, [(1, "a"), (2, None), (3, "c"), (5, None)])
    incoming = table(spark, [(2, None), (3, None), (4, "d"), (5, "e")])
    once = merge.merge(stored, incoming, "external_id", ["name"])
    assert {r.external_id: (r.name, r._status) for r in once.collect()} == {1: ("a", "kept"), 2: (None, "skipped"), 3: (None, "updated"), 4: ("d", "created"), 5: ("e", "updated")}
    twice = merge.merge(once.drop("_status"), incoming, "external_id", ["name"])
    assert sorted(twice.drop("_status").collect(), key=str) == sorted(once.drop("_status").collect(), key=str)
    assert {r._status for r in twice.collect()} == {"kept", "skipped"}


def test_stale_rows_need_a_complete_snapshot(spark):
    rows = spark.sql("select 1L external_id, 'a' name, timestamp_ntz'2024-02-01 00:00:00' start_date union all select 2L, 'b', timestamp_ntz'2023-01-01 00:00:00' union all select 3L, 'c', timestamp_ntz'2024-03-01 00:00:00'")
    seen = table(spark, [(3, "c")])
    ids = lambda df: sorted(r.external_id for r in df.collect())
    assert ids(retention.drop_stale(rows, seen, "2024-01-15", complete=True)) == [2, 3]
    assert ids(retention.drop_stale(rows, seen, "2024-01-15", complete=False)) == [1, 2, 3]
    assert ids(retention.drop_stale(rows, seen.limit(0), "2024-01-15", complete=True)) == [1, 2, 3]


@pytest.mark.parametrize(("rows", "left"), [(10, 10), (11, 8)])
def test_eviction_starts_over_the_limit(spark, rows, left):
    cache = spark.range(rows).select(F.col("id").cast("string").alias("query"), F.col("id").alias("accessed"))
    assert retention.evict_least_recent(cache, "query", "accessed", most=10, batch=3).count() == left


def test_insert_ignore_keeps_the_first(spark):
    target, incoming = table(spark, [(1, "old")]), table(spark, [(1, "new"), (2, "b"), (2, "a")])
    assert {(r.external_id, r.name) for r in merge.insert_ignore(target, incoming, "external_id", ["name"]).collect()} == {(1, "old"), (2, "a")}


@pytest.mark.parametrize("radius", [50.0, 700.0, 5000.0])
def test_radius_join_equals_all_pairs(spark, radius):
    from tests.test_functions import distance

    spots = [(i, lat, lng) for i, (lat, lng) in enumerate(itertools.product([-89.0, -60.0, 0.0, 0.2, 45.0, 85.0], [-180.0, -179.8, -10.0, 0.0, 179.9, 100.0]))]
    points = spark.createDataFrame(spots, "point_id long, lat double, lng double")
    rows = spark.createDataFrame(spots, "row_id long, latitude double, longitude double")
    got = sorted((r.point_id, r.row_id) for r in spatial.within_radius(points, rows, radius).collect())
    assert got == sorted((a, b) for (a, *p), (b, *q) in itertools.product(spots, spots) if distance(*p, *q) <= radius)


def test_plans(spark, small):
    events, shops = frames(spark, small, "cal_events", "shops")
    found = search.search(events, shops, EventQuery(search="night", lat=40.0, lng=-95.0, radius_km=500))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    total = search.total(events, shops, EventQuery(search="night"))
    assert "Join" not in total._jdf.queryExecution().executedPlan().toString()


def test_rate_limit(spark):
    rows = spark.sql("select id, 'k' ip, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 10) ts from range(12)")
    allowed = [r.allowed for r in traffic.rate_limited(rows, "ip", "ts", "id", 4).orderBy("id").collect()]
    assert allowed == [True] * 4 + [False] * 2 + [True] * 4 + [False] * 2


def test_unknown_cards_and_missing_prices(spark):
    lines = spark.createDataFrame([(1, 0, 2, " a "), (1, 1, 3, "zz"), (2, 0, 1, "B")], "order_id int, line int, quantity int, card string")
    prices = spark.createDataFrame([("A", 2.0, None), ("b", None, None)], "card string, price_usd double, price_cny double")
    totals = {r.order_id: (r.total_cards, r.subtotal_cny, r.all_found) for r in pricing.buylist_totals(pricing.price_lines(lines, prices), "order_id").collect()}
    assert totals == {1: (5, 4.0, False), 2: (1, 0.0, False)}


def test_access_log_reader(spark, tmp_path):
    full = "\t".join(["2024-01-02", "03:04:05", "E", "12", "1.1.1.1", "GET", "h", "/", "200", "-", "UA", "-", "mid=a"])
    (tmp_path / "a.log").write_text("#Version: 1.0\n" + full + "\n" + "too\tshort\n\n" + full.replace("12", "x").replace("2024-01-02", "2023-01-02") + "\n")
    log = readers.read_access_logs(spark, str(tmp_path / "a.log"))
    got = log.orderBy("date").select("date", "bytes", "cookie", "range_end").collect()
    assert [tuple(r) for r in got] == [("2023-01-02", None, "mid=a", ""), ("2024-01-02", 12, "mid=a", "")]
    assert readers.read_access_logs(spark, str(tmp_path / "a.log"), "2024-01-01").count() == 1


def test_zip_and_price_readers(spark, tmp_path):
    head = "country,zip,place,n1,c1,n2,c2,lat,lng\n"
    (tmp_path / "z.csv").write_text(head + "US,00001,A,S,SS,,,1.5,2\nUS,1,B,S,SS,,,1,2\nCA,00002,C,S,SS,,,1,2\nUS,00003,D,S,SS,,,x,2\nUS,00001,E,S,SS,,,3,4\n")
    assert [(r.zipcode, r.city, r.latitude) for r in readers.read_zipcodes(spark, str(tmp_path / "z.csv")).collect()] == [("00001", "E", 3.0)]
    (tmp_path / "q.json").write_text('[{"cardName":"E","priceUsd":"abc","priceCny":3},{"cardName":"F","priceUsd":"2.5"}]')
    good, bad = readers.read_prices(spark, str(tmp_path / "q.json"))
    assert [(r.card, r.price_usd) for r in good.collect()] == [("F", 2.5)] and [(r.card, r.reason) for r in bad.collect()] == [("E", "unreadable price")]
    (tmp_path / "p.json").write_text('[{"cardName":" A ","priceUsd":1.5},{"cardName":"B","price":2},{"cardName":"C"},{"cardName":"D","priceCny":-1}]')
    good, bad = readers.read_prices(spark, str(tmp_path / "p.json"))
    assert sorted((r.card, r.price_usd) for r in good.collect()) == [("A", 1.5), ("B", 2.0)]
    assert sorted((r.card, r.reason) for r in bad.collect()) == [("C", "no price"), ("D", "negative price")]
    (tmp_path / "p.csv").write_text("card_name,price_usd,set\nX, 3.5 ,S1\n,1,\n")
    good, bad = readers.read_prices(spark, str(tmp_path / "p.csv"))
    assert [(r.card, r.price_usd, r.set) for r in good.collect()] == [("X", 3.5, "S1")] and bad.count() == 1


def test_card_fields(spark):
    card = '<div data-testid="eventCard-{i}"><p data-testid="eventCard-text-title">{t}</p><span data-testid="eventCard-text-entryFee">{f}</span><svg/>12<!-- --> Players</div>'
    page = card.format(i=11, t="One", f="Free") + card.format(i=12, t="Two", f="$5") + card.format(i=11, t="", f="")
    got = readers.card_fields(spark.createDataFrame([(page,)], "html string")).orderBy("external_id").collect()
    assert [(r.external_id, r.title, r.fee, r.players, r.store, r.image) for r in got] == [("11", "One", "Free", 12, None, None), ("12", "Two", "$5", 12, None, None)]
    full = (
        '<div data-testid="eventCard-13"><img alt="" src="http://i/x.png"/><p data-testid="eventCard-text-title">Three</p><p data-testid="eventCard-text-date">Jan 5, 2024</p>'
        '<p data-testid="eventCard-text-time">6:30 PM (UTC)</p><div><svg class="lucide-users"></svg>8<!-- --> Players</div><div><svg class="lucide-trophy"></svg>Sealed</div>'
        '<p data-testid="eventCard-text-storeName">Ohio, US</p><div><svg class="lucide-store"></svg>Shop A</div><span data-testid="eventCard-text-entryFee">$3</span></div>'
    )
    r = readers.card_fields(spark.createDataFrame([(full,)], "html string")).first()
    assert (str(r.date), r.time, r.players, r.format, r.region, r.store, r.image) == ("2024-01-05", "6:30 PM (UTC)", 8, "Sealed", "Ohio, US", "Shop A", "http://i/x.png")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, extra string")
    assert sorted(r.line for r in sinks.json_lines(rows).collect()) == ['{"id":1,"name":"a"}', '{"id":2,"name":"b","extra":"x"}']
    sinks.write_bulk(rows.coalesce(1), str(tmp_path / "bulk"), "i", "id")
    lines = [x for f in sorted((tmp_path / "bulk").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == '{"index":{"_index":"i","_id":"1"}}' and lines[1] == '{"id":1,"name":"a"}' and len(lines) == 4
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert [r.line for r in sinks.padded(rows, {"id": -3, "name": 4}).collect()] == ["  1  a   ", "  2  b   "]


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(spark.sql("select * from hours").collect()) == sorted(jobs.hourly_counts(batch).collect())


def test_merge_leaves_null_keys_to_the_rejects(spark):
    stored = spark.createDataFrame([(1, "a", 5)], "external_id long, name string, created_at int")
    incoming = table(spark, [(None, "x"), (2, "b")])
    got = merge.merge(stored, incoming, "external_id", ["name"], as_of=9).collect()
    assert {r.external_id: (r.name, r.created_at, r._status) for r in got} == {1: ("a", 5, "kept"), 2: ("b", 9, "created")}
    assert [r.name for r in merge.without_key(incoming, "external_id").collect()] == ["x"]


def test_pages_to_merged_events(spark, tmp_path):
    store = {"id": 7, "name": "Shop", "full_address": "1 Rd, Oslo, 12345 X, NO", "city": "Oslo", "state": "O", "country": "NO", "latitude": 59.9, "longitude": 10.7}
    event = {"id": 5, "name": "Nexus Night", "start_datetime": "2024-01-05T18:00:00Z", "cost_in_cents": 0, "currency": "USD", "capacity": 8, "registered_user_count": 3, "event_configuration_template": "t", "store": store}
    page = {"current_page_number": 1, "results": [event, event | {"id": 6, "store": None, "start_datetime": "soon"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = readers.read_pages(spark, str(tmp_path / "p.json"))
    events = merge.canonical_events(rows, spark.createDataFrame([("t", "Summoner Skirmish kit")], "id string, name string"))
    got = {r.external_id: r for r in events.collect()}
    assert (got["5"].event_type, got["5"].city, got["5"].price, got["5"].geohash3, got["5"].shop_name, got["5"].url) == ("Summoner Skirmish", "Oslo", "Free", "u4x", "Shop", merge.EVENT_PAGES + "5")
    assert got["6"].start_date is None and got["6"].shop_id is None and set(schema.COMPARED_EVENT) <= set(events.columns)
    merged = merge.merge(events.limit(0), events, "external_id", schema.COMPARED_EVENT)
    assert tuple(merge.ingestion_counters(merged, events).first()) == (2, 1, 2, 0, 0, 0)


def test_run_log(spark):
    log = spark.createDataFrame([], retention.RUN_LOG)
    log = retention.run_transition(log, 1, "running", "2024-01-01 00:00:00")
    log = retention.run_transition(log, 2, "running", "2024-01-01 01:00:00")
    log = retention.run_transition(log, 1, "completed", "2024-01-01 02:00:00", 9, 2, 1)
    log = retention.run_transition(log, 2, "failed", "2024-01-01 03:00:00", error="down")
    got = {r.run_id: (r.status, r.events_found, r.error_message, str(r.completed_at)) for r in retention.latest_runs(log).collect()}
    assert got == {1: ("completed", 9, None, "2024-01-01 02:00:00"), 2: ("failed", 0, "down", "2024-01-01 03:00:00")}
    with pytest.raises(ValueError):
        retention.run_transition(log, 3, "lost", "2024-01-01 00:00:00")


def test_filters_as_text():
    q = EventQuery(search="a&b =c", lat=40.123456, lng=-95.0, radius_km=50.0, calendar_mode=True)
    assert q.key() == "calendar_mode=True&lat=40.1235&lng=-95.0000&radius_km=50.0&search=a%26b+%3Dc"
    assert EventQuery.of_key(q.key()).key() == q.key() and EventQuery().key() == ""
    assert EventQuery(page=4).key() == EventQuery().key()


def test_default_window_needs_a_time():
    with pytest.raises(ValueError):
        search.event_predicates(EventQuery(default_window_days=90))


@pytest.mark.parametrize(("n", "level"), [(1, None), (40, None), (40, 4)])
def test_nearest_place_equals_all_pairs(spark, n, level):
    from tests.test_functions import distance

    spots = [(i, math.degrees(math.asin(math.sin(i * 1.7))), (i * 77.7) % 360 - 180) for i in range(60)]
    spots += [(60, 90.0, 10.0), (61, -90.0, 180.0), (62, 0.0, -180.0), (63, 0.0, -180.0)]
    places = [(i, lat * 0.9, (lng + 37) % 360 - 180) for i, lat, lng in spots[:n]] + [(100 + i, lat * 0.9, (lng + 37) % 360 - 180) for i, lat, lng in spots[:n]]
    got = {r.point_id: r.row_id for r in spatial.nearest_place(spark.createDataFrame(spots, "point_id long, lat double, lng double"), spark.createDataFrame(places, "row_id long, latitude double, longitude double"), level).collect()}
    assert got == {i: min((round(distance(*p, *q), 9), k) for k, *q in places)[1] for i, *p in spots}


def test_nearest_place_refines_dense_cells(spark):
    from tests.test_functions import distance

    dense = [(i, 45 + i % 40 * 0.01, 12 + i // 40 * 0.01) for i in range(1000)]
    places = spark.createDataFrame(dense, "row_id long, latitude double, longitude double")
    assert spatial._level_for(places) > 3
    spots = [(1, 45.105, 12.1), (2, 45.105, 12.1), (3, 45.105, 12.1), (4, -30.0, -100.0), (5, None, 3.0)]
    got = {r.point_id: r.row_id for r in spatial.nearest_place(spark.createDataFrame(spots, "point_id long, lat double, lng double"), places).collect()}
    assert got == {i: min((round(distance(*p, *q), 9), k) for k, *q in dense)[1] for i, *p in spots[:4]}


def times(spark, rows):
    """A stream's rows: time, key."""
    return spark.createDataFrame(rows, "ts string, key string").withColumn("ts", F.to_timestamp("ts")).withColumn("event_type", F.col("key"))


def streamed(spark, rows, tmp_path, job):
    """What ``job`` gives for a stream of ``rows``, one file a row, in order."""
    for k, row in enumerate(rows):
        times(spark, [row]).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    schema = times(spark, rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = job(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_limits_and_windows_of_a_batch(spark):
    rows = times(spark, [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:30", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:00:05", "b")])
    got = sorted((str(r.w.start)[11:], r.key, r.hits, r.over) for r in jobs.minute_hits(rows, "key", 2).collect())
    assert got == [("00:00:00", "a", 3, 1), ("00:00:00", "b", 1, 0), ("00:01:00", "a", 1, 0)]
    slides = sorted((str(r.w.start)[11:], r["count"]) for r in jobs.sliding_counts(rows).where("event_type = 'b'").collect())
    assert slides == [("00:00:00", 1), ("23:40:00", 1), ("23:50:00", 1)]


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "a"), ("2024-01-01 00:10:00", "b"), ("2024-01-01 00:10:30", "b"), ("2024-01-01 00:00:03", "a"), ("2024-01-01 00:20:00", "c")]
    got = streamed(spark, rows, tmp_path, lambda s: jobs.minute_hits(s, "key", 1))
    closed = {(str(r.w.start)[11:], r.key): (r.hits, r.over) for r in got.collect()}
    assert closed[("00:00:00", "a")] == (2, 1)  # the row that came after its minute had closed isn't counted


def test_stream_keeps_each_key_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "b"), ("2024-01-01 00:00:03", "a"), ("2024-01-01 00:00:04", "b")]
    assert sorted(r.key for r in streamed(spark, rows, tmp_path, lambda s: jobs.once_each(s, "key")).collect()) == ["a", "b"]


def test_counters_ride_with_the_batch(spark):
    rows = spark.createDataFrame([(1, "created"), (2, "updated"), (3, "updated"), (4, "skipped"), (5, "kept")], "id long, _status string")
    seen = Observation("counters")
    rows.observe(seen, *sinks.rate_counters()).write.format("noop").mode("overwrite").save()
    assert seen.get == {"found": 5, "created": 1, "updated": 2, "skipped": 1}


def test_days(spark):
    one = spark.range(1).select(temporal.days_between(F.lit("2024-02-28"), F.lit("2024-03-01")).alias("d")).first().d
    assert [str(d) for d in one] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_small_files(spark, tmp_path):
    (tmp_path / "ids.json").write_text('{"osm_id": 4}\n{"osm_id": 4}\n{"other": 1}\n')
    assert [r.osm_id for r in readers.known_ids(spark, str(tmp_path / "ids.json")).collect()] == [4]
    for name in ("a", "b"):
        sinks.append_lines(spark.createDataFrame([("2024", name)], "at string, query string"), str(tmp_path / "log"), "at", "query")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["2024\ta", "2024\tb"]
    line = "\t".join(["2024-01-02", "03:04:05", *"abcdefgh"]) + "\n"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/x.log").write_text(line)
    (tmp_path / "logs/x.log.gz").write_bytes(gzip.compress(line.encode()))
    assert readers.read_access_logs(spark, str(tmp_path / "logs"), packed_only=True).count() == 1
    (tmp_path / "geo.log").write_text('noise\n[GEOCODE] type=cache_hit query="q"\n')
    assert [r.line for r in readers.read_metric_lines(spark, str(tmp_path / "geo.log")).collect()] == ['[GEOCODE] type=cache_hit query="q"']


def test_sliding_counts(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:12:00", "a"), ("2024-01-01 00:12:00", "b"), ("2024-01-01 02:00:00", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 03:00:00", "b")]
    batch = spark.createDataFrame(rows, "t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    got = {(str(r.w.start), r.event_type): r["count"] for r in jobs.sliding_counts(batch).collect()}
    want = {}
    for t, kind in rows:
        minute = int(t[11:13]) * 60 + int(t[14:16])
        for start in range(minute // 10 * 10 - 20, minute // 10 * 10 + 1, 10):
            day, inside = ("2023-12-31", start + 1440) if start < 0 else ("2024-01-01", start)
            key = (f"{day} {inside // 60:02d}:{inside % 60:02d}:00", kind)
            want[key] = want.get(key, 0) + 1
    assert got == want
