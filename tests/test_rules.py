"""Limits from the first request, suggestions, surrogate keys, mixed items, validation, reports by day, the queue of places."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fairgrid.operators import geocode, limits, merge, traffic, upkeep, validation
from fairgrid.schema import EventQuery
from fairgrid.sources import readers


def plain_limits(rows, limit, seconds):
    """A walk over each key's requests in order."""
    out, opened = {}, {}
    for i, key, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        key = "unknown" if key is None else key
        start, n = opened.get(key, (None, 0))
        if start is None or at >= start + seconds:
            start, n = at, 0
        opened[key] = (start, n + 1)
        out[i] = n < limit
    return out | {r[0]: None for r in rows if r[2] is None}


@pytest.mark.parametrize("seed", range(3))
def test_limits_follow_the_first_request(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([rng.randint(0, 3000), rng.randint(0, 400), 60 * rng.randint(0, 50), None if i % 40 == 0 else 7])) for i in range(1500)]
    table = spark.createDataFrame(rows, "id long, ip string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for chunk in (60, 100, 3600):
        got = {r.id: r.allowed for r in limits.limited(table.repartition(3), "ip", "ts", "id", 3, 60, chunk).collect()}
        assert got == plain_limits(rows, 3, 60)
    assert limits.limited(table.limit(0), "ip", "ts", "id", 3).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        limits.limited(table, "ip", "ts", "id", 3, 60, 59)


def test_suggestions_for_a_table_of_prefixes(spark):
    names = ["San Jose", "San Juan", "Santa Fe", "san jose", "Sankt 100%", "A" * 20, "A" * 13 + "b", None, "x"]
    places = spark.createDataFrame([(i, n, "city", f"{(n or '').lower()} label") for i, n in enumerate(names)], "place_id long, name string, type string, label string")
    zips = spark.createDataFrame([("78701", "Austin", "TX")], "zipcode string, city string, state_code string")
    asked = ["sa", " SAN ", "san j", "s", "78701", " 78701", "00000", "zz", "aaaaaaaaaaaaa", "A" * 20, "sankt 100%", "sankt 1_0%", None, "", "  x"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in geocode.suggest_all(queries, places, zips, limit=3).orderBy("query_id", "rank").collect():
        got.setdefault(asked[r.query_id], []).append((r.name, r.label))
    assert got == {
        "sa": [("San Jose", "san jose label"), ("San Juan", "san juan label"), ("Santa Fe", "santa fe label")], " SAN ": [("San Jose", "san jose label"), ("San Juan", "san juan label"), ("Santa Fe", "santa fe label")],
        "san j": [("San Jose", "san jose label"), ("San Juan", "san juan label")], "78701": [("78701", "Austin, TX 78701")], " 78701": [("78701", "Austin, TX 78701")],
        "aaaaaaaaaaaaa": [("A" * 20, "a" * 20 + " label"), ("A" * 13 + "b", "a" * 13 + "b label")], "A" * 20: [("A" * 20, "a" * 20 + " label")], "sankt 100%": [("Sankt 100%", "sankt 100% label")],
    }


def most_rows(plan):
    """The most rows that any operator of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    return max([0, *own, *map(most_rows, inner)])


def test_long_prefixes_that_many_names_share(spark):
    places = spark.range(1000).select(F.col("id").alias("place_id"), F.format_string("Customer#%09d", F.col("id")).alias("name"), F.lit("city").alias("type"), (F.col("id") % 3).cast("string").alias("label"))
    zips = spark.createDataFrame([("78701", "Austin", "TX"), ("78701", "Bee Cave", "TX")], "zipcode string, city string, state_code string")
    queries = spark.range(400).select(F.col("id").alias("query_id"), F.when(F.col("id") == 0, "78701").when(F.col("id") == 1, "customer#000000998").otherwise("CUSTOMER#0000").alias("query"))
    found = geocode.suggest_all(queries, places, zips)
    rows = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert rows[:2] == [(0, 1, "78701", "postcode", "Austin, TX 78701"), (1, 1, "Customer#000000998", "city", "2")]
    assert rows[2:] == [(q, k + 1, f"Customer#{k:09d}", "city", str(k)) for q in range(2, 400) for k in range(3)]
    found = geocode.suggest_all(queries, places, zips, every=True)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(r for r in rows if r[0] == 0) == [(0, 1, "78701", "postcode", f"{c}, TX 78701") for c in ("Austin", "Bee Cave")]
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 5000  # not names times queries


def test_new_surrogates_are_gapless_and_stable(spark):
    known = spark.createDataFrame([("b", 7), ("x", 3)], "natural string, surrogate long")
    naturals = spark.createDataFrame([(n,) for n in [*(f"k{i % 500:04d}" for i in range(2000)), "b", None]], "natural string")
    told = upkeep.new_surrogates(known, naturals, parts=5)
    rows = sorted(map(tuple, told.collect()))
    assert rows == [(f"k{i:04d}", 8 + i) for i in range(500)]
    assert sorted(map(tuple, upkeep.new_surrogates(known, naturals.repartition(7), parts=3).collect())) == rows
    assert sorted(map(tuple, upkeep.new_surrogates(known.limit(0), naturals.where("natural = 'b'")).collect())) == [("b", 1)]
    assert upkeep.new_surrogates(known.unionByName(told), naturals).count() == 0
    windows = [line for line in told._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number()" in line]
    assert windows and all("windowspecdefinition(_part" in line for line in windows)  # single tasks see counts of ranges only


def test_typed_items_from_one_scan(spark, tmp_path):
    items = [
        '{"entityType":"SHOP","PK":"SHOP#5","SK":"a","externalId":5,"name":"N","latitude":1.5,"longitude":"2.5","tag":{"a":1}}', '{"entityType":"SHOP","PK":"SHOP#a#b","latitude":"north"}', '{"entityType":"EVENT","PK":"EVENT#1","startDate":"2024-01-02T03:04:05","playerCount":3.0}',
        '{"entityType":"EVENT","PK":"EVENT#2","startDate":"soon"}', '{"entityType":"NEWS","PK":"X#1"}', "{broken", "[1]", None, '{"entityType":"ZIPCODE","PK":"ZIP#00501","zipcode":"00501"}',
    ]
    tables = upkeep.typed_items(spark.createDataFrame([(x,) for x in items], "item string"), str(tmp_path / "t"))
    shops = {r.id: r for r in tables["SHOP"].collect()}
    assert (shops["5"].externalId, shops["5"].latitude, shops["5"].longitude, shops["5"].other) == (5, 1.5, 2.5, {"tag": '{"a":1}'})
    assert (shops["a#b"].latitude, shops["a#b"].name) == (None, None)
    events = {r.id: (str(r.startDate), r.playerCount) for r in tables["EVENT"].collect()}
    assert events == {"1": ("2024-01-02 03:04:05", 3), "2": ("None", None)}
    assert tables["GEOCACHE"].count() == 0 and tables["ZIPCODE"].first().zipcode == "00501"
    assert sorted((r.item or "" for r in tables["OTHER"].collect())) == ["", "[1]", '{"entityType":"NEWS","PK":"X#1"}', "{broken"]
    folders = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("kind=")}
    assert folders == {"kind=SHOP", "kind=EVENT", "kind=OTHER", "kind=ZIPCODE"}


def test_checked_pages_keep_corrupt_ones(spark, tmp_path):
    good = {"id": 1, "name": "A", "start_datetime": "2024-01-01T00:00:00Z", "cost_in_cents": 5, "currency": None, "latitude": 1, "longitude": 2, "capacity": 4, "registered_user_count": 5}
    (tmp_path / "a.json").write_text(json.dumps({"current_page_number": 1, "results": [good, {"id": 2, "name": " ", "start_datetime": "x", "latitude": 95.0, "store": {"name": ""}}, {"id": 3, "name": "C", "start_datetime": "2024-01-01"}]}))
    (tmp_path / "b.json").write_text('{"current_page_number": 2, "results": [{"id": ')
    events, corrupt = validation.read_checked_pages(spark, str(tmp_path))
    got = {r.id: (r.errors, r.valid) for r in events.collect()}
    assert got == {1: (["cost without currency", "more players than seats"], False), 2: (["no name", "unreadable start", "latitude out of range", "half a coordinate", "store without a name"], False), 3: ([], True)}
    assert [r.file.rsplit("/", 1)[1] for r in corrupt.collect()] == ["b.json"] and corrupt.first().page.startswith('{"current_page_number": 2')
    counts = {r.rule: r.n for r in validation.broken_rules(events, validation.wire_rules()).collect()}
    assert counts["no name"] == 1 and counts["no id"] == 0 and len(counts) == len(validation.wire_rules())
    assert readers.read_pages(spark, str(tmp_path / "a.json")).count() == 3


def test_reports_of_days_replace_late_days(spark):
    rows = [(f"2024-01-{1 + i % 9:02d}", f"ip{i % 700}", "-", "/event/ab-" + str(i % 40), "200", i) for i in range(5000)]
    log = spark.createDataFrame(rows, "date string, ip string, cookie string, uri string, status string, bytes long")
    state = traffic.daily_partials(log.where("bytes % 3 = 0 or date < '2024-01-05'"))
    state = traffic.with_days(state, traffic.daily_partials(log.where("date >= '2024-01-05'")))
    state = traffic.with_days(state, traffic.daily_partials(log.where("date >= '2024-01-05'")))  # and once more
    told = traffic.report_of_days(state, "2024-01-01", "2024-01-09").first()
    assert (told.days, told.requests, told.successful, told.bytes) == (9, 5000, 5000, sum(range(5000)))
    assert abs(told.visitors - 700) <= 21 and abs(told.event_pages - 40) <= 1
    assert tuple(traffic.report_of_days(state, "2030-01-01", "2030-01-09").first()) == (0, 0, 0, 0, 0, 0)
    trailing = {r.end: r for r in traffic.trailing_reports(state, 3).collect()}
    for end, days in (("2024-01-01", 1), ("2024-01-06", 3)):
        inside = [r for r in rows if int(end[-2:]) - 3 < int(r[0][-2:]) <= int(end[-2:])]
        assert (trailing[end].days, trailing[end].requests) == (days, len(inside)) and abs(trailing[end].visitors - len({r[1] for r in inside})) <= 21


def test_public_answers_are_queued(spark):
    queries = spark.createDataFrame([(1, "Sato UK"), (2, " paris fr "), (3, "austin"), (4, "nowhere"), (5, "PARIS FR")], "query_id long, query string")
    answered = spark.createDataFrame([(1, "public"), (2, "public"), (3, "local"), (4, "public"), (5, "public")], "query_id long, source string")
    kind = "struct<osm_id:long,osm_type:string,osm_value:string,type:string,name:string,city:string,county:string,state:string,country:string,countrycode:string>"
    features = spark.createDataFrame(
        [("sato uk", (9, "W", "industrial", "house", "Sato", None, "Essex", "England", "United Kingdom", "gb")), ("paris fr", (7, "relation", "city", "city", "Paris", "Paris", None, "IdF", "France", "fr")), ("nowhere", (8, "N", "house", "house", "x", "", None, None, None, None)), ("austin", (1, "N", "city", "city", "Austin", None, None, None, None, "us"))],
        f"query string, feature {kind}",
    )
    queue = spark.createDataFrame([(100, "{}")], "osm_id long, doc string")
    told = {r.osm_id: r.doc for r in geocode.enqueued(answered, queries, features, queue).collect()}
    assert told.pop(100) == "{}"
    paris = json.loads(told.pop(7))
    assert (paris["name"], paris["osm_type"], paris["type"]) == ("Paris", "R", "city")
    ((extracted, doc),) = told.items()
    assert 800_000_000 <= extracted < 900_000_000 and (json.loads(doc)["name"], json.loads(doc)["type"], json.loads(doc)["countrycode"]) == ("Essex", "county", "GB")
    again = geocode.enqueued(answered, queries, features, geocode.enqueued(answered, queries, features, queue))
    assert again.count() == 3  # the extracted place keeps its id, so nothing is queued twice


def test_stable_ids(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    ids = [r[0] for r in rows.select(geocode.stable_id(F.col("k"), 5)).collect()]
    assert ids == [r[0] for r in rows.select(geocode.stable_id(F.col("k"), 5)).collect()]
    assert all(5 <= i < 100_000_005 for i in ids) and len(set(ids)) > 1990


def test_shops_without_coordinates_or_ids(spark):
    store = "struct<id:long,name:string,full_address:string,latitude:double,longitude:double>"
    raw = spark.createDataFrame([(1, 0, (5, "old", "a", 1.0, 1.0)), (1, 1, (5, "new", "a", 0.0, 1.0)), (1, 2, None), (2, 0, (None, "no id", "a", 1.0, 1.0)), (2, 1, (6, "B", None, None, None))], f"page int, position int, store {store}")
    shops = {r.shop_id: r for r in merge.wire_shops(raw).collect()}
    assert set(shops) == {5, 6} and (shops[5].name, shops[5].geohash3) == ("new", None) and shops[6].geohash4 is None


def test_equal_filters_have_one_key():
    a, b = EventQuery(radius_km=50), EventQuery(radius_km=50.0)
    assert a == b and a.key() == b.key() and EventQuery.of_key(a.key()).key() == a.key()
    assert EventQuery(radius_km=12.5, lat=1, lng=2).key() == EventQuery(radius_km=12.5, lat=1.0, lng=2.0).key()
