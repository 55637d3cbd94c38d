"""Scalar rules against plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairgrid.functions import geo, temporal, text, weblog
from fairgrid.schema import EventQuery


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def distance(lat1, lng1, lat2, lng2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@pytest.mark.parametrize("points", [(0, 0, 0, 0), (10, 20, -10, -160), (89.9, 0, -89.9, 10), (40, 179, 41, -179), (0, 0, 0, 90)])
def test_distances(spark, points):
    args = [F.lit(float(x)) for x in points]
    assert one(spark, geo.haversine_km(*args)) == pytest.approx(distance(*points), abs=1e-6)
    assert one(spark, geo.law_of_cosines_km(*args)) == pytest.approx(distance(*points), abs=1e-3)


@settings(max_examples=200, deadline=None)
@given(st.floats(-85, 85), st.floats(-179, 179), st.floats(1, 900), st.floats(0, 1), st.floats(0, 2 * math.pi))
def test_exact_box_holds_the_circle(lat, lng, radius, share, bearing):
    d, p = share * radius / 6371, math.radians(lat)
    lat2 = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(bearing))
    lng2 = math.radians(lng) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(lat2))
    box = geo.bounding_box(lat, lng, radius, exact=True)
    x, y = math.degrees(lat2), (math.degrees(lng2) + 180) % 360 - 180
    assert box[0] - 1e-9 <= x <= box[1] + 1e-9
    assert box[2] - 1e-6 <= y <= box[3] + 1e-6


def test_plain_box_can_clip():
    assert geo.bounding_box(60, 0, 500)[3] < geo.bounding_box(60, 0, 500, exact=True)[3]


@pytest.mark.parametrize(("lat", "lng", "want"), [(37.77, -122.42, "9q8y"), (51.51, -0.13, "gcpv"), (-33.87, 151.21, "r3gx"), (59.91, 10.75, "u4xs")])
def test_geohash(spark, lat, lng, want):
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lng), 4)) == want
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lng), 3)) == want[:3]
    assert want[:3] in geo.cover_cells(lat, lng, 50, 3)


def bisected(lat, lng, letters):
    """Geohash by halving, a point on an edge in the lower half."""
    spans, out = [[-180.0, 180.0], [-90.0, 90.0]], []
    for k in range(5 * letters):
        span, value = spans[k % 2], (lng, lat)[k % 2]
        middle = sum(span) / 2
        out.append(int(value > middle))
        span[1 - out[-1]] = middle
    return "".join(geo.BASE32[int("".join(map(str, out[i : i + 5])), 2)] for i in range(0, len(out), 5))


@pytest.mark.parametrize(("lat", "lng"), [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, 0.0), (12.34, -56.78)])
def test_geohash_edges(spark, lat, lng):
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lng), 4)) == bisected(lat, lng, 4)
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lng), 3)) == bisected(lat, lng, 3)


def test_geohash_null(spark):
    assert one(spark, geo.geohash(F.lit(None).cast("double"), F.lit(1.0), 3)) is None
    assert geo.cover_cells(40, -95, 4000, 3) is None
    assert (geo.choose_precision(41), geo.choose_precision(40)) == (3, 4)


@pytest.mark.parametrize(
    ("name", "description", "want"),
    [("PRE-rift day", None, "Pre-Rift"), ("a", "prerift", "Pre-Rift"), ("pre rift", "nexus night", "Pre-Rift"), ("Summoner SKIRMISH", "", "Summoner Skirmish"), ("x", "Nexus Night", "Nexus Night"), ("x", None, "Other")],
)
def test_category(spark, name, description, want):
    assert one(spark, text.infer_category(F.lit(name), F.lit(description).cast("string"))) == want


@pytest.mark.parametrize(("cents", "currency", "want"), [(0, "USD", "Free"), (1250, "USD", "$12.50"), (5, "EUR", "€0.05"), (100, "GBP", "£1.00"), (999, "AUD", "9.99")])
def test_price(spark, cents, currency, want):
    assert one(spark, text.format_price(F.lit(cents), F.lit(currency))) == want


@pytest.mark.parametrize(
    ("address", "city", "state", "want"),
    [
        ("x", "Maple Falls", "WA", "Maple Falls"), ("7 Elm Way, Unit 4, Springfield, OH, 45501, US", "OH", "OH", "Springfield"), ("1 Rd, Oslo, 12345 X, NO", None, None, "Oslo"),
        ("a, b, c", "CA", "CA", "CA"), ("1, TX, 78701, US", None, "TX", None),
    ],
)
def test_city(spark, address, city, state, want):
    assert one(spark, text.city_from_address(F.lit(address), F.lit(city).cast("string"), F.lit(state).cast("string"))) == want


def test_small_text_rules(spark):
    assert one(spark, text.is_non_us(F.lit("Kyiv, Ukraine"))) is False
    assert one(spark, text.is_non_us(F.lit("London UK"))) is True
    assert one(spark, text.contains_text(F.lit("100% fun"), "0% F")) is True
    assert one(spark, text.contains_text(F.lit("100 fun"), "0% F")) is False
    assert one(spark, text.contains_text(F.lit("100 fun"), "0%f", wildcards=True)) is True
    assert one(spark, text.display_name(F.lit("A"), F.lit("A"), F.lit(""), F.lit("B"))) == "A, B"
    lines = one(spark, text.buylist_lines(F.lit("Deck:\n4x Card A\n\n 2 Card B \nMainDeck\nLone")))
    assert [(r.quantity, r.card) for r in lines] == [(4, "Card A"), (2, "Card B"), (1, "Lone")]
    assert one(spark, text.metric_type(text.metric_line(F.lit("cache_hit"), "query", F.lit("q"), F.lit(True)))) == "cache_hit"
    assert one(spark, weblog.browser(F.lit("x Chrome Edg"), "A")) == "Chrome"
    assert one(spark, weblog.browser(F.lit("x Chrome Edg"))) == "Edge"
    assert one(spark, weblog.visitor_id(F.lit("a; mid=ab-1;"), F.lit("ip"))) == "ab-1"
    assert one(spark, weblog.visitor_id(F.lit("-"), F.lit("ip"))) == "ip"
    assert one(spark, temporal.percent_truncated(F.lit(2), F.lit(3))) == 66.6
    assert one(spark, temporal.percent_truncated(F.lit(2), F.lit(0))) is None


def test_query_parameters():
    with pytest.raises(ValueError):
        EventQuery(lat=float("nan"))
    assert EventQuery(page=0).window == (20, 0)
    assert EventQuery(calendar_mode=True, page=9).window == (1000, 0)
