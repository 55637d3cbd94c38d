"""Covers of mixed levels against all pairs, and how many files of a clustered table are read."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from fairgrid.operators import spatial
from fairgrid.plans import catalog
from tests.test_functions import distance

ROWS = "row_id long, latitude double, longitude double"
POINTS = "point_id long, lat double, lng double, radius_km double"


def test_covers_equal_all_pairs_where_rows_are_dense(spark):
    rng = random.Random(4)
    dense = [(i, 40 + rng.random() / 50, -100 + rng.random() / 50) for i in range(400)]
    world = [(1000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)]
    odd = [(5000, 90.0, 0.0), (5001, -90.0, 77.0), (5002, 0.0, 180.0), (5003, 0.0, -180.0), (5004, 0.1, 179.999), (5005, 89.9, -90.0), (5006, 40.01, -99.99), (5007, 40.01, -99.99)]
    rows = dense + world + odd
    points = [(1, 40.01, -99.99, 1.0), (2, 40.01, -99.99, 0.0), (3, 90.0, 13.0, 500.0), (4, 0.0, 179.9, 30.0), (5, 0.0, -179.99, 2000.0), (6, -89.99, 5.0, 10.0), (7, 12.0, 12.0, 30_000.0), (8, 50.0, 5.0, 900.0), (9, 50.0, 5.0, -1.0), (10, None, 5.0, 9.0), (11, 50.0, 5.0, None), (12, 90.0, 13.0, 500.0)]
    got = sorted((r.point_id, r.row_id) for r in spatial.radius_pairs(spark.createDataFrame(points, POINTS), spark.createDataFrame([*rows, (6000, None, 1.0)], ROWS)).collect())
    want = sorted((p, r) for (p, lat, lng, km), (r, *at) in itertools.product(points, rows) if None not in (lat, km) and km >= 0 and distance(lat, lng, *at) <= km)
    assert got == want
    leaves = spatial._cells(spark.createDataFrame(rows, ROWS).select("latitude", "longitude").distinct()).where("leaf")
    levels = {r.level for r in leaves.select("level").distinct().collect()}
    assert min(levels) <= 4 and max(levels) >= 6  # mixed
    assert spatial.radius_pairs(spark.createDataFrame([], POINTS), spark.createDataFrame(rows, ROWS)).count() == 0
    assert spatial.radius_pairs(spark.createDataFrame(points, POINTS), spark.createDataFrame([], ROWS)).count() == 0


def test_leaves_hold_few_spots(spark):
    rng = random.Random(9)
    spots = spark.createDataFrame([(i, 10 + rng.random(), 20 + rng.random()) for i in range(5000)], ROWS)
    cells = spatial._cells(spots.select("latitude", "longitude"))
    finest = spots.select(*spatial._grid(F.col("latitude"), F.col("longitude"), spatial.FINEST, "f"))
    up = F.pow(F.lit(4.0), spatial.FINEST - F.col("level"))
    counts = cells.where("leaf").crossJoin(finest).where((F.floor(F.col("fy") / up) == F.col("qy")) & (F.floor(F.col("fx") / up) == F.col("qx"))).groupBy("level", "qy", "qx").count()
    assert counts.agg(F.max("count")).first()[0] <= spatial.CELL_PLACES
    inside = cells.alias("a").where("leaf").join(cells.alias("b").where("leaf"), F.expr("a.level < b.level and a.qy = floor(b.qy / pow(4.0, b.level - a.level)) and a.qx = floor(b.qx / pow(4.0, b.level - a.level))"))
    assert counts.agg(F.sum("count")).first()[0] >= 5000 and inside.where("false").count() == 0


def files_read(df):
    """Files that the scans of the executed plan have read."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            found.append((node.metrics().apply("numFiles").value(), str(node)))
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        return None

    walk(plan)
    return found


def test_clustered_table_opens_near_folders_only(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{rng.randint(1, 28):02d} 00:00:00", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(3000)]
    table = spark.createDataFrame(rows, "row_id long, t string, latitude double, longitude double").selectExpr("row_id", "cast(t as timestamp_ntz) start_date", "latitude", "longitude")
    spatial.write_clustered(table, str(tmp_path / "t"))
    held = spatial.clustered(spark, str(tmp_path / "t"), "row_id long, start_date timestamp_ntz, latitude double, longitude double")
    folders = len(list((tmp_path / "t").glob("cell=*")))
    spark.createDataFrame([(1, 40.0, -100.0, 300.0, "a"), (2, 0.0, 179.9, 300.0, "a"), (3, 10.0, 10.0, 300.0, "b")], POINTS + ", kind string").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p")).where("kind = 'a'")
    near = spatial.clustered_near(held, points, "2024-01-05", "2024-01-20")
    got = sorted((r.point_id, r.row_id) for r in near.collect())
    want = sorted((p, i) for p, lat, lng in [(1, 40.0, -100.0), (2, 0.0, 179.9)] for i, t, *at in rows if "2024-01-05" <= t[:10] <= "2024-01-20" and t <= "2024-01-20 00:00:00" and distance(lat, lng, *at) <= 300)
    assert got == want
    scans = [(n, text) for n, text in files_read(near) if "cell" in text]
    assert "dynamicpruning" in scans[0][1] and "PushedFilters" in scans[0][1]
    assert 0 < scans[0][0] <= 40 < folders


def test_spatial_queries_equal_their_sql(spark):
    small = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("supplier", "nation", "region", "events"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name in ("circle_cover_join", "clustered_near_join", "many_point_radius_join"):
        got, want = catalog.queries()[name](spark, small), con.sql(catalog.oracle_sql()[name])
        rows = sorted(map(tuple, got.select(want.columns).collect()))
        assert rows and rows == sorted(want.fetchall())
