"""Spatial joins over grids of cells: radius joins by covers of mixed levels, nearest places, a clustered layout."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.functions import geo

#: The finest grid, of cells of 76 m, and the most places that a cell should hold.
FINEST, CELL_PLACES = 9, 64
#: The grids of a cover, of 1250, 78, 4.9 and 0.08 km; those up to BROADCAST_LEVEL have 2 * 16**4 cells at most, few enough to broadcast.
COVER_LEVELS, BROADCAST_LEVEL = (2, 4, 6, FINEST), 4
#: The grid whose cells are the folders of a clustered table: 16 bands of latitude, 32 of longitude.
FOLDER_LEVEL = 2


def _grid(lat: Column, lng: Column, level: int, name: str) -> list[Column]:
    """The cell of a point on a grid of 4**level bands of latitude and twice as many of longitude: ``<name>y, <name>x``."""
    down = 4**level
    y = F.greatest(F.lit(0), F.least(F.floor((lat + 90) / 180 * down), F.lit(down - 1)))
    return [y.alias(f"{name}y"), F.pmod(F.floor((lng + 180) / 180 * down), F.lit(2 * down)).alias(f"{name}x")]


def _ancestors(cells: DataFrame, name: str, levels: int) -> DataFrame:
    """The cells ``levels`` grids up that hold one of ``cells``; the shuffle behind ``cells`` serves all grids."""
    return cells.select(*(F.floor(F.col(c) / 4**levels).alias(c) for c in (f"{name}y", f"{name}x"))).distinct()


def _middle_and_reach(name: str, level: int) -> tuple[Column, Column, Column]:
    """Latitude and longitude of a cell's middle, and the farthest that a point of the cell is from it, in km."""
    size = 180 / 4**level
    lat, lng = (F.col(f"{name}y") + 0.5) * size - 90, (F.col(f"{name}x") + 0.5) * size - 180
    return lat, lng, _reach(lat, size)


def _reach(lat: Column, size: float) -> Column:
    """The farthest, in km, that a point of a cell of ``size`` degrees is from its middle at latitude ``lat``."""
    half = math.radians(size / 2)
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(lat) - size / 2)))
    chord = F.sqrt(half * half * (1 + F.cos(F.radians(lat)) * widest)) / 2
    return 2 * geo.EARTH_KM * F.asin(F.least(F.lit(1.0), chord)) * 1.001 + 1e-6


def _up(level: Column) -> Column:
    """Cells of the finest grid along a side of a cell of ``level``."""
    return F.pow(F.lit(4.0), FINEST - level)


def _cells(spots: DataFrame) -> DataFrame:
    """Full cells of the grids of a cover: ``level, qy, qx, leaf``; a leaf holds few spots, or is of the finest grid."""
    finest = spots.select(*_grid(F.col("latitude"), F.col("longitude"), FINEST, "q"))
    each = finest.groupBy("qy", "qx").agg(F.count(F.lit(1)).alias("_n")).select("_n", F.explode(F.array(*map(F.lit, COVER_LEVELS))).alias("level"), "qy", "qx")
    up = _up(F.col("level"))
    counts = each.groupBy("level", F.floor(F.col("qy") / up).alias("qy"), F.floor(F.col("qx") / up).alias("qx")).agg(F.sum("_n").alias("_n"))
    return counts.select("level", "qy", "qx", ((F.col("_n") <= CELL_PLACES) | (F.col("level") == FINEST)).alias("leaf"))


def _reach_text(lat: str, size: float) -> str:
    """:func:`_reach` as SQL text."""
    half = math.radians(size / 2)
    widest = f"cos(radians(greatest(0D, abs({lat}) - {size / 2}D)))"
    chord = f"sqrt({half * half!r}D * (1 + cos(radians({lat})) * {widest})) / 2"
    return f"(2 * {geo.EARTH_KM}D * asin(least(1D, {chord})) * 1.001D + 1e-6D)"


def _can_reach(y: str, x: str, level: int) -> str:
    """SQL text: the circle (lat, lng, radius_km) can reach the cell."""
    size = 180 / 4**level
    mid_lat, mid_lng = f"(({y} + 0.5D) * {size!r}D - 90)", f"(({x} + 0.5D) * {size!r}D - 180)"
    return f"{geo.haversine_text('lat', 'lng', mid_lat, mid_lng)} - {_reach_text(mid_lat, size)} <= radius_km"


def _reached(level: int) -> Column:
    """The cells of a coarse grid that the circle (lat, lng, radius_km) can reach, as an array of ``y * cells across + x``."""
    across = 2 * 4**level
    return F.expr(f"filter(sequence(0, {across * 4**level - 1}), c -> {_can_reach(f'floor(c / {across})', f'pmod(c, {across})', level)})")


def radius_pairs(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of ``points`` (point_id, lat, lng, radius_km) and ``rows`` (row_id, latitude, longitude) within each point's radius: ids and ``distance_km``.

    Rows lie in a tree of grid cells, split where they are dense, so that a leaf holds few spots. A circle is covered
    from the coarsest grid down: a cell stays if the circle can reach it, and gives way to the full cells inside it
    unless it is a leaf. So a cover has cells of mixed levels, only full ones, any number of them, and distances on
    the sphere hold across the antimeridian and at the poles. Equal coordinates of either side count as one spot
    until the end. Points and rows without coordinates, and null or negative radii, give no pairs.
    """
    located = rows.where("latitude is not null and longitude is not null").select("row_id", "latitude", "longitude")
    spots = located.select("latitude", "longitude").distinct()
    asked = points.where("lat is not null and lng is not null and radius_km >= 0").select("point_id", "lat", "lng", "radius_km")
    circles = asked.select("lat", "lng", "radius_km").distinct()
    cells = _cells(spots)
    across = 2 * 4 ** COVER_LEVELS[0]
    top = circles.withColumn("_c", F.explode(_reached(COVER_LEVELS[0])))
    open_ = top.select("lat", "lng", "radius_km", F.floor(F.col("_c") / across).alias("_qy"), F.pmod("_c", F.lit(across)).alias("_qx"))
    covers, above = [], COVER_LEVELS[0]
    for level in COVER_LEVELS:
        own = cells.where(F.col("level") == level).select("qy", "qx", "leaf", *(F.floor(F.col(c) / 4 ** (level - above)).alias(f"_{c}") for c in ("qy", "qx")))
        met = open_.join(F.broadcast(own) if level <= BROADCAST_LEVEL else own, ["_qy", "_qx"])
        if level > COVER_LEVELS[0]:
            met = met.where(_can_reach("qy", "qx", level))
        covers.append(met.where("leaf").select("lat", "lng", "radius_km", F.lit(level).alias("level"), "qy", "qx"))
        open_ = met.where("not leaf").select("lat", "lng", "radius_km", F.col("qy").alias("_qy"), F.col("qx").alias("_qx"))
        above = level
    cover = reduce(DataFrame.unionByName, covers)
    finest = spots.select("latitude", "longitude", *_grid(F.col("latitude"), F.col("longitude"), FINEST, "f"))
    levels = finest.withColumn("level", F.explode(F.array(*map(F.lit, COVER_LEVELS))))
    held = levels.select("latitude", "longitude", "level", *(F.floor(F.col(f"f{c}") / _up(F.col("level"))).alias(f"q{c}") for c in "yx"))
    placed = held.join(cells.where("leaf").select("level", "qy", "qx"), ["level", "qy", "qx"])
    km = F.expr(geo.haversine_text("lat", "lng", "latitude", "longitude"))
    found = cover.join(placed, ["level", "qy", "qx"]).withColumn("distance_km", km).where(F.col("distance_km") <= F.col("radius_km"))
    told = found.select("lat", "lng", "radius_km", "latitude", "longitude", "distance_km")
    return told.join(asked, ["lat", "lng", "radius_km"]).join(located, ["latitude", "longitude"]).select("point_id", "row_id", "distance_km")


def within_radius(points: DataFrame, rows: DataFrame, radius_km: float) -> DataFrame:
    """:func:`radius_pairs` with one radius for all points."""
    return radius_pairs(points.withColumn("radius_km", F.lit(float(radius_km))), rows)


def folder_cell(lat: Column, lng: Column) -> Column:
    """The folder of a place in a clustered table; null without coordinates."""
    y, x = _grid(lat, lng, FOLDER_LEVEL, "")
    return F.when(lat.isNotNull() & lng.isNotNull(), (y * 2 * 4**FOLDER_LEVEL + x)).cast("int")


def write_clustered(rows: DataFrame, path: str, lat: str = "latitude", lng: str = "longitude", order: str = "start_date") -> None:
    """Write ``rows`` clustered by place and time: a folder ``cell=`` for each coarse cell, inside it files in ``order``.

    Files of a cell are cut along ``order`` by adaptive rebalancing of the range partitions, so their statistics skip
    times as folders skip places.
    """
    celled = rows.withColumn("cell", folder_cell(F.col(lat), F.col(lng)))
    celled.repartitionByRange("cell", order).sortWithinPartitions("cell", order).write.mode("overwrite").partitionBy("cell").parquet(path)


def clustered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A clustered table; ``schema`` without ``cell``, which it adds."""
    return spark.read.schema(f"{schema}, cell int").parquet(path)


def clustered_near(table: DataFrame, points: DataFrame, start: str, end: str, time: str = "start_date") -> DataFrame:
    """Pairs of ``points`` (point_id, lat, lng, radius_km) and rows of a clustered ``table`` within radius and times: the table's columns, ``point_id, distance_km``.

    The points' cells prune the table's folders at run time, the times its files by their statistics; other folders
    are never opened.
    """
    asked = points.where("lat is not null and lng is not null and radius_km >= 0").withColumn("cell", F.explode(_reached(FOLDER_LEVEL)))
    inside = table.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    met = inside.join(asked.select("point_id", "lat", "lng", "radius_km", "cell"), "cell")
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    return met.withColumn("distance_km", km).where(F.col("distance_km") <= F.col("radius_km")).select(*[c for c in table.columns if c != "cell"], "point_id", "distance_km")


def _near_cells(asked: DataFrame, full: DataFrame, level: int) -> DataFrame:
    """For each cell of points (py, px) the cells of places (qy, qx) that can hold a nearest place of one of its points.

    Pairs of cells are refined from the coarsest grid to that of ``level``: each pair's cells give way to those inside
    them, and a pair goes when another pair of its point cell is nearer at its farthest than it at its nearest. A
    few dozen pairs a point cell stay, however many cells are full.
    """
    pairs = None
    for at in range(1, level + 1):
        p, q = _ancestors(asked, "p", level - at), _ancestors(full, "q", level - at)
        if pairs is None:  # at most 32 cells on either side
            met = p.withColumn("_top", F.lit(0)).join(q.withColumn("_top", F.lit(0)), "_top").drop("_top")
        else:
            up = lambda c: F.floor(F.col(c) / 4)
            above = pairs.select(*(F.col(c).alias(f"_{c}") for c in pairs.columns))
            met = above.join(p.select("py", "px", up("py").alias("_py"), up("px").alias("_px")), ["_py", "_px"])
            met = met.join(q.select("qy", "qx", up("qy").alias("_qy"), up("qx").alias("_qx")), ["_qy", "_qx"])
        (lat, lng, reach), (q_lat, q_lng, q_reach) = _middle_and_reach("p", at), _middle_and_reach("q", at)
        told = met.select("py", "px", "qy", "qx", geo.haversine_km(lat, lng, q_lat, q_lng).alias("_km"), (reach + q_reach).alias("_reach"))
        told = told.withColumn("_most", F.min(F.col("_km") + F.col("_reach")).over(Window.partitionBy("py", "px")))
        pairs = told.where(F.col("_km") - F.col("_reach") <= F.col("_most")).select("py", "px", "qy", "qx")
    return pairs


def _level_for(located: DataFrame) -> int:
    """The coarsest grid whose cells hold CELL_PLACES places at most, or else the finest, of cells of 76 m."""
    finest = located.select(*_grid(F.col("latitude"), F.col("longitude"), FINEST, "q"))
    each = finest.select(F.explode(F.sequence(F.lit(1), F.lit(FINEST))).alias("level"), "qy", "qx")
    up = F.pow(F.lit(4.0), FINEST - F.col("level"))
    counts = each.groupBy("level", F.floor(F.col("qy") / up).alias("qy"), F.floor(F.col("qx") / up).alias("qx")).agg(F.count(F.lit(1)).alias("_n"))
    fits = counts.groupBy("level").agg(F.max("_n").alias("_n")).where(F.col("_n") <= CELL_PLACES).agg(F.min("level")).first()[0]
    return FINEST if fits is None else fits


def nearest_place(points: DataFrame, places: DataFrame, level: int | None = None) -> DataFrame:
    """The nearest of ``places`` (row_id, latitude, longitude) for each point (point_id, lat, lng), ties to the smaller id.

    Points and places count once for each pair of coordinates. Both fall into the cells of a grid of ``level``, by
    default the coarsest whose cells hold few places; cells of points meet only the cells that can hold a nearest
    place, and points only the places of those. A cell or spot with many points meets few rows, so adaptive execution
    broadcasts these or splits its points. Points and places without coordinates are left out.
    """
    located = places.where("latitude is not null and longitude is not null").groupBy("latitude", "longitude").agg(F.min("row_id").alias("row_id"))
    if level is None:
        level = _level_for(located)
    placed = located.select("row_id", "latitude", "longitude", *_grid(F.col("latitude"), F.col("longitude"), level, "q"))
    asked = points.where("lat is not null and lng is not null").select("point_id", "lat", "lng")
    spots = asked.select("lat", "lng").distinct().select("lat", "lng", *_grid(F.col("lat"), F.col("lng"), level, "p"))
    near = _near_cells(spots.select("py", "px").distinct(), placed.select("qy", "qx").distinct(), level)
    choice = near.join(placed, ["qy", "qx"]).select("py", "px", "row_id", "latitude", "longitude")

    pairs = spots.join(choice, ["py", "px"])
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    best = pairs.groupBy("lat", "lng").agg(F.min(F.struct(km.alias("distance_km"), "row_id")).alias("_best"))
    told = asked.join(best, ["lat", "lng"])
    return told.select("point_id", F.col("_best.row_id").alias("row_id"), F.col("_best.distance_km").alias("distance_km"))
