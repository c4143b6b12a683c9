"""Scenes: a local frame around an anchor, points and paths in it, and regions of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps
from geoloom.operators import geometry, trajectory

# Named test regions (longitude, latitude).
REGIONS = {
    "muc-sued-4x2": "POLYGON((11.530 48.117, 11.585 48.117, 11.585 48.135, 11.530 48.135, 11.530 48.117))",
    "muc-marienplatz-50m": "POLYGON((11.5750 48.1370, 11.5760 48.1370, 11.5760 48.1378, 11.5750 48.1378, 11.5750 48.1370))",
    "muc-sued-10x4": "POLYGON((11.450 48.080, 11.585 48.080, 11.585 48.118, 11.450 48.118, 11.450 48.080))",
    "allgaeu-forggensee": "POLYGON((10.7725730737063 47.55479949436138, 10.83963591262588 47.6342185213709, 10.78083675631973 47.64802419330076, "
                          "10.71481653953351 47.57153264515765, 10.75609510295647 47.5653219635225, 10.7725730737063 47.55479949436138))",
}
# Altitudes (m) and weights between which the drape weight falls.
DRAPE = ((100.0, 0.6), (1000.0, 0.15))
# The path of an S through a box has so many points, at this height, and swings so far from its middle.
S_POINTS, S_HEIGHT, S_SWING = 30, 1500.0, 0.4
#: Parts of a grid cell's points, and tasks that all points are dealt to, for each core, before they are compared with blocks.
SPREAD, PER_CORE = 8, 4


def regions(spark: SparkSession) -> DataFrame:
    """name and ring of the named regions."""
    rows = spark.createDataFrame(list(REGIONS.items()), "name string, wkt string")
    return rows.select("name", geometry.ring_from_wkt(F.col("wkt")).alias("ring"))


def anchor_of(points: DataFrame, *by: str) -> DataFrame:
    """The mean position of points (x, y), of each value of `by`."""
    return points.groupBy(*by).agg(F.avg("x").alias("anchor_x"), F.avg("y").alias("anchor_y"))


def to_local(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """df (with anchor_x, anchor_y) with east, north and up of single precision around the anchor."""
    return df.withColumns({"east": (F.col(x) - F.col("anchor_x")).cast("float"), "north": (F.col(y) - F.col("anchor_y")).cast("float"), "up": F.col(z).cast("float")})


def from_local(df: DataFrame) -> DataFrame:
    """df (anchor_x, anchor_y, east, north, up) with x, y and z as doubles."""
    return df.withColumns({"x": F.col("anchor_x") + F.col("east"), "y": F.col("anchor_y") + F.col("north"), "z": F.col("up").cast("double")})


def local_to_geo(df: DataFrame, epsg: int = 25832) -> DataFrame:
    """df with lat and lon of its local positions."""
    return geodesy.with_geographic(from_local(df), epsg)


def named_frames(poses: DataFrame, tag: str, kept: Column | None = None, key: str = "id") -> DataFrame:
    """poses with a name: the tag and the frame's place in its track; frames that are not kept leave their numbers unused."""
    rows = trajectory.placed(poses.withColumn("__kept", F.lit(True) if kept is None else kept), "t", key)
    named = rows.withColumn("name", F.concat(F.lit(f"{tag}_"), F.col("place").cast("string"))).withColumn("tag", F.lit(tag)).drop("place")
    return named.filter("__kept").drop("__kept")


def drape_weight(altitude: Column) -> Column:
    (low, a), (high, b) = DRAPE
    return F.when(altitude <= low, a).when(altitude >= high, b).otherwise(a + (altitude - low) / (high - low) * (b - a))


def s_path(boxes: DataFrame, epsg: int = 25832) -> DataFrame:
    """i, x, y, alt, lat and lon of an S from west to east through each box (min_x, min_y, max_x, max_y)."""
    part = F.col("i") / F.lit(float(S_POINTS - 1))
    rows = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(S_POINTS - 1))))
    rows = rows.withColumns({
        "x": F.col("min_x") + (F.col("max_x") - F.col("min_x")) * part,
        "y": F.col("min_y") + (F.col("max_y") - F.col("min_y")) * (0.5 + S_SWING * F.sin(part * (2 * math.pi))), "alt": F.lit(S_HEIGHT)})
    return geodesy.with_geographic(rows, epsg)


def box_facts(df: DataFrame) -> DataFrame:
    """Boxes with width, height and centre."""
    return df.withColumns({"width": F.col("max_x") - F.col("min_x"), "height": F.col("max_y") - F.col("min_y"),
                           "centre_x": (F.col("min_x") + F.col("max_x")) / 2, "centre_y": (F.col("min_y") + F.col("max_y")) / 2})


def box_around(df: DataFrame, half: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"min_x": F.col(x) - half, "min_y": F.col(y) - half, "max_x": F.col(x) + half, "max_y": F.col(y) + half})


def corners(df: DataFrame) -> DataFrame:
    """Four rows per box, with x and y of a corner."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.select("*", F.inline(F.array(at("min_x", "min_y"), at("max_x", "min_y"), at("min_x", "max_y"), at("max_x", "max_y"))))


def geo_envelope(boxes: DataFrame, key: str, epsg: int = 25832, margin: float = 1e-5) -> DataFrame:
    """Per box the degrees that its four corners span, and a margin."""
    at = geodesy.with_geographic(corners(boxes), epsg)
    return at.groupBy(key).agg((F.min("lon") - margin).alias("min_lon"), (F.min("lat") - margin).alias("min_lat"), (F.max("lon") + margin).alias("max_lon"), (F.max("lat") + margin).alias("max_lat"))


def box_union(boxes: DataFrame, epsg: int, others: list[int]) -> DataFrame:
    """One box around all boxes (with a column epsg), in one system; a null system counts as it.

    n_moved boxes came from another system, n_unnamed had none. Systems that are not in `others` give null corners.
    """
    at = corners(boxes).select("epsg", "x", "y")
    same = at.filter(F.col("epsg").isNull() | ~F.col("epsg").isin(*others))
    same = same.select("epsg", *(F.when(F.coalesce("epsg", F.lit(epsg)) == epsg, F.col(c)).alias(c) for c in "xy"))
    for code in others:
        there = geodesy.with_geographic(at.filter(F.col("epsg") == code), code).select("epsg", "lat", "lon")
        same = same.unionByName(geodesy.with_projected(there, epsg).select("epsg", "x", "y"))
    # Four rows per box.
    moved, unnamed = F.count_if(F.col("epsg") != epsg) / 4, F.count_if(F.col("epsg").isNull()) / 4
    return same.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), moved.cast("long").alias("n_moved"), unnamed.cast("long").alias("n_unnamed"))


def blocks_in_cells(blocks: DataFrame, cell: float) -> DataFrame:
    """The blocks (rank, name, ring and its bounds) that may be the first one of a point in each grid cell (__cx, __cy).

    Of a cell's blocks those behind the first one that covers the whole cell hold none of its points first, and are left out.
    """
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    dealt = blocks.withColumn("__cx", F.explode(F.sequence(F.floor(low("x") / cell), F.floor(high("x") / cell))))
    dealt = dealt.withColumn("__cy", F.explode(F.sequence(F.floor(low("y") / cell), F.floor(high("y") / cell))))
    dealt = dealt.select("__cx", "__cy", "rank", "name", "ring", *(f(c).alias(f"__{n}{c}") for n, f in (("low", low), ("high", high)) for c in "xy"))
    # Dealt to all cores with rings that are made; the two readers below share it.
    dealt = dealt.repartition(PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism)
    # A block covers a cell if none of its edges comes near the cell and the cell's middle is inside.
    side = lambda c, i, sign: (F.col(c) + i) * cell + sign * cell * 1e-6
    beside = lambda c, p, q: (F.greatest(p, q) < side(c, 0, -1)) | (F.least(p, q) > side(c, 1, 1))
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    clear = F.forall(F.zip_with("ring", after, lambda p, q: beside("__cx", p["x"], q["x"]) | beside("__cy", p["y"], q["y"])), lambda c: c)
    whole = dealt.filter(clear & geometry.polygon_contains(F.col("ring"), (F.col("__cx") + 0.5) * cell, (F.col("__cy") + 0.5) * cell))
    covered = whole.groupBy("__cx", "__cy").agg(F.min("rank").alias("__first"))
    return dealt.join(covered, ["__cx", "__cy"], "left").filter(F.col("__first").isNull() | (F.col("rank") <= F.col("__first"))).drop("__first")


def blocks_of_points(points: DataFrame, blocks: DataFrame, cell: float) -> DataFrame:
    """points with the name of the first block (by `rank`) whose ring holds them, null where none does.

    Points and blocks meet in grid cells, so every block is compared with near points only. A cell's points are in SPREAD parts.
    """
    near = blocks_in_cells(blocks, cell).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    meet = ["__cx", "__cy", "__part"]
    at = points.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell), "__part": F.pmod(F.hash("id", "x", "y"), F.lit(SPREAD))})
    # Points are little to read and much to compare: they are dealt to all cores, however small they are.
    at = at.repartition(PER_CORE * points.sparkSession.sparkContext.defaultParallelism, *meet)
    inside = F.col("x").between(F.col("__lowx"), F.col("__highx")) & F.col("y").between(F.col("__lowy"), F.col("__highy"))
    met = at.join(near, meet).filter(inside & geometry.polygon_contains(F.col("ring"), F.col("x"), F.col("y")))
    first = met.groupBy("id").agg(F.min_by("name", "rank").alias("name"))
    return points.join(first, "id", "left")


def placemarks(texts: DataFrame, epsg: int = 25832, column: str = "value", id_col: str | None = None) -> DataFrame:
    """name and ring (in the given system) of a KML's placemarks that have a name and three points or more.

    rank is the placemark's place in its text. id_col names the texts, and is returned, too; without it
    every row is a text of its own.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")
    own = F.col(id_col) if id_col else F.monotonically_increasing_id()
    found = F.regexp_extract_all(plain, F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))
    name = F.trim(F.xpath_string("mark", F.lit("//name")))
    points = F.filter(F.split(F.trim(F.xpath_string("mark", F.lit("//coordinates"))), r"\s+"), lambda p: F.size(F.split(p, ",")) >= 2)
    rows = texts.select(own.alias("__text"), F.posexplode(found).alias("rank", "mark")).select("__text", "rank", name.alias("name"), F.posexplode(points).alias("i", "p")).filter("name <> ''")
    rows = rows.select("__text", "rank", "name", "i", F.split("p", ",")[0].try_cast("double").alias("lon"), F.split("p", ",")[1].try_cast("double").alias("lat"))
    at = steps.apply(rows, geodesy.from_geo(epsg, "lat", "lon", "x", "y"))
    # The points of one placemark's ring: bounded by the placemark's text.
    rings = at.groupBy("__text", "rank", "name").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r")).filter(F.size("r") >= 3)
    ring = geometry.open_ring(F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("ring")
    return rings.select(*([F.col("__text").alias(id_col)] if id_col else []), "rank", "name", ring)
