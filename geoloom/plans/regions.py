"""Queries over tiled elevation, scenes, boxes, mesh archives and the portals' pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import addresses, geodesy, steps
from geoloom.operators import archive, catalog, geometry, jsoncoords, raster, scene, trajectory
from geoloom.operators.raster import Grid
from geoloom.plans.points import POINTS, points, table
from geoloom.plans.terrain import track
from geoloom.sources import formats

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- elevation over many tiles: 10,000 orders fill a tile of 1 km with cells of 10 m

TILE_CELLS = """(SELECT (500 + o_orderkey // 10000 % 10)::INT AS e, (5400 + o_orderkey // 100000)::INT AS n, o_orderkey % 10000 // 100 AS r, o_orderkey % 100 AS c,
 max(CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey * 7919 % 1000) * 0.1e0 END) AS v FROM orders GROUP BY 1, 2, 3, 4)"""


def tile_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "CAST(500 + o_orderkey div 10000 % 10 AS INT) AS east_km", "CAST(5400 + o_orderkey div 100000 AS INT) AS north_km", "o_orderkey % 10000 div 100 AS row", "o_orderkey % 100 AS col",
        "CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey * 7919 % 1000) * 0.1e0 END AS value")
    return o.groupBy("east_km", "north_km", "row", "col").agg(F.max("value").alias("value"))


def _tiled_sql(source: str) -> str:
    """id and value of the source's points (id, x, y)."""
    same = "{0}.e = k.e AND {0}.n = k.n AND {0}.r = k.{1} AND {0}.c = k.{2}"
    joins = " ".join(f"LEFT JOIN c AS {a} ON {same.format(a, r, c)}" for a, r, c in (("ca", "r0", "c0"), ("cb", "r0", "c1"), ("cd", "r1", "c0"), ("ce", "r1", "c1"), ("cn", "rn", "cn")))
    return f"""WITH c AS (SELECT * FROM {TILE_CELLS} AS c0), p AS (SELECT *, floor(x / 1000)::INT AS e, floor(y / 1000)::INT AS n FROM {source} AS p0),
f AS (SELECT id, e, n, least(greatest((1000e0 - (y - n * 1000e0)) / 10 - 0.5e0, 0), 99) AS fr, least(greatest((x - e * 1000e0) / 10 - 0.5e0, 0), 99) AS fc FROM p),
k AS (SELECT *, floor(fr)::BIGINT AS r0, floor(fc)::BIGINT AS c0, least(floor(fr)::BIGINT + 1, 99) AS r1, least(floor(fc)::BIGINT + 1, 99) AS c1, round_even(fr, 0)::BIGINT AS rn, round_even(fc, 0)::BIGINT AS cn FROM f)
SELECT k.id, k.e AS east_km, k.n AS north_km, round(CASE WHEN ca.v IS NOT NULL AND cb.v IS NOT NULL AND cd.v IS NOT NULL AND ce.v IS NOT NULL
 THEN ca.v * (1 - (fr - r0)) * (1 - (fc - c0)) + cb.v * (1 - (fr - r0)) * (fc - c0) + cd.v * (fr - r0) * (1 - (fc - c0)) + ce.v * (fr - r0) * (fc - c0) ELSE cn.v END, 6) AS value FROM k {joins}"""


# Ids that repeat: ten rows each.
_ASKED = "(SELECT c_custkey // 10 AS id, 500000e0 + (c_custkey * 37 % 30000) * 0.1e0 AS x, 5400000e0 + (c_custkey * 53 % 9000) * 0.1e0 AS y FROM customer)"


@query("elevation_tiled", _tiled_sql(_ASKED))
def elevation_tiled(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey div 10 AS id", "500000e0 + (c_custkey * 37 % 30000) * 0.1e0 AS x", "5400000e0 + (c_custkey * 53 % 9000) * 0.1e0 AS y")
    return raster.tiled(asked, tile_cells(spark, sf_dir), 1, 10.0).select("id", "east_km", "north_km", F.round("value", 6).alias("value"))


_SPOTS = "(SELECT i AS id, 500400e0 + (i % 160 + 0.5e0) * 7.5e0 AS x, 5400900e0 - (i // 160 + 0.5e0) * 7.5e0 AS y FROM range(16000) AS t(i))"


@query("elevation_mosaic", f"SELECT id // 160 AS row, id % 160 AS col, value FROM ({_tiled_sql(_SPOTS)}) AS m")
def elevation_mosaic(spark, sf_dir):
    """One raster out of several tiles, at another pixel size."""
    target = Grid(160, 100, 500_400.0, 5_400_900.0, 7.5)
    return raster.mosaic(tile_cells(spark, sf_dir), 1, 10.0, target).select("row", "col", F.round("value", 6).alias("value"))


@query("elevation_prefer", f"""
WITH c AS (SELECT e, n, count(*) AS cells FROM {TILE_CELLS} AS c0 GROUP BY 1, 2), a AS (SELECT * FROM c WHERE e % 2 = 0)
SELECT e AS east_km, n AS north_km, CASE WHEN e % 2 = 0 THEN cells ELSE -cells END AS cells, (e % 2)::INT AS source FROM c""")
def elevation_prefer(spark, sf_dir):
    """Per tile the first source that has it."""
    cells = tile_cells(spark, sf_dir).groupBy("east_km", "north_km").agg(F.count(F.lit(1)).alias("cells"))
    return catalog.prefer(cells.filter("east_km % 2 = 0"), cells.withColumn("cells", -F.col("cells"))).select("east_km", "north_km", "cells", "source")


# --- tracks and scenes

_TURNS = "(SELECT user_id AS id, epoch(ts) AS t, (event_id * 47 % 170) * 1e0 AS yaw FROM events)"


@query("track_orientation", f"""
WITH t AS (SELECT * FROM {_TURNS} AS t0), e AS (SELECT id, min(t) AS t0, max(t) AS t1 FROM t GROUP BY id),
f AS (SELECT id, t0 + i * 7200e0 AS t FROM e, unnest(range(floor((t1 - t0) / 7200)::BIGINT + 1)) AS r(i)),
a AS (SELECT f.id, f.t, s.t AS ta, s.yaw AS ya FROM f ASOF JOIN t AS s ON f.id = s.id AND f.t >= s.t), b AS (SELECT f.id, f.t, s.t AS tb, s.yaw AS yb FROM f ASOF JOIN t AS s ON f.id = s.id AND f.t <= s.t),
p AS (SELECT id, t, radians(ya + (yb - ya) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END) AS y FROM a JOIN b USING (id, t))
SELECT id, round(t, 3) AS t, round(-sin(y), 5) AS sine, round(cos(y), 5) AS cosine FROM p""")
def track_orientation(spark, sf_dir):
    """Quaternions of frames, on the shorter great arc between two samples."""
    t = track(spark, sf_dir).withColumn("yaw", F.expr("0e0")).drop("yaw")
    yaw = table(spark, sf_dir, "events").selectExpr("user_id AS id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t", "value * 1e0 AS x", "0e0 AS y", "0e0 AS z", "(event_id * 47 % 170) * 1e0 AS yaw", "0e0 AS pitch", "0e0 AS roll")
    yaw = yaw.withColumn("q", trajectory.rotation(F.col("yaw"), F.lit(0.0), F.lit(0.0)))
    q = trajectory.poses_at(yaw, trajectory.frames(t, 7200.0))
    return q.select("id", F.round("t", 3).alias("t"), F.round(F.col("q.z") * F.col("q.w") * 2, 5).alias("sine"), F.round(1 - F.col("q.z") * F.col("q.z") * 2, 5).alias("cosine"))


@query("track_timed_by_row", "SELECT event_id, user_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.5e0 AS t FROM events")
def track_timed_by_row(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS id")
    return trajectory.timed_by_row(rows, "event_id", 0.5).select("event_id", "id", "t")


@query("scene_local", """
WITH t AS (SELECT event_id, user_id AS id, 691000e0 + value AS x, 5334000e0 + event_id % 50 AS y FROM events), a AS (SELECT id, avg(x) AS ax, avg(y) AS ay FROM t GROUP BY id)
SELECT event_id, round((x - ax)::FLOAT::DOUBLE, 3) AS east, round((y - ay)::FLOAT::DOUBLE, 3) AS north, round(ax + (x - ax)::FLOAT, 3) AS x FROM t JOIN a USING (id)""")
def scene_local(spark, sf_dir):
    """Local positions around the mean of each track, and back."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS id", "691000e0 + value AS x", "5334000e0 + event_id % 50 AS y", "0e0 AS z")
    local = scene.to_local(t.join(scene.anchor_of(t, "id"), "id")).drop("x", "y", "z")
    return scene.from_local(local).select("event_id", F.round(F.col("east").cast("double"), 3).alias("east"), F.round(F.col("north").cast("double"), 3).alias("north"), F.round("x", 3).alias("x"))


@query("scene_named_frames", """
SELECT id, 'shot_' || k AS name, t FROM (SELECT user_id AS id, round(epoch(ts), 3) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM events) AS f WHERE value > 50""")
def scene_named_frames(spark, sf_dir):
    """Frames named by their place; those left out leave gaps."""
    named = scene.named_frames(track(spark, sf_dir), "shot", F.col("x") > 50)
    return named.select("id", "name", F.round("t", 3).alias("t"))


@query("scene_drape_weight", """
SELECT s_suppkey AS id, round(CASE WHEN z <= 100 THEN 0.6 WHEN z >= 1000 THEN 0.15 ELSE 0.6e0 + (z - 100) / 900 * -0.45e0 END, 9) AS weight FROM (SELECT s_suppkey, (s_suppkey * 37 % 1300) * 1e0 AS z FROM supplier) AS s""")
def scene_drape_weight(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "(s_suppkey * 37 % 1300) * 1e0 AS z")
    return s.select("id", F.round(scene.drape_weight(F.col("z")), 9).alias("weight"))


def _areas(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "690000e0 + s_suppkey * 137 AS min_x", "5333000e0 + s_suppkey * 91 AS min_y",
                                                       "691000e0 + s_suppkey * 141 AS max_x", "5333500e0 + s_suppkey * 92 AS max_y")


_AREAS = "(SELECT s_suppkey AS id, 690000e0 + s_suppkey * 137 AS min_x, 5333000e0 + s_suppkey * 91 AS min_y, 691000e0 + s_suppkey * 141 AS max_x, 5333500e0 + s_suppkey * 92 AS max_y FROM supplier)"


@query("scene_s_path", f"""
SELECT id, i::INT AS i, round(min_x + (max_x - min_x) * (i / 29e0), 4) AS x, round(min_y + (max_y - min_y) * (0.5e0 + 0.4e0 * sin(i / 29e0 * 2 * pi())), 4) AS y, 1500e0 AS alt FROM {_AREAS} AS a, range(30) AS r(i)""")
def scene_s_path(spark, sf_dir):
    return scene.s_path(_areas(spark, sf_dir)).select("id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "alt")


_REGIONS = "(VALUES ('muc-sued-4x2', 4, 11.53e0, 48.117e0), ('muc-marienplatz-50m', 4, 11.575e0, 48.137e0), ('muc-sued-10x4', 4, 11.45e0, 48.08e0), ('allgaeu-forggensee', 5, 10.71481653953351e0, 47.55479949436138e0)) AS r(name, n, min_lon, min_lat)"


@query("scene_regions", f"""
SELECT name, n, min_lon, min_lat, count(p.id) AS near FROM {_REGIONS} LEFT JOIN {POINTS} ON floor(p.lon * 2) = floor(min_lon * 2) AND floor(p.lat * 2) = floor(min_lat * 2) GROUP BY ALL""")
def scene_regions(spark, sf_dir):
    """The named regions, with the customers in the half degree in which each begins."""
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    found = scene.regions(spark).select("name", F.size("ring").alias("n"), low("x").alias("min_lon"), low("y").alias("min_lat"))
    half = lambda c: F.floor(F.col(c) * 2)
    near = points(spark, sf_dir).groupBy(half("lon").alias("i"), half("lat").alias("j")).agg(F.count(F.lit(1)).alias("near"))
    both = found.withColumns({"i": half("min_lon"), "j": half("min_lat")}).join(near, ["i", "j"], "left")
    return both.select("name", "n", "min_lon", "min_lat", F.coalesce("near", F.lit(0)).alias("near"))


# --- boxes and blocks


@query("box_facts", f"SELECT id, max_x - min_x AS width, max_y - min_y AS height, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y, (min_x + max_x) / 2 - 150 AS around_x, (min_y + max_y) / 2 + 150 AS around_y FROM {_AREAS} AS a")
def box_facts(spark, sf_dir):
    facts = scene.box_facts(_areas(spark, sf_dir)).drop("min_x", "min_y", "max_x", "max_y")
    return scene.box_around(facts, 150.0, "centre_x", "centre_y").select("id", "width", "height", "centre_x", "centre_y", F.col("min_x").alias("around_x"), F.col("max_y").alias("around_y"))


_CORNERS = f"(SELECT a.id, x, y FROM {_AREAS} AS a, unnest([min_x, max_x]) AS u(x), unnest([min_y, max_y]) AS v(y))"


@query("box_geo_envelope", f"""
SELECT id, round(min(lon) - 1e-5, 8) AS min_lon, round(min(lat) - 1e-5, 8) AS min_lat, round(max(lon) + 1e-5, 8) AS max_lon, round(max(lat) + 1e-5, 8) AS max_lat
FROM {steps.as_sql(_CORNERS + ' AS c', geodesy.to_geo(25832, 'x', 'y', 'lat', 'lon'))} GROUP BY id""")
def box_geo_envelope(spark, sf_dir):
    found = scene.geo_envelope(_areas(spark, sf_dir), "id")
    return found.select("id", *(F.round(c, 8).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


_MOVED = steps.as_sql("(SELECT lat, lon FROM " + steps.as_sql(f"(SELECT x, y FROM {_CORNERS} AS c WHERE id % 3 = 1) AS c1", geodesy.to_geo(25833, "x", "y", "lat", "lon")) + ") AS g", geodesy.from_geo(25832, "lat", "lon", "x", "y"))


@query("box_union", f"""
WITH u AS (SELECT x, y FROM {_CORNERS} AS c WHERE id % 3 <> 1 UNION ALL SELECT x, y FROM {_MOVED})
SELECT round(min(x), 3) AS min_x, round(min(y), 3) AS min_y, round(max(x), 3) AS max_x, round(max(y), 3) AS max_y, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS n_moved, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 2) AS n_unnamed FROM u""")
def box_union(spark, sf_dir):
    """The box around boxes of which a third is in another zone and a third names no system."""
    areas = _areas(spark, sf_dir).withColumn("epsg", F.when(F.col("id") % 3 == 0, 25832).when(F.col("id") % 3 == 1, 25833))
    return scene.box_union(areas, 25832, [25833]).select(*(F.round(c, 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")), "n_moved", "n_unnamed")


@query("blocks_of_points", """
WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 10000) + 0.5e0 AS x, (c_custkey * 53 % 7000) + 0.5e0 AS y FROM customer), b AS (SELECT s_suppkey AS rank, (s_suppkey * 331 % 9000) * 1e0 AS x0, (s_suppkey * 173 % 6000) * 1e0 AS y0 FROM supplier)
SELECT p.id, 'block' || min(b.rank) AS name FROM p LEFT JOIN b ON x BETWEEN x0 AND x0 + 900 AND y BETWEEN y0 AND y0 + 700 GROUP BY p.id""")
def blocks_of_points(spark, sf_dir):
    at = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey * 37 % 10000) + 0.5e0 AS x", "(c_custkey * 53 % 7000) + 0.5e0 AS y")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS rank", "concat('block', s_suppkey) AS name", "(s_suppkey * 331 % 9000) * 1e0 AS x0", "(s_suppkey * 173 % 6000) * 1e0 AS y0")
    ring = geometry.ring_from_box(F.col("x0"), F.col("y0"), F.col("x0") + 900.0, F.col("y0") + 700.0)
    return scene.blocks_of_points(at, b.select("rank", "name", ring.alias("ring")), 500.0).select("id", "name")


@query("placemark_rings", "SELECT s_suppkey AS id, 'area ' || s_suppkey AS name, 3 AS n FROM supplier WHERE s_suppkey % 4 > 0")
def placemark_rings(spark, sf_dir):
    """Named polygons out of KML texts; some have no name, some too few points."""
    k = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("<name> area "), k, F.lit(" </name>")))
    more = F.when(F.col("s_suppkey") % 8 == 4, F.lit("")).otherwise(F.lit(" 11.6,48.1,500 11.6,48.2 11.5,48.1"))
    text = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark>'), name, F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>11.5,48.1"), more,
                    F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"))
    marks = scene.placemarks(table(spark, sf_dir, "supplier").select(text.alias("value")))
    return marks.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("id"), "name", F.size("ring").alias("n"))


# --- mesh archives


def _node_pages(spark, sf_dir):
    """Node pages of 64 nodes made from part."""
    node = F.struct(
        F.col("p_partkey").alias("index"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.col("p_partkey") + 1)).alias("children"), (F.col("p_size") * 1.5).alias("lodThreshold"),
        F.struct(F.array(F.col("p_partkey") * 53 % 4000 * 1.0, F.col("p_partkey") * 29 % 3000 * 1.0, F.lit(500.0)).alias("center"), F.array(F.col("p_size") * 1.0, F.col("p_size") * 0.5, F.lit(9.0)).alias("halfSize")).alias("obb"),
        F.when(F.col("p_partkey") % 7 > 0, F.struct(F.struct(F.col("p_partkey").alias("resource"), (F.col("p_size") * 30).alias("vertexCount")).alias("geometry"), F.struct((F.col("p_partkey") % 9).alias("resource")).alias("material"))).alias("mesh"))
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("page"), F.to_json(node).alias("node"))
    return p.groupBy("page").agg(F.concat(F.lit('{"nodes": ['), F.array_join(F.collect_list("node"), ","), F.lit("]}")).alias("value"))


_NODES = """(SELECT p_partkey AS node, p_partkey * 53 % 4000 * 1e0 AS cx, p_partkey * 29 % 3000 * 1e0 AS cy, p_size * 1e0 AS hx, p_size * 0.5e0 AS hy, p_size * 1.5e0 AS lod, p_partkey % 7 > 0 AS has_mesh, p_partkey % 5 = 0 AS has_children,
 CASE WHEN p_partkey % 7 > 0 THEN p_partkey END AS geometry, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 9 END AS material, CASE WHEN p_partkey % 7 > 0 THEN p_size * 30 ELSE 0 END AS vertices FROM part)"""


@query("archive_nodes", f"SELECT * FROM {_NODES} AS n")
def archive_nodes(spark, sf_dir):
    return archive.node_table(_node_pages(spark, sf_dir)).select("node", "cx", "cy", "hx", "hy", "lod", "has_mesh", "has_children", "geometry", "material", "vertices")


@query("archive_half_sizes", f"""
SELECT leaf, count(*) AS n, min(hx) AS least_hx, max(hx) AS most_hx, (list(hx ORDER BY hx))[count(*) // 2 + 1] AS middle_hx, (list(hy ORDER BY hy))[count(*) // 2 + 1] AS middle_hy
FROM (SELECT *, NOT has_children AS leaf FROM {_NODES} AS n WHERE has_mesh) AS m GROUP BY leaf""")
def archive_half_sizes(spark, sf_dir):
    nodes = archive.node_table(_node_pages(spark, sf_dir)).withColumn("leaf", ~F.col("has_children"))
    return archive.half_sizes(nodes, "leaf").select("leaf", "n", "least_hx", "most_hx", "middle_hx", "middle_hy")


@query("archive_densest_area", f"""
WITH l AS (SELECT * FROM {_NODES} AS n WHERE has_mesh AND NOT has_children), d AS (SELECT floor(cx / 200) AS gx, floor(cy / 200) AS gy, count(*) AS n, avg(cx) AS x, avg(cy) AS y FROM l GROUP BY 1, 2 ORDER BY n DESC, gx, gy LIMIT 1)
SELECT d.n AS in_cell, round(x - 150, 4) AS min_x, round(y + 150, 4) AS max_y, count(*) AS leaves, sum(vertices)::BIGINT AS vertices FROM l, d
WHERE cx + hx >= x - 150 AND cx - hx <= x + 150 AND cy + hy >= y - 150 AND cy - hy <= y + 150 GROUP BY ALL""")
def archive_densest_area(spark, sf_dir):
    a = archive.densest_area(archive.node_table(_node_pages(spark, sf_dir)), 200.0, 150.0)
    return a.select("in_cell", F.round("min_x", 4).alias("min_x"), F.round("max_y", 4).alias("max_y"), "leaves", "vertices")


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "concat(element_at(array('nodepages', 'nodes/10', 'textures'), CAST(p_partkey % 3 + 1 AS INT)), '/', p_partkey, '.json') AS name", "CAST(p_size * 100 AS BIGINT) AS packed", "p_partkey * 5000 AS header", "CAST(p_partkey % 4 AS INT) AS rank")


_ENTRIES = "(SELECT [('nodepages'), 'nodes/10', 'textures'][p_partkey % 3 + 1] || '/' || p_partkey || '.json' AS name, p_size * 100 AS packed, p_partkey * 5000 AS header, (p_partkey % 4)::INT AS rank FROM part)"


@query("archive_directories", f"SELECT split_part(name, '/', 1) AS top, count(*) AS n, sum(packed)::BIGINT AS packed FROM {_ENTRIES} AS e GROUP BY 1")
def archive_directories(spark, sf_dir):
    return archive.directories(_entries(spark, sf_dir))


@query("archive_contiguity", f"""
SELECT count(*) AS n, sum(packed)::BIGINT AS packed, max(header + packed) - min(header) AS span, max(header + packed) - min(header) < sum(packed) * 1.5e0 AS contiguous FROM {_ENTRIES} AS e WHERE starts_with(name, 'nodepages/')""")
def archive_contiguity(spark, sf_dir):
    return archive.contiguity(_entries(spark, sf_dir), "nodepages/")


@query("archive_first", """
SELECT s_suppkey AS id, k::INT AS rank, k * 1000 + s_suppkey AS header FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 5 END AS k FROM supplier) AS s""")
def archive_first(spark, sf_dir):
    """The first of several archives that has an entry of each wanted name."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('tile', s_suppkey, '.tif') AS name")
    held = s.filter("id % 3 > 0").select("id", "name", F.explode(F.sequence(F.col("id") % 5, F.lit(6).cast("long"))).alias("k"))
    held = held.select("name", F.col("k").cast("int").alias("rank"), (F.col("k") * 1000 + F.col("id")).alias("header"))
    return archive.first_archive(s, held).select("id", "rank", "header")


# --- catalogues and portals


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("CAST(500 + s_suppkey AS INT) AS east_km", "CAST(5700 + s_suppkey % 9 AS INT) AS north_km")


@query("catalog_index_lookup", "SELECT (500 + s_suppkey)::INT AS east_km, (5700 + s_suppkey % 9)::INT AS north_km, 'u' || s_suppkey AS url FROM supplier WHERE s_suppkey % 4 > 0")
def catalog_index_lookup(spark, sf_dir):
    index = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 > 0").selectExpr("CAST(500 + s_suppkey AS INT) AS east_km", "CAST(5700 + s_suppkey % 9 AS INT) AS north_km", "concat('u', s_suppkey) AS url")
    return catalog.in_index(_tiles(spark, sf_dir), index)


@query("catalog_wanted", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 500 < (SELECT count(*) FROM supplier) AND o_orderkey % 500 IN (SELECT s_suppkey FROM supplier)")
def catalog_wanted(spark, sf_dir):
    items = table(spark, sf_dir, "orders").selectExpr("CAST(500 + o_orderkey % 500 AS INT) AS east_km", "CAST(5700 + o_orderkey % 500 % 9 AS INT) AS north_km", "o_orderkey")
    return catalog.wanted_only(items, _tiles(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_map_jobs", f"""
SELECT DISTINCT e::INT AS east_km, n::INT AS north_km, 'dop_' || e || '_' || n || '.tif' AS file,
 'https://example.org/wms?SERVICE=WMS&VERSION=1.1.1&REQUEST=GetMap&LAYERS=dop&STYLES=&SRS=EPSG:25832&BBOX=' || e * 1000 || ',' || n * 1000 || ',' || (e * 1000 + 1000) || ',' || (n * 1000 + 1000) || '&WIDTH=2000&HEIGHT=2000&FORMAT=image/tiff' AS url
FROM {_AREAS} AS a, unnest(range(floor(min_x / 1000)::BIGINT, ceil(max_x / 1000)::BIGINT)) AS x(e), unnest(range(floor(min_y / 1000)::BIGINT, ceil(max_y / 1000)::BIGINT)) AS y(n)""")
def catalog_map_jobs(spark, sf_dir):
    return catalog.map_jobs(_areas(spark, sf_dir), "by", "https://example.org/wms", "dop")


@query("catalog_outcomes", "SELECT c_mktsegment AS dataset, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS done, count(*) * 12.5e0 AS megabytes FROM customer GROUP BY 1")
def catalog_outcomes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.when(~(F.col("c_acctbal") > 0), "no route").alias("error"))
    return catalog.outcomes(c, "dataset").join(catalog.size_estimate(c, 12.5, "dataset").drop("n"), "dataset")


@query("catalog_newest_title", """
SELECT title, datum, min(gid) AS gid FROM (SELECT 'tile ' || o_custkey % 200 AS title, strftime(o_orderdate, '%Y-%m') AS datum, o_orderkey AS gid FROM orders WHERE o_orderkey > 0) AS t
WHERE (title, datum) IN (SELECT 'tile ' || o_custkey % 200, max(strftime(o_orderdate, '%Y-%m')) FROM orders WHERE o_orderkey > 0 GROUP BY 1) GROUP BY 1, 2""")
def catalog_newest_title(spark, sf_dir):
    f = table(spark, sf_dir, "orders").selectExpr("concat('tile ', o_custkey % 200) AS title", "date_format(o_orderdate, 'yyyy-MM') AS datum", "o_orderkey AS gid")
    return catalog.newest_title(f)


@query("catalog_one_per_file", "SELECT 'f' || o_custkey % 300 AS file, min('https://m' || o_orderkey % 4 || '.example.org/f' || o_custkey % 300) AS url FROM orders GROUP BY 1")
def catalog_one_per_file(spark, sf_dir):
    j = table(spark, sf_dir, "orders").selectExpr("concat('f', o_custkey % 300) AS file", "concat('https://m', o_orderkey % 4, '.example.org/f', o_custkey % 300) AS url")
    return catalog.one_per_file(j)


@query("catalog_page_grid", "SELECT s_nationkey || '_' || s_suppkey % 30 AS label, max(s_suppkey) AS id FROM supplier GROUP BY 1")
def catalog_page_grid(spark, sf_dir):
    """Tile ids out of GeoJSON that a page holds as an argument; one page per nation."""
    f = F.concat(F.lit('{ "type": "Feature", "properties": {"label": "'), F.col("s_nationkey").cast("string"), F.lit("_"), (F.col("s_suppkey") % 30).cast("string"), F.lit('", "id": '), F.col("s_suppkey").cast("string"), F.lit("} }"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", f.alias("f")).groupBy("s_nationkey")
    page = s.agg(F.concat(F.lit("<script>new Selector('map', '{\"crs\": 1, \"type\" : \"FeatureCollection\", \"features\": ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "f"))), lambda x: x["f"]), ", "), F.lit("]}', {'a': 1});</script>")).alias("value"))
    return catalog.page_grid(page)


@query("catalog_overview_jobs", """
SELECT name || '.zip' AS file, 'https://x.example.org/massen.php?file=' || name || '.zip&id=4&live=' || CASE WHEN s_suppkey % 2 = 0 THEN '2023' ELSE '' END || '&km=' || CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE '32' || (570 + s_suppkey % 200) // 10 * 10 || '_6020' END AS url
FROM (SELECT s_suppkey, 'dgm1_32_' || (570 + s_suppkey % 200) || '_' || (6020 + s_suppkey % 7) || '_1_sh_' || s_suppkey AS name FROM supplier) AS s""")
def catalog_overview_jobs(spark, sf_dir):
    k = lambda c: F.col(c).cast("string")
    s = table(spark, sf_dir, "supplier").withColumns({"e": F.col("s_suppkey") % 200 + 570, "n": F.col("s_suppkey") % 7 + 6020})
    props = F.concat(F.lit('{"properties": {"kaname": "dgm1_32_'), k("e"), F.lit("_"), k("n"), F.lit("_1_sh_"), k("s_suppkey"), F.lit('"'), F.when(F.col("s_suppkey") % 2 == 0, F.lit(', "jahr": 2023')).otherwise(""),
                     F.when(F.col("s_suppkey") % 3 == 0, F.lit(', "filepath": "own"')).otherwise(""), F.lit("}}"))
    pages = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"result": {"features": ['), props, F.lit("]}}"))).otherwise(F.concat(F.lit('{"features": ['), props, F.lit("]}"))).alias("value"))
    return catalog.overview_jobs(pages, "https://x.example.org", 4, ".zip")


@query("catalog_package_archives", "SELECT DISTINCT 'https://daten.example.org/DGM1_' || s_suppkey % 50 || '.ZIP' AS url FROM supplier WHERE s_suppkey % 3 = 0")
def catalog_package_archives(spark, sf_dir):
    k = (F.col("s_suppkey") % 50).cast("string")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://daten.example.org/DGM1_"), k, F.lit(".ZIP"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://other.org/dgm1_"), k, F.lit(".zip"))).otherwise(F.concat(F.lit("https://daten.example.org/dom_"), k, F.lit(".zip")))
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit('{"result": {"results": [{"x": 1}, {"resources": [{"url": "'), url, F.lit('"}, {}]}]}}')).alias("value"))
    return catalog.package_archives(pages, "daten.example.org", "dgm1", "https://daten.example.org/fallback.zip")


@query("catalog_category_archives", "SELECT 'https://h.example.org/' || n_nationkey || '/' || s_suppkey || '.zip' AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3")
def catalog_category_archives(spark, sf_dir):
    """Files below a folder: regions, nations, suppliers; two regions are not named by the root."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    names = lambda c: F.concat(F.lit('{"navigation": ['), F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: F.concat(F.lit('{"name": "'), x.cast("string"), F.lit('"}'))), ","), F.lit("]}"))
    root = nation.filter("n_regionkey < 3").agg(names("n_regionkey").alias("value")).select(F.lit("root").alias("path"), "value")
    inner = nation.groupBy("n_regionkey").agg(names("n_nationkey").alias("value")).select(F.concat(F.lit("root/"), F.col("n_regionkey").cast("string")).alias("path"), "value")
    uri = F.concat(F.lit('{"fileExtension": "ZIP", "downloadLink": {"uri": "/'), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit('.zip"}}, {"fileExtension": "pdf", "downloadLink": {"uri": "/x.pdf"}}'))
    leaves = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.array_join(F.collect_list(uri), ",").alias("d"))
    leaves = leaves.select(F.concat_ws("/", F.lit("root"), "n_regionkey", "n_nationkey").alias("path"), F.concat(F.lit('{"searchresult": {"downloads": ['), F.col("d"), F.lit("]}}")).alias("value"))
    return catalog.category_archives(root.unionByName(inner).unionByName(leaves), "root", "https://h.example.org")


@query("catalog_stac_jobs", """
SELECT 'item' || s_suppkey AS id, s_suppkey || '.tif' AS file, 'https://a.example.org/' || s_suppkey || '.tif' AS url, 'https://a.example.org/page' || (s_suppkey + 1) AS next FROM supplier WHERE s_suppkey % 4 > 0""")
def catalog_stac_jobs(spark, sf_dir):
    """Files of catalogue items whose asset key is written in any case, and the page behind each page."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"features": [{"id": "item'), k, F.lit('", "properties": {}, "assets": {"'), F.when(F.col("s_suppkey") % 4 == 0, "thumb").otherwise("DGM1-tif"), F.lit('": {"href": "https://a.example.org/'), k,
                    F.lit('.tif"}}}], "links": [{"rel": "self", "href": "x"}, {"rel": "next", "href": "https://a.example.org/page'), (F.col("s_suppkey") + 1).cast("string"), F.lit('"}]}'))
    pages = table(spark, sf_dir, "supplier").select(text.alias("value"))
    jobs = formats.asset_jobs(formats.stac_items(pages), "dgm1-TIF")
    after = formats.stac_next(pages).withColumn("id", F.concat(F.lit("item"), (F.regexp_extract("href", r"(\d+)$", 1).cast("long") - 1).cast("string")))
    return jobs.join(after, "id").select("id", "file", "url", F.col("href").alias("next"))


_RAW = [d for s, d in sorted(catalog.ADDRESSES) if s == "by"]


def _area_sql(dataset: str) -> str:
    size, (pattern, folders) = catalog.grid_km("by", dataset), catalog.ADDRESSES["by", dataset]
    axis = lambda lo, hi: f"unnest(range(floor({lo} / {size * 1000}e0)::BIGINT, ceil({hi} / {size * 1000}e0)::BIGINT))"
    tiles = f"SELECT DISTINCT (x * {size})::INT AS e, (y * {size})::INT AS n FROM {_AREAS} AS a, {axis('min_x', 'max_x')} AS u(x), {axis('min_y', 'max_y')} AS v(y)"
    return f"SELECT '{dataset}' AS dataset, e AS east_km, n AS north_km, '{folders[0]}' || printf('{pattern}', e, n) AS first_mirror, '{folders[1]}' || printf('{pattern}', e, n) AS second_mirror, {catalog.TILE_MB['by', dataset]}e0 AS megabytes FROM ({tiles}) AS t"


@query("catalog_area_jobs", " UNION ALL ".join(map(_area_sql, _RAW)))
def catalog_area_jobs(spark, sf_dir):
    """The files of seven datasets that the areas of all suppliers need, with their sizes."""
    found = None
    for dataset in _RAW:
        own = catalog.area_jobs(_areas(spark, sf_dir), "by", dataset).select(
            F.lit(dataset).alias("dataset"), "east_km", "north_km", F.get("mirrors", F.lit(0)).alias("first_mirror"), F.get("mirrors", F.lit(1)).alias("second_mirror"), "megabytes")
        found = own if found is None else found.unionByName(own)
    return found


# Credentials are put into the pages' addresses: none, a user, a password with escapes, one with colons and an @; some lose their scheme.
_USERS = ["", "anna@", "b%40b:p%3Ass+1@", "c:a:b@c@", "", "d:@"]
_WRITTEN = f"(SELECT page_id, ' ' || CASE WHEN page_id % 5 = 0 THEN '' ELSE 'https://' END || [{', '.join(repr(u) for u in _USERS)}][page_id % 6 + 1] || split_part(url, '://', 2) || '// ' AS u FROM pages)"


@query("address_credentials", f"""
WITH t AS (SELECT page_id, u, CASE WHEN contains(trim(u), '://') THEN rtrim(trim(u), '/') ELSE 'http://' || rtrim(trim(u), '/') END AS w FROM {_WRITTEN} AS p),
s AS (SELECT *, strpos(w, '://') + 2 AS k, length(w) - strpos(reverse(w), '@') + 1 AS cut, contains(w, '@') AS named FROM t),
c AS (SELECT *, substr(w, k + 1, cut - k - 1) AS creds FROM s)
SELECT page_id, CASE WHEN named THEN substr(w, 1, k) || substr(w, cut + 1) ELSE w END AS address, CASE WHEN named THEN url_decode(split_part(creds, ':', 1)) END AS "user",
 CASE WHEN named AND contains(creds, ':') THEN url_decode(substr(creds, strpos(creds, ':') + 1)) END AS password,
 CASE WHEN named THEN substr(w, 1, k) || '***:***@' || substr(w, cut + 1) ELSE w END AS masked, list_last(string_split(w, '/')) AS last FROM c""")
def address_credentials(spark, sf_dir):
    """The addresses of all pages with credentials put in, split again, and as they may be logged."""
    user = F.element_at(F.array(*(F.lit(u) for u in _USERS)), (F.col("page_id") % 6 + 1).cast("int"))
    scheme = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.lit("https://"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" "), scheme, user, F.split_part("url", F.lit("://"), F.lit(2)), F.lit("// ")).alias("u"))
    whole = addresses.with_scheme(F.col("u"))
    return pages.select("page_id", addresses.split_credentials(F.col("u")).alias("s"), addresses.masked(whole).alias("masked"), addresses.last_segment(whole).alias("last")).select("page_id", "s.*", "masked", "last")


_KINDS = "CASE o_orderkey % 7 WHEN 0 THEN 'SSL' WHEN 1 THEN 'timeout' WHEN 2 THEN 'host' WHEN 3 THEN 'socket' WHEN 4 THEN 'answer' END"


@query("transfer_failures", f"""
WITH o AS (SELECT o_orderpriority AS p, {_KINDS} AS k, CASE WHEN o_orderkey % 3 = 0 THEN 400 + o_custkey % 20 END AS s, 'message ' || o_custkey % 1000 AS t FROM orders)
SELECT p AS priority, CASE WHEN coalesce(s = 407, FALSE) OR contains(t, '407') THEN 'PROXY_AUTH' WHEN k = 'SSL' THEN 'SSL' WHEN k = 'timeout' THEN 'TIMEOUT' WHEN k = 'host' THEN 'DNS' WHEN k = 'socket' THEN 'PROXY'
 WHEN s IS NOT NULL THEN 'HTTP' ELSE 'OTHER' END AS code, count(*) AS n FROM o GROUP BY 1, 2""")
def transfer_failures(spark, sf_dir):
    """What failed transfers died of, counted by priority."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS priority", f"{_KINDS} AS kind", "CASE WHEN o_orderkey % 3 = 0 THEN 400 + o_custkey % 20 END AS status", "concat('message ', o_custkey % 1000) AS text")
    return o.groupBy("priority", addresses.failure_code(F.col("kind"), F.col("status"), F.col("text")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- written angles


def _cut(v: str) -> str:
    """SQL: the value of degrees, minutes and hundredths of seconds as written by crs_dms_format."""
    d, m = f"floor(abs({v}))", f"floor((abs({v}) - floor(abs({v}))) * 60e0)"
    return f"(CASE WHEN {v} < 0 THEN -1 ELSE 1 END * ({d} + {m} / 60e0 + round((abs({v}) - {d} - {m} / 60e0) * 3600e0, 2) / 3600e0))"


@query("dms_parse", f"SELECT id, round({_cut('lat')}, 7) AS lat, round({_cut('(lon - 10e0)')}, 7) AS lon FROM {POINTS}")
def dms_parse(spark, sf_dir):
    """Written angles in four orders and spellings."""
    df = points(spark, sf_dir).withColumn("lon", F.col("lon") - 10.0)
    a, b = F.expr(geodesy.dms("lat", "N", "S")), F.expr(geodesy.dms("lon", "E", "W"))
    lead = lambda c: F.regexp_replace(c, "^(.*)([NSEW])$", "$2 $1")
    spaced = lambda c: F.regexp_replace(c, "[°'\"]", " ")
    text = F.element_at(F.array(F.concat_ws(" ", a, b), F.concat_ws(" ", lead(a), lead(b)), F.concat_ws(", ", spaced(b), spaced(a)), F.concat_ws(" / ", b, a)), (F.col("id") % 4 + 1).cast("int"))
    found = jsoncoords.with_angles(df.select("id", text.alias("text")), "text")
    return found.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))
