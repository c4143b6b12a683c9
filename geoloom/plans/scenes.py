"""Queries over files that Spark writes from the tables and reads again: rasters, tracks, pictures, meshes, bundles, scene documents.

Grids are as large as their table: a fixed width, and as many rows as the keys need.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.operators import catalog, scenedoc, surface, trajectory
from geoloom.operators.raster import Grid
from geoloom.plans.points import table
from geoloom.sources import bundle, files, meshes, pictures, rasters, sinks, tracks

QUERIES, ORACLE_SQL = {}, {}
#: Cells across, and the corner and pixel, of grids made from orders.
WIDE, X, Y, PIXEL = 200, 500_000.0, 5_400_000.0, 2.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _grid(orders) -> Grid:
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    return Grid(WIDE, top // WIDE + 1, X, Y, PIXEL)


def _cells(orders, value: str):
    return orders.selectExpr(f"o_orderkey div {WIDE} AS row", f"o_orderkey % {WIDE} AS col", f"CAST({value} AS DOUBLE) AS value")


_BOX = (X + 41.0, Y - 1_000_000.0, X + 159.0, Y - 61.0)


@query("raster_files_in_a_box", f"""
SELECT o_custkey % 7 AS raster, count(o_custkey) AS cells, count(CASE WHEN o_orderkey % 13 > 0 THEN 1 END) AS n, sum(CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END)::BIGINT AS total
FROM orders WHERE {X} + (o_orderkey % {WIDE} + 0.5) * {PIXEL} BETWEEN {_BOX[0]} AND {_BOX[2]} AND {Y} - (o_orderkey // {WIDE} + 0.5) * {PIXEL} BETWEEN {_BOX[1]} AND {_BOX[3]} GROUP BY 1""")
def raster_files_in_a_box(spark, sf_dir):
    """Seven rasters of all orders, written as tiled files and read again in a box; of each the cells that were given."""
    orders, path = table(spark, sf_dir, "orders"), files.scratch(spark, "rasters")
    cells = _cells(orders, "o_custkey").withColumn("raster", F.col("value") % 7)
    # Two values of a cell tell what was given from what is NoData: the customer, and a mark.
    given = cells.withColumn("value", F.when((F.col("row") * WIDE + F.col("col")) % 13 > 0, F.col("value"))).withColumn("raster", F.concat(F.lit("v"), F.col("raster").cast("int").cast("string")))
    marks = cells.withColumn("value", F.lit(1.0)).withColumn("raster", F.concat(F.lit("m"), F.col("raster").cast("int").cast("string")))
    rasters.write_rasters(given.unionByName(marks), path, X, Y, PIXEL, raster="raster", side=256)
    back = rasters.read_rasters(spark, path, _BOX, part_bytes=1 << 20).withColumn("name", rasters.file_name(F.col("path")))
    kind, number = F.substring("name", 1, 1), F.substring("name", 2, 9).cast("long")
    return back.groupBy(number.alias("raster")).agg(
        F.count(F.when(kind == "m", F.col("value"))).alias("cells"), F.count(F.when(kind == "v", F.col("value"))).alias("n"), F.sum(F.when(kind == "v", F.col("value").cast("long"))).alias("total"))


_AREA_CELLS = f"(SELECT o_orderkey // {WIDE} AS r, o_orderkey % {WIDE} AS c, (o_custkey * 7) % 23 AS above, o_orderkey * 31 % 17 AS k FROM orders)"


@query("scene_areas", f"""
WITH o AS (SELECT * FROM {_AREA_CELLS} AS o0), h AS (SELECT max(r) AS r FROM o),
d AS (SELECT DISTINCT r + i AS r, c + j AS c FROM (SELECT * FROM o WHERE k = 3), range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE abs(i) + abs(j) <= 2)
SELECT 'tall' AS area, count(*) AS cells, sum(r * 7 + c)::BIGINT AS places FROM o WHERE above >= 20
UNION ALL SELECT 'class', count(*), sum(d.r * 7 + d.c)::BIGINT FROM d, h WHERE d.r BETWEEN 0 AND h.r AND d.c BETWEEN 0 AND {WIDE - 1}""")
def scene_areas(spark, sf_dir):
    """A scene document over heights, a surface and classes from all orders; its areas are written as masks and read again."""
    orders, folder = table(spark, sf_dir, "orders"), files.scratch(spark, "scene")
    grid = _grid(orders)
    text = """{ // paths are relative
      "Map": {"TERRAINFILE": "ground.tif", "surfaceFile": "top.tif", "classificationFile": "classes.tif", "unknown": {"a": 1},},
      "areas": [{"name": "tall", "objectsTallerThan": 20, "geoTiff": "out/tall.tif"}, {"name": "class", "inClass": 3, /* two cells */ "dilateMeters": 4, "geoTiff": "out/class.tif"},], }"""
    for name, value in (("ground", "o_orderkey % 50"), ("top", "o_orderkey % 50 + (o_custkey * 7) % 23"), ("classes", "o_orderkey * 31 % 17")):
        path = f"{folder}/{name}.tif"
        # A raster that is too large for one file is a folder of files.
        if rasters.save_grid(_cells(orders, value), grid, path) != [path]:
            text = text.replace(f'"{name}.tif"', f'"{name}"')
    doc = scenedoc.parse(text)
    out = scenedoc.run(spark, doc, folder)
    seen = rasters.read_rasters(spark, f"{folder}/out").filter("value = 1")
    row, col = grid.cell(F.col("x"), F.col("y"))
    if len(out.written) < 2:
        raise ValueError("the areas were not written")
    name = F.regexp_extract("path", r"/out/([a-z]+)[./]", 1)
    return seen.groupBy(name.alias("area")).agg(F.count(F.lit(1)).alias("cells"), F.sum(row * 7 + col).alias("places"))


_FLIGHT = "(SELECT event_id AS k, event_id * 0.5e0 AS t, 500000 + user_id * 2 AS x, 5400000 + event_id % 1000 AS y, 100 + event_id % 7 AS z, (event_id * 37) % 360 AS yaw FROM events)"


@query("scene_points", f"""
WITH f AS (SELECT * FROM {_FLIGHT} AS f0), n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM f WINDOW w AS (ORDER BY t))
SELECT 'trajectory_' || (2 * k) AS name, x - 500020e0 AS east, y - 5399980e0 AS north, z::DOUBLE AS up, round(yaw::DOUBLE, 3) AS euler_y FROM f
UNION ALL SELECT 'trajectory_' || (2 * k + 1), (x + x1) / 2e0 - 500020, (y + y1) / 2e0 - 5399980, (z + z1) / 2e0, NULL FROM n WHERE x1 IS NOT NULL""")
def scene_points(spark, sf_dir):
    """A scene document that follows one track of all events from a JSON file; its points are written and read again. Angles are compared where a frame is a sample."""
    events, folder = table(spark, sf_dir, "events"), files.scratch(spark, "scene")
    text = F.to_json(F.struct((F.col("event_id") * 500).alias("Time"), (F.col("user_id") * 2 + 500_000).alias("easting"), F.concat((F.col("event_id") % 1000 + 5_400_000).cast("string"), F.lit(".0")).alias("northing"),
                              (F.col("event_id") % 7 + 100).alias("msl"), (F.col("event_id") * 37 % 360).alias("course"), F.col("event_type").alias("note")))
    # One document per 5,000 events, each an object whose first array holds the records; a flight is what a folder of documents says.
    part = F.floor(F.col("event_id") / 5000)
    docs = events.select(part.alias("part"), "event_id", text.alias("t")).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]), ",").alias("t"))
    docs.select(F.concat(F.lit('{"unit": "ms", "samples": ['), F.col("t"), F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/flight.json")
    flat = Grid(20, 20, X, Y, 2.0)
    rasters.save_grid(flat.cells(spark).withColumn("value", F.lit(5.0)), flat, f"{folder}/ground.tif")
    doc = scenedoc.parse('{"map": {"terrainFile": "ground.tif"}, "trajectory": {"file": "flight.json", "mapping": {"fields": {"time": "Time", "easting": "X", "NORTHING": "Y", "msl": "Z", "course": "Yaw"}, "timeDivisor": 1000}}, '
                         '"outputs": {"unityPoints": "out/points.json", "pointStepSeconds": 0.25}}')
    table_ = tracks.read_table(spark, f"{folder}/flight.json")
    whole = scenedoc.made_once(tracks.samples(table_, doc.trajectory.mapping.mapping()).withColumn("id", F.lit("flight")), "track")
    scene = scenedoc.Scene(flat.cells(spark).withColumn("value", F.lit(5.0)), flat, samples=whole)
    points = scenedoc.point_set(scene, None, doc.outputs.pointStepSeconds, True, False)
    bundle.write_points(points, f"{folder}/out", "points.json", bundle.anchor_facts(spark, scene.anchor, 32), most=20_000)
    shape = "name STRING, x DOUBLE, y DOUBLE, z DOUBLE, unityEulerY DOUBLE"
    back = spark.read.text(f"{folder}/out", wholetext=True).select(F.inline(F.from_json("value", f"STRUCT<points: ARRAY<STRUCT<{shape}>>>")["points"]))
    even = F.substring_index("name", "_", -1).cast("long") % 2 == 0
    return back.select("name", F.col("x").alias("east"), F.col("y").alias("north"), F.col("z").alias("up"), F.when(even, F.round("unityEulerY", 3)).alias("euler_y"))


@query("scene_bundle", f"""
WITH o AS (SELECT o_orderkey // {WIDE} AS r, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 400 END AS v FROM orders), g AS (SELECT max(r) AS top, min(v) AS low FROM o)
SELECT r // 10 AS band, {WIDE} * count(DISTINCT r) AS cells, (sum(coalesce(v, low)) + ({WIDE} * count(DISTINCT r) - count(*)) * any_value(low))::BIGINT AS total FROM o, g GROUP BY 1""")
def scene_bundle(spark, sf_dir):
    """Heights of all orders through a bundle of several files: gaps come back as the lowest height."""
    orders, folder = table(spark, sf_dir, "orders"), files.scratch(spark, "bundle")
    grid = _grid(orders)
    cells = _cells(orders, "CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 400 END")
    bundle.write_bundle(folder, cells, grid, (X, Y), overlays=[("high", cells.filter("value > 300"))], most_cells=WIDE * 40)
    back = bundle.read_heights(spark, folder, read_cells=5000)
    return back.groupBy(F.floor(F.col("row") / 10).alias("band")).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("value").cast("long")).alias("total"))


def _picture_files(batches):
    """A PNG of 25 columns and 20 rows from the colours of each picture."""
    for batch in batches:
        made = []
        for text in batch.column("rgb"):
            values = np.array(text.as_py(), np.uint8).reshape(20, 25, 3)
            made.append(pictures.encode(values))
        yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(made, pa.binary())], ["image", "data"])


@query("picture_files", """
SELECT o_orderkey // 500 AS image, count(*) AS pixels, round(sum((o_orderkey * 37) % 256) / 255e0, 6) AS red, round(sum((o_orderkey * 91 + o_orderkey // 500) % 256) / 255e0, 6) AS green, 500e0 AS opaque
FROM orders WHERE o_orderkey // 500 < (SELECT max(o_orderkey) + 1 FROM orders) // 500 GROUP BY 1""")
def picture_files(spark, sf_dir):
    """Pictures of 500 orders each, as PNG files that are written by tasks and decoded again."""
    orders, folder = table(spark, sf_dir, "orders"), files.scratch(spark, "pictures")
    k = F.col("o_orderkey")
    rgb = F.array(k * 37 % 256, (k * 91 + F.floor(k / 500)) % 256, k * 13 % 256)
    images = orders.select(F.floor(k / 500).alias("image"), k.alias("k"), rgb.alias("c")).groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])).alias("rgb"))
    coded = images.filter(F.size("rgb") == 1500).mapInArrow(_picture_files, "image long, data binary")

    def write(batches):
        for batch in batches:
            for image, data in zip(batch.column("image").to_pylist(), batch.column("data")):
                files.write(f"{folder}/{image}.png", [data.as_py()])
            yield pa.RecordBatch.from_arrays([batch.column("image")], ["image"])

    # A repeated attempt writes the same bytes to the same name.
    coded.mapInArrow(write, "image long").agg(F.count(F.lit(1))).first()
    back = pictures.read_pictures(spark, folder).withColumn("image", F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long"))
    return back.groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("r"), 6).alias("red"), F.round(F.sum("g"), 6).alias("green"), F.sum("a").alias("opaque"))


def _textured(k):
    """A binary mesh of nine corners with texture coordinates: positions and coordinates are small whole numbers of the key."""
    number = lambda v: F.element_at(F.array(*(F.lit(struct.pack("<f", n).hex()) for n in range(64))), (v % 64 + 1).cast("int"))
    place = [number(k * 7 + i * 5) for i in range(27)]
    texture = [number(k * 3 + i * 11) for i in range(18)]
    return F.unhex(F.concat(F.lit(struct.pack("<II", 9, 3).hex()), *place, *texture))


_P = lambda i: f"((s_suppkey * 7 + (9 * t + {i}) * 5) % 64)"


@query("mesh_files", f"""
WITH t AS (SELECT s_suppkey AS node, t, {_P(0)} + {_P(3)} + {_P(6)} AS sx, {_P(1)} + {_P(4)} + {_P(7)} AS sy, {_P(2)} + {_P(5)} + {_P(8)} AS sz,
 list_sum([(s_suppkey * 3 + (6 * t + 2 * j) * 11) % 64 FOR j IN range(3)]) AS su FROM supplier, range(3) AS r(t)),
k AS (SELECT * FROM t WHERE sx / 3e0 BETWEEN 10 AND 50 AND sy / 3e0 BETWEEN 10 AND 50), n AS (SELECT node, count(*) * 3 AS n FROM k GROUP BY 1)
SELECT k.node, count(*) * 3 AS corners, (sum(sx) - count(*) * 30)::DOUBLE AS x, sum(sy)::DOUBLE AS y, sum(sz)::DOUBLE AS z, sum(su)::DOUBLE AS u, (SELECT coalesce(sum(n.n), 0) FROM n WHERE n.node < k.node)::BIGINT AS first_vertex FROM k GROUP BY 1""")
def mesh_files(spark, sf_dir):
    """Textured meshes of all suppliers, clipped, numbered, written as binary glTF per node and read again."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), _textured(F.col("s_suppkey")).alias("data"))
    kept, folder = meshes.in_area(meshes.corners(nodes), (10.0, 10.0, 50.0, 50.0)), files.scratch(spark, "meshes")
    meshes.write_meshes(kept, folder, "glb", (10.0, 0.0))
    back = meshes.read_glb(spark, folder).withColumn("node", F.regexp_extract("path", r"node_(\d+)\.glb", 1).cast("long"))
    first = meshes.numbered(kept).groupBy("node").agg(F.min("vertex").alias("first_vertex"))
    return back.groupBy("node").agg(F.count(F.lit(1)).alias("corners"), *(F.sum(c).alias(c) for c in "xyzu")).join(first, "node")


_BAKE = f"(SELECT o_orderkey // {WIDE} AS row, o_orderkey % {WIDE} AS col, (o_custkey % 500)::DOUBLE AS v FROM orders WHERE o_orderkey < (SELECT (max(o_orderkey) + 1) // {WIDE} * {WIDE} FROM orders))"
_LX, _LY, _LZ = (v / sum(w * w for w in surface.LIGHT) ** 0.5 for v in surface.LIGHT)
_RAMP = lambda a, b, c: f"CASE WHEN k < 0.5 THEN {a} + ({b} - {a}) * k * 2 ELSE {b} + ({c} - {b}) * (k - 0.5) * 2 END"


@query("terrain_colours", f"""
WITH c AS (SELECT * FROM {_BAKE} AS c0), g AS (SELECT min(v) AS lo, max(v) AS hi, max(row) + 1 AS h FROM c),
n AS (SELECT *, greatest(CAST(ceil({WIDE} / 61e0) AS BIGINT), 1) AS n0 FROM g),
s AS (SELECT *, (SELECT min(i) FROM range(1, 100000) AS r(i) WHERE {WIDE} // i <= 60 AND h // i <= 60) AS n FROM g),
d AS (SELECT row, col, v, coalesce(lag(v) OVER a, v) - coalesce(lead(v) OVER a, v) AS nx, coalesce(lead(v) OVER b, v) - coalesce(lag(v) OVER b, v) AS nz FROM c WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row)),
e AS (SELECT row, col, (v - lo) / greatest(0.001, hi - lo) AS k, 0.35 + 0.65 * least(greatest((nx * {_LX} + {2 * PIXEL} * {_LY} + nz * {_LZ}) / sqrt(nx * nx + {(2 * PIXEL) ** 2} + nz * nz), 0), 1) AS f, v, s.n
 FROM d, s WHERE row % s.n = 0 AND col % s.n = 0 AND row < s.h // s.n * s.n AND col < {WIDE} // s.n * s.n),
p AS (SELECT row // n AS row, col // n AS col, v, f * ({_RAMP(0.35, 0.62, 0.92)}) AS r, f * ({_RAMP(0.48, 0.52, 0.92)}) AS g, f * ({_RAMP(0.28, 0.38, 0.92)}) AS b FROM e)
SELECT row, col, round(CASE WHEN v > 450 THEN r + (231 / 255e0 - r) * 0.5 ELSE r END, 6) AS r, round(CASE WHEN v > 450 THEN g + (76 / 255e0 - g) * 0.5 ELSE g END, 6) AS g, round(CASE WHEN v > 450 THEN b + (60 / 255e0 - b) * 0.5 ELSE b END, 6) AS b FROM p""")
def terrain_colours(spark, sf_dir):
    """A picture of the heights of all orders, thinned to 60 cells a side, with high places tinted."""
    orders = table(spark, sf_dir, "orders")
    full = (orders.agg(F.max("o_orderkey")).first()[0] + 1) // WIDE
    cells = _cells(orders.filter(F.col("o_orderkey") < full * WIDE), "o_custkey % 500")
    found = surface.colours(cells, Grid(WIDE, full, X, Y, PIXEL), [(cells.filter("value > 450"), (231, 76, 60))], most=60)
    return found.select("row", "col", *(F.round(c, 6).alias(c) for c in "rgb"))


_STATE_JOBS = sorted(catalog.ADDRESSES)


def _state_sql(state: str, dataset: str) -> str:
    pattern, (folder, *_) = catalog.ADDRESSES[state, dataset]
    e, n = ("CASE WHEN e % 2 <> 0 THEN e ELSE e - 1 END", "CASE WHEN n % 2 = 0 THEN n ELSE n - 1 END") if state == "bw" else ("e", "n")
    return f"SELECT '{state}' AS state, '{dataset}' AS dataset, e AS east_km, n AS north_km, '{folder}' || printf('{pattern}', {e}, {n}) AS url FROM t"


@query("catalog_state_jobs", "WITH t AS (SELECT (300 + s_suppkey % 500)::INT AS e, (5200 + s_suppkey * 7 % 800)::INT AS n FROM supplier) " + " UNION ALL ".join(_state_sql(*x) for x in _STATE_JOBS))
def catalog_state_jobs(spark, sf_dir):
    """Addresses of all suppliers' tiles in every dataset whose addresses follow from the tile."""
    t = table(spark, sf_dir, "supplier").selectExpr("CAST(300 + s_suppkey % 500 AS INT) AS east_km", "CAST(5200 + s_suppkey * 7 % 800 AS INT) AS north_km")
    found = None
    for state, dataset in _STATE_JOBS:
        own = catalog.state_jobs(t, state, dataset).select(F.lit(state).alias("state"), F.lit(dataset).alias("dataset"), "east_km", "north_km", F.get("mirrors", F.lit(0)).alias("url"))
        found = own if found is None else found.unionByName(own)
    return found


_TRACK = "(SELECT user_id AS id, event_id * 1e0 AS t, (event_id * 13 % 101) * 1e0 AS x, (event_id * 7 % 53) * 1e0 AS y, (event_id % 5) * 1e0 AS z FROM events)"


@query("track_travelled", f"""
WITH d AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy, coalesce(z - lag(z) OVER w, 0) AS dz FROM {_TRACK} AS t0 WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT id, t, round(sum(sqrt(dx * dx + dy * dy + dz * dz)) OVER (PARTITION BY id ORDER BY t), 4) AS travelled FROM d""")
def track_travelled(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id * 1e0 AS t", "(event_id * 13 % 101) * 1e0 AS x", "(event_id * 7 % 53) * 1e0 AS y", "(event_id % 5) * 1e0 AS z")
    return trajectory.cumulative(t).select("id", "t", F.round("travelled", 4).alias("travelled"))


@query("track_viewer_poses", """
WITH t AS (SELECT user_id AS id, event_id * 1e0 AS t, event_id % 100 * 1e0 AS x, (event_id % 40) * 9e0 AS yaw FROM events), b AS (SELECT id, min(t) AS t0 FROM t GROUP BY 1)
SELECT t.id, t.t - t0 AS t, x, round(0e0 - sin(radians(yaw / 2)), 6) + 0e0 AS qz, round(cos(radians(yaw / 2)), 6) AS qw FROM t JOIN b ON t.id = b.id""")
def track_viewer_poses(spark, sf_dir):
    """Where a viewer stands at every sample, by the time since the track's first one: quaternions of the headings."""
    t = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id * 1e0 AS t", "event_id % 100 * 1e0 AS x", "0e0 AS y", "0e0 AS z", "(event_id % 40) * 9e0 AS yaw", "0e0 AS pitch", "0e0 AS roll")
    begin = t.groupBy("id").agg(F.min("t").alias("t0"))
    asked = t.join(begin, "id").select("id", (F.col("t") - F.col("t0")).alias("t"))
    return trajectory.viewer_poses(t, asked).select("id", "t", "x", (F.round("q.z", 6) + 0.0).alias("qz"), F.round("q.w", 6).alias("qw"))


@query("points_export", """
SELECT '{"name":"p' || s_suppkey || '","tag":"t","x":' || printf('%.1f', s_suppkey * 1e0) || ',"y":' || printf('%.1f', s_suppkey * 0.5e0) || ',"z":0.0,"unityX":' || printf('%.1f', s_suppkey * 1e0) || ',"unityY":0.0,"unityZ":' || printf('%.1f', s_suppkey * 0.5e0)
 || ',"unityEulerX":-1.5,"unityEulerY":' || printf('%.1f', s_suppkey % 360 * 1e0) || ',"unityEulerZ":0.0}' AS text FROM supplier""")
def points_export(spark, sf_dir):
    """Points as a viewer reads them; minus zero is written as zero."""
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS i", "concat('p', s_suppkey) AS name", "'t' AS tag", "s_suppkey * 1e0 AS east", "s_suppkey * 0.5e0 AS north", "-0.00001e0 AS up", "s_suppkey % 360 * 1e0 AS yaw", "1.5e0 AS pitch", "0e0 AS roll")
    return bundle.point_texts(p).select("text")


@query("found_coordinates_export", """
WITH c AS (SELECT c_custkey AS k, 48e0 + (c_custkey % 400) * 0.01e0 AS lat, 9e0 + (c_custkey % 300) * 0.01e0 AS lon FROM customer)
SELECT k, round(lat, 8) AS lat, round(lon, 8) AS lon, '$.at' AS path, 4326 AS epsg, 'WGS 84 (geographic lat/lon)' AS crs, 0.95e0 AS confidence, round(lon, 3) AS x, round(lat, 3) AS y FROM c""")
def found_coordinates_export(spark, sf_dir):
    """Features with their provenance, read back from their texts."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "48e0 + (c_custkey % 400) * 0.01e0 AS lat", "9e0 + (c_custkey % 300) * 0.01e0 AS lon")
    finds = c.select("lat", "lon", F.lit(None).cast("double").alias("z"), F.lit("$.at").alias("path"), F.concat(F.lit("#"), F.col("k").cast("string")).alias("raw"), F.lit(4326).alias("epsg"), F.lit(0.95).alias("confidence"))
    texts = sinks.found_features(finds, 4326)
    shape = "STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<sourcePath: STRING, sourceRaw: STRING, detectedEpsg: INT, detectedCrs: STRING, confidence: DOUBLE, epsg4326_x: DOUBLE, epsg4326_y: DOUBLE>>"
    f = texts.select(F.from_json("value", shape).alias("f"))
    return f.select(F.substring("f.properties.sourceRaw", 2, 20).cast("long").alias("k"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.properties.sourcePath").alias("path"),
                    F.col("f.properties.detectedEpsg").alias("epsg"), F.col("f.properties.detectedCrs").alias("crs"), F.col("f.properties.confidence").alias("confidence"), F.col("f.properties.epsg4326_x").alias("x"), F.col("f.properties.epsg4326_y").alias("y"))


