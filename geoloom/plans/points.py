"""Queries over coordinates, tiles, boxes and polygons. Points are derived from the keys of `customer`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps
from geoloom.operators import detection, geometry, tiles

POINTS = "(SELECT c_custkey AS id, 47.3e0 + (c_custkey % 800) * 0.01e0 AS lat, 6.0e0 + ((c_custkey * 7) % 900) * 0.01e0 AS lon FROM customer) AS p"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "47.3e0 + (c_custkey % 800) * 0.01e0 AS lat", "6.0e0 + ((c_custkey * 7) % 900) * 0.01e0 AS lon")


def _r(*cols: tuple[str, int]):
    return [F.round(c, d).alias(c) for c, d in cols]


QUERIES, ORACLE_SQL = {}, {}


def _projection(name: str, epsg: int):
    def query(spark, sf_dir):
        there = geodesy.with_projected(points(spark, sf_dir), epsg)
        back = geodesy.with_geographic(there.select("id", "x", "y"), epsg)
        return back.select("id", *_r(("x", 3), ("y", 3), ("lat", 7), ("lon", 7)))

    QUERIES[f"crs_{name}"] = query
    ORACLE_SQL[f"crs_{name}"] = (
        "SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM "
        + steps.as_sql("(SELECT id, x, y FROM " + steps.as_sql(POINTS, geodesy.from_geo(epsg, "lat", "lon", "x", "y")) + ") AS q", geodesy.to_geo(epsg, "x", "y", "lat", "lon")))


for _name, _epsg in (("utm32", 25832), ("utm33_wgs84", 32633), ("utm_zone_prefixed", 4647), ("web_mercator", 3857), ("gauss_krueger3", 31467), ("gauss_krueger4", 31468)):
    _projection(_name, _epsg)


def crs_convert_by_column(spark, sf_dir):
    codes = F.element_at(F.array(*(F.lit(c) for c in (25832, 25833, 3857, 4326))), (F.col("id") % 4 + 1).cast("int"))
    df = points(spark, sf_dir).withColumn("epsg", codes)
    for c in (25832, 25833, 3857, 4326):
        df = steps.apply(df, geodesy.from_geo(c, "lat", "lon", f"x{c}", f"y{c}", f"k{c}"))
    pick = lambda v: F.coalesce(*(F.when(F.col("epsg") == c, F.col(f"{v}{c}")) for c in (25832, 25833, 3857, 4326)))
    df = df.select("id", "epsg", pick("x").alias("x"), pick("y").alias("y"))
    return geodesy.convert_by_column(df, "epsg", "x", "y", "lat", "lon").select("id", "epsg", *_r(("lat", 6), ("lon", 6)))


QUERIES["crs_convert_by_column"] = crs_convert_by_column
ORACLE_SQL["crs_convert_by_column"] = f"""
SELECT id, [25832, 25833, 3857, 4326][id % 4 + 1]::INT AS epsg, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {POINTS}"""


def crs_planar_distance(spark, sf_dir):
    at = geodesy.with_projected(points(spark, sf_dir), 25832)
    return at.select("id", F.round(F.hypot(F.col("x") - 691607.86, F.col("y") - 5334760.39), 2).alias("metres"))


QUERIES["crs_planar_distance"] = crs_planar_distance
ORACLE_SQL["crs_planar_distance"] = f"""
SELECT id, round(sqrt((x - 691607.86e0) ** 2 + (y - 5334760.39e0) ** 2), 2) AS metres FROM {steps.as_sql(POINTS, geodesy.from_geo(25832, "lat", "lon", "x", "y"))}"""


def crs_dms_format(spark, sf_dir):
    shifted = points(spark, sf_dir).withColumn("lon", F.col("lon") - 10.0)
    return shifted.selectExpr("id", f"concat({geodesy.dms('lat', 'N', 'S')}, ' ', {geodesy.dms('lon', 'E', 'W')}) AS dms")


def _dms_sql(v, pos, neg):
    d, m = f"floor(abs({v}))", f"floor((abs({v}) - floor(abs({v}))) * 60e0)"
    return f"{d}::INT || '°' || lpad(({m}::INT)::VARCHAR, 2, '0') || '''' || lpad(printf('%.2f', round((abs({v}) - {d} - {m} / 60e0) * 3600e0, 2)), 5, '0') || '\"' || CASE WHEN {v} < 0 THEN '{neg}' ELSE '{pos}' END"


QUERIES["crs_dms_format"] = crs_dms_format
ORACLE_SQL["crs_dms_format"] = f"SELECT id, {_dms_sql('lat', 'N', 'S')} || ' ' || {_dms_sql('(lon - 10e0)', 'E', 'W')} AS dms FROM {POINTS}"


def _pairs(spark, sf_dir):
    """Pairs in five writings: lat/lon, lon/lat, UTM 32, reversed UTM 32, Web Mercator."""
    df = points(spark, sf_dir)
    df = steps.apply(df, geodesy.from_geo(25832, "lat", "lon", "ux", "uy", "u"))
    df = steps.apply(df, geodesy.from_geo(3857, "lat", "lon", "mx", "my", "m"))
    pick = lambda *c: F.element_at(F.array(*(F.col(x) for x in c)), (F.col("id") % 5 + 1).cast("int"))
    return df.select("id", pick("lat", "lon", "ux", "uy", "mx").alias("a"), pick("lon", "lat", "uy", "ux", "my").alias("b"))


_PAIRS_SQL = ("(SELECT id, [lat, lon, ux, uy, mx][id % 5 + 1] AS a, [lon, lat, uy, ux, my][id % 5 + 1] AS b FROM "
              + steps.as_sql(POINTS, [*geodesy.from_geo(25832, "lat", "lon", "ux", "uy", "u"), *geodesy.from_geo(3857, "lat", "lon", "mx", "my", "m")]) + ") AS q")


def crs_detect(spark, sf_dir):
    found = detection.best_reading(_pairs(spark, sf_dir))
    return found.select("id", "n_guesses", "epsg", "swapped", *_r(("confidence", 6), ("lat", 6), ("lon", 6)), (F.coalesce("confidence", F.lit(0.0)) < 0.6).alias("doubtful"))


def _detect_sql():
    stages, readings = detection.detection_stages()
    union = " UNION ALL ".join(f"SELECT id, {i} AS i, {e} AS epsg, {str(s).lower()} AS swapped, t_lat{i} AS lat, t_lon{i} AS lon, t_conf{i} AS conf FROM w" for i, (e, s) in enumerate(readings))
    return f"""
WITH w AS (SELECT * FROM {steps.as_sql(_PAIRS_SQL, stages)}), u AS ({union}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, i) AS k, count(*) OVER (PARTITION BY id) AS n FROM u WHERE conf IS NOT NULL)
SELECT w.id, coalesce(r.n, 0)::INT AS n_guesses, r.epsg, r.swapped, round(r.conf, 6) AS confidence, round(r.lat, 6) AS lat, round(r.lon, 6) AS lon, coalesce(r.conf, 0) < 0.6 AS doubtful
FROM w LEFT JOIN r ON w.id = r.id AND r.k = 1"""


QUERIES["crs_detect"] = crs_detect
ORACLE_SQL["crs_detect"] = _detect_sql()


def crs_interpret(spark, sf_dir):
    at = geodesy.with_projected(points(spark, sf_dir), 25833).select("id", "x", "y")
    return detection.interpret(at, 25833, "x", "y").select("id", *_r(("lat", 6), ("lon", 6), ("confidence", 6)))


QUERIES["crs_interpret"] = crs_interpret
ORACLE_SQL["crs_interpret"] = f"""
SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(CASE WHEN fit > 0 THEN 0.5 + 0.45 * fit END, 6) AS confidence
FROM (SELECT *, {detection.region_fit('lat', 'lon')} AS fit FROM {POINTS}) AS f"""


def tiles_count(spark, sf_dir):
    at = geodesy.with_projected(points(spark, sf_dir), 25832)
    return tiles.with_tile(at, grid_km=2).groupBy("east_km", "north_km").agg(F.count(F.lit(1)).alias("n"))


QUERIES["tiles_count"] = tiles_count
ORACLE_SQL["tiles_count"] = f"""
SELECT (floor(x / 2000) * 2)::INT AS east_km, (floor(y / 2000) * 2)::INT AS north_km, count(*) AS n
FROM {steps.as_sql(POINTS, geodesy.from_geo(25832, "lat", "lon", "x", "y"))} GROUP BY 1, 2"""


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "690000e0 + s_suppkey * 137e0 AS min_x", "5333000e0 + s_suppkey * 91e0 AS min_y",
        "690000e0 + s_suppkey * 137e0 + 500e0 + (s_suppkey % 7) * 400e0 AS max_x", "5333000e0 + s_suppkey * 91e0 + 700e0 AS max_y")


_BOXES = ("(SELECT s_suppkey AS id, 690000e0 + s_suppkey * 137e0 AS min_x, 5333000e0 + s_suppkey * 91e0 AS min_y, "
          "690000e0 + s_suppkey * 137e0 + 500e0 + (s_suppkey % 7) * 400e0 AS max_x, 5333000e0 + s_suppkey * 91e0 + 700e0 AS max_y FROM supplier)")
_COVER = f"""SELECT id, e::INT AS east_km, n::INT AS north_km FROM {_BOXES} AS b,
  unnest(range(floor(min_x / 1000)::BIGINT, ceil(max_x / 1000)::BIGINT)) AS x(e), unnest(range(floor(min_y / 1000)::BIGINT, ceil(max_y / 1000)::BIGINT)) AS y(n)"""


def tiles_for_bbox(spark, sf_dir):
    return tiles.covering_tiles(_boxes(spark, sf_dir)).select("id", "east_km", "north_km")


QUERIES["tiles_for_bbox"] = tiles_for_bbox
ORACLE_SQL["tiles_for_bbox"] = _COVER


def tiles_names(spark, sf_dir):
    t = tiles.covering_tiles(_boxes(spark, sf_dir)).select("east_km", "north_km").distinct()
    name = tiles.tile_name(F.col("east_km"), F.col("north_km"), "32", "_20_DOM")
    e, n = tiles.tile_from_file(F.col("file"))
    ie, in_ = tiles.tile_from_item(F.concat(F.lit("dgm1_32_"), F.col("east_km"), F.lit("_"), F.col("north_km"), F.lit("_1_ni")))
    ce, cn = tiles.odd_even_cell(F.col("east_km"), F.col("north_km"))
    url = tiles.map_request("https://example.org/wms", "dop", F.col("east_km"), F.col("north_km"))
    return t.withColumn("file", name).select("file", e.alias("e"), n.alias("n"), ie.alias("ie"), in_.alias("inn"), ce.alias("cell_e"), cn.alias("cell_n"), url.alias("url"))


QUERIES["tiles_names"] = tiles_names
ORACLE_SQL["tiles_names"] = f"""
SELECT '32' || east_km || '_' || north_km || '_20_DOM.tif' AS file, east_km AS e, north_km AS n, east_km AS ie, north_km AS inn,
  CASE WHEN east_km % 2 = 1 THEN east_km ELSE east_km - 1 END AS cell_e, north_km - north_km % 2 AS cell_n,
  'https://example.org/wms?SERVICE=WMS&VERSION=1.1.1&REQUEST=GetMap&LAYERS=dop&STYLES=&SRS=EPSG:25832&BBOX=' || east_km * 1000 || ',' || north_km * 1000 || ',' || (east_km * 1000 + 1000) || ',' || (north_km * 1000 + 1000) || '&WIDTH=2000&HEIGHT=2000&FORMAT=image/tiff' AS url
FROM (SELECT DISTINCT east_km, north_km FROM ({_COVER}) AS c) AS d"""

WKT = "SRID=25832;POLYGON Z((600000 5300000 1, 760000 5310000 1, 740000 5480000 1, 680000 5400000 1, 610000 5470000 1, 600000 5300000 1))"
_RING = [(600000, 5300000), (760000, 5310000), (740000, 5480000), (680000, 5400000), (610000, 5470000)]


def polygon_contains(spark, sf_dir):
    # x and y come out of a generator, so that the filter does not copy the projection into every edge.
    at = geodesy.with_projected(points(spark, sf_dir), 25832).select("id", F.inline(F.array(F.struct("x", "y"))))
    # The one polygon is read once: as an expression its text would be parsed for every point.
    ring = geometry.ring_from_points([(p["x"], p["y"]) for p in spark.range(1).select(geometry.ring_from_wkt(F.lit(WKT)).alias("r")).first()["r"]])
    return at.filter(geometry.polygon_contains(ring, F.col("x"), F.col("y"))).select("id")


def _contains_sql(x, y):
    edges = [f"(({py}e0 > {y}) <> ({qy}e0 > {y}) AND {x} < {px}e0 + ({qx - px}e0) * ({y} - {py}e0) / {qy - py}e0)::INT" for (px, py), (qx, qy) in zip(_RING, _RING[1:] + _RING[:1])]
    return f"({' + '.join(edges)}) % 2 = 1"


QUERIES["polygon_contains"] = polygon_contains
ORACLE_SQL["polygon_contains"] = f"SELECT id FROM {steps.as_sql(POINTS, geodesy.from_geo(25832, 'lat', 'lon', 'x', 'y'))} WHERE {_contains_sql('x', 'y')}"


def polygon_tiles(spark, sf_dir):
    """Tiles of 10 km that the polygon meets, with the number of points in each."""
    ring = geometry.ring_from_points(_RING)
    box = spark.range(1).selectExpr("600000e0 AS min_x", "5300000e0 AS min_y", "760000e0 AS max_x", "5480000e0 AS max_y")
    cover = tiles.covering_tiles(box, 10).select("east_km", "north_km")
    b = tiles.tile_bounds(F.col("east_km"), F.col("north_km"), F.lit(10))
    cover = cover.filter(geometry.polygon_meets_box(ring, b))
    at = tiles.with_tile(geodesy.with_projected(points(spark, sf_dir), 25832), grid_km=10).groupBy("east_km", "north_km").agg(F.count(F.lit(1)).alias("n"))
    return cover.join(at, ["east_km", "north_km"], "left").select("east_km", "north_km", F.coalesce("n", F.lit(0)).alias("n_points"))


def _meets_sql() -> str:
    """Whether the polygon meets the box (x0, y0, x1, y1): a point or corner inside, or two edges that cross."""
    inside = " OR ".join(f"({px}e0 BETWEEN x0 AND x1 AND {py}e0 BETWEEN y0 AND y1)" for px, py in _RING)
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    corner = " OR ".join(f"({_contains_sql(x, y)})" for x, y in corners)
    turn = lambda o, p, q: f"sign(({p[0]} - {o[0]}) * ({q[1]} - {o[1]}) - ({p[1]} - {o[1]}) * ({q[0]} - {o[0]}))"
    edge = [((f"{a[0]}e0", f"{a[1]}e0"), (f"{b[0]}e0", f"{b[1]}e0")) for a, b in zip(_RING, _RING[1:] + _RING[:1])]
    cross = " OR ".join(
        f"({turn(c, d, a)} * {turn(c, d, b)} < 0 AND {turn(a, b, c)} * {turn(a, b, d)} < 0)" for a, b in edge for c, d in zip(corners, corners[1:] + corners[:1]))
    return f"({inside} OR {corner} OR {cross})"


QUERIES["polygon_tiles"] = polygon_tiles
ORACLE_SQL["polygon_tiles"] = f"""
WITH t AS (SELECT e::INT AS east_km, n::INT AS north_km, e * 1000e0 AS x0, n * 1000e0 AS y0, e * 1000e0 + 10000 AS x1, n * 1000e0 + 10000 AS y1 FROM range(600, 760, 10) AS a(e), range(5300, 5480, 10) AS b(n)),
p AS (SELECT (floor(x / 10000) * 10)::INT AS east_km, (floor(y / 10000) * 10)::INT AS north_km, count(*) AS n FROM {steps.as_sql(POINTS, geodesy.from_geo(25832, "lat", "lon", "x", "y"))} GROUP BY 1, 2)
SELECT t.east_km, t.north_km, coalesce(p.n, 0) AS n_points FROM t LEFT JOIN p USING (east_km, north_km) WHERE {_meets_sql()}"""


def bbox_filter(spark, sf_dir):
    at = points(spark, sf_dir)
    return geometry.bounds(at.filter(geometry.in_box(F.col("lat"), F.col("lon"), (F.lit(48.0), F.lit(8.0), F.lit(50.0), F.lit(11.0)))), "lat", "lon")


QUERIES["bbox_filter"] = bbox_filter
ORACLE_SQL["bbox_filter"] = f"SELECT min(lat) AS min_x, min(lon) AS min_y, max(lat) AS max_x, max(lon) AS max_y FROM {POINTS} WHERE lat BETWEEN 48 AND 50 AND lon BETWEEN 8 AND 11"


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS node", "(p_partkey * 53 % 4000) * 10e0 AS r_min_x", "(p_partkey * 29 % 3000) * 10e0 AS r_min_y",
        "(p_partkey * 53 % 4000) * 10e0 + p_size * 8e0 AS r_max_x", "(p_partkey * 29 % 3000) * 10e0 + p_size * 5e0 AS r_max_y")


def bbox_overlap_join(spark, sf_dir):
    areas = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS area", "(s_suppkey * 331 % 40000) * 1e0 AS l_min_x", "(s_suppkey * 173 % 30000) * 1e0 AS l_min_y",
        "(s_suppkey * 331 % 40000) + 300e0 AS l_max_x", "(s_suppkey * 173 % 30000) + 300e0 AS l_max_y")
    return geometry.overlap_join(areas, _nodes(spark, sf_dir), 500.0).select("area", "node")


QUERIES["bbox_overlap_join"] = bbox_overlap_join
ORACLE_SQL["bbox_overlap_join"] = """
WITH a AS (SELECT s_suppkey AS area, s_suppkey * 331 % 40000 AS x, s_suppkey * 173 % 30000 AS y FROM supplier),
n AS (SELECT p_partkey AS node, (p_partkey * 53 % 4000) * 10 AS x0, (p_partkey * 29 % 3000) * 10 AS y0, (p_partkey * 53 % 4000) * 10 + p_size * 8 AS x1, (p_partkey * 29 % 3000) * 10 + p_size * 5 AS y1 FROM part)
SELECT area, node FROM a JOIN n ON x <= x1 AND x0 <= x + 300 AND y <= y1 AND y0 <= y + 300"""


def node_density(spark, sf_dir):
    """The 15 densest 200 m cells: nodes, mean centre, and the summed size."""
    n = _nodes(spark, sf_dir).withColumns({"cell_x": F.floor(F.col("r_min_x") / 2000), "cell_y": F.floor(F.col("r_min_y") / 2000)})
    return (n.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_min_x"), 4).alias("x"), F.round(F.avg("r_min_y"), 4).alias("y"))
            .orderBy(F.desc("n"), "cell_x", "cell_y").limit(15))


QUERIES["node_density"] = node_density
ORACLE_SQL["node_density"] = """
SELECT floor(x0 / 2000)::BIGINT AS cell_x, floor(y0 / 2000)::BIGINT AS cell_y, count(*) AS n, round(avg(x0), 4) AS x, round(avg(y0), 4) AS y
FROM (SELECT (p_partkey * 53 % 4000) * 10e0 AS x0, (p_partkey * 29 % 3000) * 10e0 AS y0 FROM part) AS n GROUP BY 1, 2 ORDER BY n DESC, cell_x, cell_y LIMIT 15"""
