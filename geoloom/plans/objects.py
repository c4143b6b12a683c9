"""Queries over rules, meshes, pictures, documents with coordinates, catalogues and text formats."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators import catalog, imagery, jsoncoords, rules
from geoloom.plans.points import points, table
from geoloom.sources import formats, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


RULES = [("metal/small", {"name_regex": "^[a-m]", "prop": {"name": "size", "in": ["1", "2", "3"]}}), ("brand", {"prop": {"name": "brand", "regex": "#[12]"}}),
         ("steel", {"material_regex": "STEEL"}), ("rest", {"prop": {"name": "size", "exists": True}})]


@query("rules_first_match", """
SELECT CASE WHEN regexp_matches(p_name, '^[a-m]') AND p_size IN (1, 2, 3) THEN 'metal/small' WHEN regexp_matches(p_brand, '#[12]') THEN 'brand'
 WHEN regexp_matches(p_type, 'STEEL') THEN 'steel' ELSE 'rest' END AS collection, count(*) AS n FROM part GROUP BY 1""")
def rules_first_match(spark, sf_dir):
    props = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    target = rules.first_match(RULES, F.col("p_name"), F.col("p_type"), props)
    return table(spark, sf_dir, "part").select(target.alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("mesh_collapse", """
WITH m AS (SELECT p_partkey AS mesh, substr(sha1(concat_ws('|', p_size, p_size * 2, p_size % 7, printf('%.6f', p_size * 0.5e0) || ',' || printf('%.6f', (p_partkey % 3) * 1e0) || ',0.000000')), 1, 16) AS signature FROM part)
SELECT mesh, signature, min(mesh) OVER (PARTITION BY signature) AS canonical, count(*) OVER (PARTITION BY signature) AS copies FROM m""")
def mesh_collapse(spark, sf_dir):
    size = F.col("p_size")
    first = (size * 0.5, (F.col("p_partkey") % 3) * 1.0, F.lit(0.0))
    meshes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh"), rules.mesh_signature(size, size * 2, size % 7, first).alias("signature"))
    return rules.collapse_meshes(meshes)


@query("material_missing", "SELECT DISTINCT p_brand AS material FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 49")
def material_missing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), "p_size")
    return rules.missing_names(p, p.filter("p_size > 49").distinct())


def _mesh(k):
    """A binary mesh of nine corners: (k * 7 + i * 13) % 100 as 32-bit floats, behind two counts."""
    floats = F.array(*(F.lit(struct.pack("<f", v).hex()) for v in range(100)))
    corners = (F.element_at(floats, ((k * 7 + i * 13) % 100 + 1).cast("int")) for i in range(27))
    return F.unhex(F.concat(F.lit(struct.pack("<II", 9, 3).hex()), *corners))


_C = lambda i: f"((s_suppkey * 7 + (9 * t + {i}) * 13) % 100)"


@query("mesh_clip", f"""
SELECT s_suppkey AS node, count(*) AS n FROM supplier, range(3) AS r(t)
WHERE ({_C(0)} + {_C(3)} + {_C(6)}) / 3e0 BETWEEN 20 AND 60 AND ({_C(1)} + {_C(4)} + {_C(7)}) / 3e0 BETWEEN 20 AND 60 GROUP BY 1""")
def mesh_clip(spark, sf_dir):
    """Triangles decoded from binary meshes whose centroid lies in the area, counted by mesh."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), _mesh(F.col("s_suppkey")).alias("data"))
    return rules.in_area(rules.decode_triangles(nodes), (20.0, 20.0, 60.0, 60.0)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def _pixels(spark, sf_dir, shift: int = 0):
    """Pictures of 25 columns from the keys of orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 500 AS image", "(o_orderkey % 500) div 25 AS row", "o_orderkey % 25 AS col",
        f"((o_orderkey * 37 + {shift}) % 256) / 255e0 AS r", "((o_orderkey * 91) % 256) / 255e0 AS g", "((o_orderkey * 13 + o_orderkey div 500) % 256) / 255e0 AS b")


def _pixels_sql(shift: int = 0) -> str:
    return (f"(SELECT o_orderkey // 500 AS image, (o_orderkey % 500) // 25 AS row, o_orderkey % 25 AS col, ((o_orderkey * 37 + {shift}) % 256) / 255e0 AS r, "
            "((o_orderkey * 91) % 256) / 255e0 AS g, ((o_orderkey * 13 + o_orderkey // 500) % 256) / 255e0 AS b FROM orders)")


_HUE = """(WITH p AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, max(row) OVER (PARTITION BY image) + 1 AS h FROM {src} AS p0)
SELECT *, r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0 AS lum, row >= h // 2 AS lower_,
 fmod(CASE WHEN mx = mn THEN 0 WHEN mx = r THEN fmod((g - b) / (mx - mn) + 6, 6) WHEN mx = g THEN (b - r) / (mx - mn) + 2 ELSE (r - g) / (mx - mn) + 4 END / 6, 1) AS hue FROM p)"""


@query("image_summary", f"""
SELECT image, round(avg(CASE WHEN lower_ THEN (NOT (hue BETWEEN {imagery.SKY[0]} AND {imagery.SKY[1]} AND b > r AND b > g) AND lum <= 0.92)::INT END), 6) AS ground_pixel_ratio,
 round(var_pop(CASE WHEN lower_ THEN lum END), 6) AS ground_luminance_variance, round(avg(b) / greatest(avg(lum), 1e-6), 6) AS blue_dominance, round(avg(lum), 6) AS mean_luminance
FROM {_HUE.format(src=_pixels_sql())} AS p GROUP BY image""")
def image_summary(spark, sf_dir):
    s = imagery.summary(_pixels(spark, sf_dir))
    return s.select("image", *(F.round(c, 6).alias(c) for c in s.columns if c != "image"))


@query("image_diversity", f"""
SELECT image, count(DISTINCT CASE WHEN mx - mn > 0.05e0 THEN floor(hue * 24)::BIGINT % 24 END) AS hues, round(avg((g > r * 1.1e0 AND g > b * 1.1e0 AND g > 0.15e0)::INT), 6) AS green_ratio
FROM {_HUE.format(src=_pixels_sql())} AS p GROUP BY image""")
def image_diversity(spark, sf_dir):
    return imagery.diversity(_pixels(spark, sf_dir)).withColumn("green_ratio", F.round("green_ratio", 6))


@query("image_verdict", f"""
WITH p AS (SELECT *, max(row) OVER (PARTITION BY image) + 1 AS h FROM {_pixels_sql()} AS p0),
q AS (SELECT image, row, col, round(r * 255)::INT AS r, round(g * 255)::INT AS g, round(b * 255)::INT AS b FROM p WHERE row >= h // 2),
l AS (SELECT *, (r + g + b) / 3e0 AS luma FROM q),
e AS (SELECT *, abs(lead(luma) OVER (PARTITION BY image, row ORDER BY col) - luma) + abs(lead(luma) OVER (PARTITION BY image, col ORDER BY row) - luma) AS edge FROM l),
a AS (SELECT image, count(DISTINCT (r // 32) * 4096 + (g // 32) * 64 + b // 32) AS unique_hues, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS rgb_std, avg((edge > 12)::INT) AS edge_density FROM e GROUP BY image)
SELECT image, unique_hues, round(rgb_std, 4) AS rgb_std, round(edge_density, 6) AS edge_density,
 CASE WHEN rgb_std < 6 AND unique_hues < 25 THEN 'EMPTY' WHEN unique_hues >= 60 AND rgb_std >= 18 AND edge_density >= 0.06 THEN 'GROUND_VISIBLE' ELSE 'FLAT' END AS verdict FROM a""")
def image_verdict(spark, sf_dir):
    return imagery.verdicts(_pixels(spark, sf_dir)).select("image", "unique_hues", F.round("rgb_std", 4).alias("rgb_std"), F.round("edge_density", 6).alias("edge_density"), "verdict")


@query("image_rmse", f"""
SELECT image, round(sqrt(avg((a.r - b.r) ** 2 / 3)), 6) AS rmse FROM {_pixels_sql()} AS a JOIN {_pixels_sql(9)} AS b USING (image, row, col) GROUP BY image""")
def image_rmse(spark, sf_dir):
    return imagery.rmse(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 9)).withColumn("rmse", F.round("rmse", 6))


@query("metrics_out_of_tolerance", "SELECT key, actual, golden FROM (SELECT s_suppkey AS key, s_suppkey * 1.1e0 AS golden, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * (1 + (s_suppkey % 4) * 0.1e0) END AS actual FROM supplier) WHERE actual IS NULL OR abs(actual - golden) / greatest(abs(golden), 1e-9) > 0.15")
def metrics_out_of_tolerance(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    golden = s.selectExpr("s_suppkey AS key", "s_suppkey * 1.1e0 AS value")
    actual = s.filter("s_suppkey % 5 > 0").selectExpr("s_suppkey AS key", "s_suppkey * (1 + (s_suppkey % 4) * 0.1e0) AS value")
    return imagery.out_of_tolerance(actual, golden, 0.15).select("key", "actual", "golden")


@query("json_coordinates", """
WITH p AS (SELECT c_custkey AS id, 47.3e0 + (c_custkey % 800) * 0.01e0 AS lat, 6.0e0 + ((c_custkey * 7) % 900) * 0.01e0 AS lon FROM customer)
SELECT id, '$.site' AS path, 'geo' AS kind, 4326 AS epsg, round(lat, 5) AS lat, round(lon, 5) AS lon, 520.5e0 AS z FROM p
UNION ALL SELECT id, '$.list[0].at', 'bare', 4326, round(lat, 5), round(lon, 5), NULL FROM p
UNION ALL SELECT id, '$.utm', 'named', 25832, round(lat, 5), round(lon, 5), NULL FROM p""")
def json_coordinates(spark, sf_dir):
    at = geodesy.with_projected(points(spark, sf_dir), 25832)
    text = F.concat(F.lit('{/* site */ "size": [1, 2], "site": {"Lat": "'), F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(",")), F.lit('", "LON": '), F.col("lon").cast("string"),
                    F.lit(', "hoehe": "520,5"}, "list": [{"at": ['), F.col("lon").cast("string"), F.lit(", "), F.col("lat").cast("string"), F.lit(']}], "utm": {"Rechtswert": '),
                    F.col("x").cast("string"), F.lit(', "Hochwert": '), F.col("y").cast("string"), F.lit(",},}"))
    found = jsoncoords.find_coordinates(at.select("id", text.alias("json")))
    return found.select("id", "path", "kind", "epsg", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "z")


_STATES = "(VALUES " + ", ".join(f"({i}, '{s}', {z}, {g})" for i, (s, z, g, _) in enumerate(catalog.STATES)) + ") AS s(i, state, zone, grid_km)"
_DATASETS = "(VALUES " + ", ".join(f"('{s}', {i}, '{d}')" for s, _, _, ds in catalog.STATES for i, d in enumerate(ds)) + ") AS d(state, rank, dataset)"
_SURFACES = "(VALUES " + ", ".join(f"('{s}', {next((repr(x) for x in catalog.SURFACES if x in ds), 'NULL')})" for s, _, _, ds in catalog.STATES) + ") AS f(state, surface)"


def _by_state(spark, sf_dir):
    """Suppliers dealt to the states in their order."""
    names = F.array(*(F.lit(s) for s, *_ in catalog.STATES))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % len(catalog.STATES)).cast("int")).alias("state"))


@query("catalog_datasets", f"SELECT s_suppkey, s.state, zone, grid_km, rank, dataset FROM supplier JOIN {_STATES} ON s_suppkey % {len(catalog.STATES)} = s.i JOIN {_DATASETS} ON s.state = d.state")
def catalog_datasets(spark, sf_dir):
    """The datasets of the state that each supplier is dealt to, in order of preference."""
    return _by_state(spark, sf_dir).join(catalog.datasets(spark), "state").select("s_suppkey", "state", "zone", "grid_km", "rank", "dataset")


@query("catalog_surface", f"SELECT s_suppkey, s.state, surface FROM supplier JOIN {_STATES} ON s_suppkey % {len(catalog.STATES)} = s.i JOIN {_SURFACES} ON s.state = f.state")
def catalog_surface(spark, sf_dir):
    """The surface model of the state that each supplier is dealt to."""
    return _by_state(spark, sf_dir).join(catalog.surface_dataset(spark), "state").select("s_suppkey", "state", "surface")


@query("catalog_jobs", """
SELECT (690 + s_suppkey)::INT AS east_km, (5330 + s_suppkey % 9)::INT AS north_km, '32' || (690 + s_suppkey) || '_' || (5330 + s_suppkey % 9) || '_20_DOM.tif' AS file,
 'https://a.example.org/dom/32' || (690 + s_suppkey) || '_' || (5330 + s_suppkey % 9) || '_20_DOM.tif' AS first_mirror, 2 AS n FROM supplier""")
def catalog_jobs(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").selectExpr("CAST(690 + s_suppkey AS INT) AS east_km", "CAST(5330 + s_suppkey % 9 AS INT) AS north_km")
    j = catalog.jobs(t, "by", "dom20", ["https://a.example.org/dom/", "https://b.example.org/dom"])
    return j.select("east_km", "north_km", "file", F.get("mirrors", F.lit(0)).alias("first_mirror"), F.size("mirrors").alias("n"))


@query("catalog_newest_per_tile", """
WITH i AS (SELECT 'item' || lpad(o_orderkey::VARCHAR, 8, '0') AS id, o_custkey % 100 AS tile, CASE WHEN o_orderkey % 11 <> 0 THEN date_trunc('month', o_orderdate) END AS taken FROM orders)
SELECT tile, id FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY taken DESC NULLS LAST, id) AS k FROM i) AS r WHERE k = 1""")
def catalog_newest_per_tile(spark, sf_dir):
    items = table(spark, sf_dir, "orders").selectExpr(
        "concat('item', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS id", "o_custkey % 100 AS tile", "CASE WHEN o_orderkey % 11 <> 0 THEN date_trunc('month', o_orderdate) END AS taken")
    return formats.newest_per_tile(items, ["tile"]).select("tile", "id")


@query("catalog_url_index", """
SELECT (500 + s_suppkey % 400)::INT AS east_km, (5700 + s_suppkey * 3 % 8)::INT AS north_km,
 'dgm1_32_' || (500 + s_suppkey % 400) || '_' || (5700 + s_suppkey * 3 % 8) || '_1_nw_' || (2000 + max_by(s_suppkey * 7 % 90, s_suppkey)) || '.tif' AS url FROM supplier GROUP BY s_suppkey % 400, s_suppkey * 3 % 8""")
def catalog_url_index(spark, sf_dir):
    """Pages of 50 suppliers' links each; of one tile the last page's last link counts."""
    k, e, n = F.col("s_suppkey"), F.col("s_suppkey") % 400 + 500, F.col("s_suppkey") * 3 % 8 + 5700
    text = lambda c: c.cast("string")
    link = F.concat(F.lit("<a href=\"dgm1_32_"), text(e), F.lit("_"), text(n), F.lit("_1_nw_"), text(k * 7 % 90 + 2000), F.lit(".tif\">"))
    links = table(spark, sf_dir, "supplier").select(F.floor(k / 50).alias("page"), k.alias("k"), link.alias("a"))
    pages = links.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"]), "\n").alias("value"))
    return formats.url_index(pages, r"(dgm1_32_(\d{3})_(\d{4})_1_nw_\d{4}\.tif)", order="page")


@query("numbers_parse", """
SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey + 0.5e0 WHEN 1 THEN s_suppkey + 0.25e0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE s_suppkey * 1000e0 END AS v FROM supplier""")
def numbers_parse(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.element_at(F.array(F.concat(k, F.lit(",5")), F.concat(F.lit(" "), k, F.lit(".25 ")), F.concat(k, F.lit("d")), F.concat(F.lit("1,"), k, F.lit(".5")), F.concat(k, F.lit("e3"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), formats.number(text).alias("v"))


@query("geojson_export", """
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.1f', 1.5e0 + s_suppkey) || ',' || printf('%.1f', 2.5e0 + s_suppkey) || ']},"properties":{"id":' || s_suppkey || '}}' AS value FROM supplier""")
def geojson_export(spark, sf_dir):
    return sinks.geojson_features(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "2.5e0 + s_suppkey AS lat", "1.5e0 + s_suppkey AS lon"), properties=["id"])
