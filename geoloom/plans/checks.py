"""Queries over pictures, reviews, settings, frame numbers, surfaces as meshes and positions in every system."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps
from geoloom.operators import review, surface
from geoloom.operators.raster import Grid
from geoloom.plans.points import POINTS, points, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _pixels(spark, sf_dir):
    """Pictures of 25 columns with whole steps from 0 to 255; every third one is nearly plain, every fourth one has a bright upper half."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey div 500 AS image", "(o_orderkey % 500) div 25 AS row", "o_orderkey % 25 AS col", *_CHANNELS("div"))


def _CHANNELS(div: str) -> list[str]:
    plain = f"CASE WHEN (o_orderkey {div} 500) % 3 = 0 THEN 16 ELSE 1 END"
    sky = f"CASE WHEN (o_orderkey {div} 500) % 4 = 0 AND o_orderkey % 500 < 250 THEN 80 ELSE 0 END"
    return [f"(o_orderkey * {k} % 160) {div} {plain} + {sky} AS {c}" for c, k in zip("rgb", (37, 91, 13))]


_PIXELS_SQL = f"(SELECT o_orderkey // 500 AS image, (o_orderkey % 500) // 25 AS row, o_orderkey % 25 AS col, {', '.join(_CHANNELS('//'))} FROM orders)"


@query("image_readback", f"""
SELECT image, round(spread, 6) AS spread, greys, spread > 10 AND greys > 50 AS is_real
FROM (SELECT image, greatest(stddev_pop(r), stddev_pop(g), stddev_pop(b)) AS spread, count(DISTINCT (r + g + b) // 3) AS greys FROM {_PIXELS_SQL} AS p GROUP BY image)""")
def image_readback(spark, sf_dir):
    return review.readback(_pixels(spark, sf_dir)).withColumn("spread", F.round("spread", 6))


@query("image_horizon", f"""
WITH p AS (SELECT *, row < (max(row) OVER (PARTITION BY image) + 1) // 2 AS upper_ FROM {_PIXELS_SQL} AS q),
d AS (SELECT image, avg(r) FILTER (upper_) - avg(r) FILTER (NOT upper_) AS r, avg(g) FILTER (upper_) - avg(g) FILTER (NOT upper_) AS g, avg(b) FILTER (upper_) - avg(b) FILTER (NOT upper_) AS b FROM p GROUP BY image)
SELECT image, round(sqrt(r * r + g * g + b * b), 6) AS difference, coalesce(sqrt(r * r + g * g + b * b) >= 30, false) AS visible FROM d""")
def image_horizon(spark, sf_dir):
    return review.horizon(_pixels(spark, sf_dir)).withColumn("difference", F.round("difference", 6))


@query("review_gate", """
WITH c AS (SELECT p_partkey AS slot, p_brand AS hash FROM part), s AS (SELECT p_partkey AS slot, CASE WHEN p_partkey % 9 = 0 THEN 'old' ELSE p_brand END AS hash FROM part WHERE p_partkey % 11 > 0)
SELECT slot, NULL::VARCHAR AS question, 'stale' AS reason FROM c LEFT JOIN s USING (slot) WHERE c.hash IS DISTINCT FROM s.hash
UNION ALL SELECT p_partkey, 'q' || (p_partkey % 3), CASE WHEN p_size % 4 = 3 THEN 'missing' ELSE 'fail: dark' END FROM part WHERE p_size % 2 = 1 AND p_size % 4 <> 1 OR p_size % 2 = 1 AND p_size % 5 = 0""")
def review_gate(spark, sf_dir):
    """Questions of odd sizes are blockers; sizes that leave 3 of 4 have no answer, multiples of 5 a bad one."""
    p = table(spark, sf_dir, "part")
    slot, asked = F.col("p_partkey").alias("slot"), F.concat(F.lit("q"), (F.col("p_partkey") % 3).cast("string")).alias("question")
    current = p.select(slot, F.col("p_brand").alias("hash"))
    stored = p.filter("p_partkey % 11 > 0").select(slot, F.when(F.col("p_partkey") % 9 == 0, "old").otherwise(F.col("p_brand")).alias("hash"))
    questions = p.select(slot, asked, F.when(F.col("p_size") % 2 == 1, "blocker").otherwise("minor").alias("severity"))
    answers = p.filter("p_size % 4 <> 3").select(slot, asked, F.when(F.col("p_size") % 5 == 0, "fail: dark").otherwise("pass").alias("answer"))
    return review.review_gate(current, stored, questions, answers)


@query("settings_report", """
SELECT c_mktsegment AS phase, count(*) AS total, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0) AS passed FROM customer GROUP BY 1""")
def settings_report(spark, sf_dir):
    """Every seventh setting is missing, every fifth has another value."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("phase"), F.col("c_custkey").alias("setting"), F.col("c_nationkey").alias("value"))
    actual = c.filter("setting % 7 <> 0").withColumn("value", F.when(F.col("setting") % 5 == 0, -1).otherwise(F.col("value")))
    return review.settings_report(c, actual)


@query("track_frame_numbers", """
SELECT user_id AS id, event_id, round(1 + (t - min(t) OVER (PARTITION BY user_id)) * 25e0, 3) AS frame FROM (SELECT *, epoch(date_trunc('second', ts)) AS t FROM events)""")
def track_frame_numbers(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).cast("double").alias("t"))
    return review.with_frame_number(samples, 25.0).select("id", "event_id", F.round("frame", 3).alias("frame"))


@query("texture_grid", """
SELECT s_suppkey AS id, least(greatest(1, ceil((s_suppkey * 373 % 14000) / 1000e0)::INT), 10) AS across, greatest(1, ceil((s_suppkey * 911 % 23000) / 1000e0)::INT) AS along FROM supplier""")
def texture_grid(spark, sf_dir):
    s, zero = table(spark, sf_dir, "supplier"), F.lit(0.0)
    across, along = review.texture_grid(zero, zero, F.col("s_suppkey") * 373 % 14000, F.col("s_suppkey") * 911 % 23000)
    return s.select(F.col("s_suppkey").alias("id"), across.alias("across"), along.alias("along"))


#: Cells across of a surface made from orders, and vertices that are left of it at most.
WIDE, MOST = 90, 2000
_SURFACE = f"""c AS (SELECT o_orderkey // {WIDE} AS r, o_orderkey % {WIDE} AS c, o_totalprice AS h FROM orders), g AS (SELECT max(r) + 1 AS rows FROM c),
s AS (SELECT rows, (SELECT min(i) FROM range(1, 100000) AS t(i) WHERE ({WIDE - 1} // i + 1) * ((rows - 1) // i + 1) <= {MOST}) AS n FROM g),
v AS (SELECT (r // n) * ({WIDE - 1} // n + 1) + c // n AS vertex, 500000e0 + c * 10e0 AS x, 5400000e0 - r * 10e0 AS y, h AS height, round(c / {WIDE - 1}e0, 6) AS u, round(1 - r / greatest(rows - 1, 1)::DOUBLE, 6) AS v FROM c, s WHERE r % n = 0 AND c % n = 0)"""


def _surface(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    return orders.selectExpr(f"o_orderkey div {WIDE} AS row", f"o_orderkey % {WIDE} AS col", "o_totalprice AS value"), Grid(WIDE, top // WIDE + 1, 500_000.0, 5_400_000.0, 10.0)


@query("surface_vertices", f"WITH {_SURFACE} SELECT * FROM v")
def surface_vertices(spark, sf_dir):
    found = surface.vertices(*_surface(spark, sf_dir), MOST)
    return found.select("vertex", "x", "y", "height", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("surface_triangles", f"""
WITH {_SURFACE}, t AS (SELECT {WIDE - 1} // n + 1 AS across, (rows - 1) // n + 1 AS along FROM s),
q AS (SELECT i, across, (i // (across - 1)) * across + i % (across - 1) AS a FROM (SELECT across, unnest(range((across - 1) * (along - 1))) AS i FROM t)),
k AS (SELECT i * 2 AS triangle, a, a + 1 AS b, a + across + 1 AS c FROM q UNION ALL SELECT i * 2 + 1, a, a + across + 1, a + across FROM q)
SELECT triangle, a, b, c, round((va.height + vb.height + vc.height) / 3, 4) AS height FROM k JOIN v AS va ON va.vertex = a JOIN v AS vb ON vb.vertex = b JOIN v AS vc ON vc.vertex = c""")
def surface_triangles(spark, sf_dir):
    """Triangles of the thinned orders that have all corners, with their mean height."""
    cells, grid = _surface(spark, sf_dir)
    found = surface.triangles(spark, grid, MOST)
    heights = surface.vertices(cells, grid, MOST).select("vertex", "height")
    for corner in "abc":
        found = found.join(heights.select(F.col("vertex").alias(corner), F.col("height").alias(f"h_{corner}")), corner)
    return found.select("triangle", "a", "b", "c", F.round((F.col("h_a") + F.col("h_b") + F.col("h_c")) / 3, 4).alias("height"))


@query("crs_every_system", " UNION ALL ".join(
    f"SELECT id, {e} AS epsg, round(x, 3) AS x, round(y, 3) AS y FROM " + steps.as_sql(POINTS, geodesy.from_geo(e, "lat", "lon", "x", "y")) for e in geodesy.SHOWN))
def crs_every_system(spark, sf_dir):
    return geodesy.in_every_system(points(spark, sf_dir)).select("id", "epsg", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
