"""Queries over rasters, masks, trajectories and sensors. The raster is derived from `orders`, tracks from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import masks, raster, sensors, trajectory
from geoloom.operators.raster import Grid
from geoloom.plans.points import table

#: Rows of the grid: as many as the orders need at 100 cells a row.
ROWS = "(SELECT max(o_orderkey) // 100 + 1 FROM orders)"
CELLS = ("(SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, max(CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey * 7919 % 1000) * 0.1e0 END) AS value, "
         "o_orderkey % 5 AS class_id FROM orders GROUP BY 1, 2, 4)")
SPOTS = f"(SELECT c_custkey AS id, 499990e0 + (c_custkey * 37 % 10200) * 0.1e0 AS x, 5400020e0 - (c_custkey * 53 % ({ROWS} * 100 + 400)) * 0.1e0 AS y FROM customer)"

QUERIES, ORACLE_SQL = {}, {}


def grid(spark, sf_dir) -> Grid:
    top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return Grid(100, top // 100 + 1, 500_000.0, 5_400_000.0, 10.0)


def cells(spark, sf_dir) -> DataFrame:
    """Orders dealt to the cells of the grid by their keys; a cell holds the highest of its values."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 100 AS row", "o_orderkey % 100 AS col", "CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey * 7919 % 1000) * 0.1e0 END AS value", "o_orderkey % 5 AS class_id")
    return o.groupBy("row", "col", "class_id").agg(F.max("value").alias("value")).select("row", "col", "value", "class_id")


def spots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "499990e0 + (c_custkey * 37 % 10200) * 0.1e0 AS x", f"5400020e0 - (c_custkey * 53 % {grid(spark, sf_dir).height * 100 + 400}) * 0.1e0 AS y")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def bilinear_sql(source: str, key: str = "id", x: str = "x", y: str = "y") -> str:
    """SELECT of key and value: bilinear samples at the source's points."""
    return f"""(WITH c AS (SELECT * FROM {CELLS} AS c0),
s AS (SELECT {key}, least(greatest((5400000e0 - {y}) / 10 - 0.5, 0), {ROWS} - 1) AS fr, least(greatest(({x} - 500000e0) / 10 - 0.5, 0), 99) AS fc FROM {source} AS s0
      WHERE {x} BETWEEN 500000 AND 501000 AND {y} BETWEEN 5400000 - {ROWS} * 10 AND 5400000),
k AS (SELECT *, floor(fr)::BIGINT AS r0, floor(fc)::BIGINT AS c0, least(floor(fr)::BIGINT + 1, {ROWS} - 1) AS r1, least(floor(fc)::BIGINT + 1, 99) AS c1 FROM s)
SELECT {key}, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL AND d.value IS NOT NULL AND e.value IS NOT NULL
  THEN a.value * (1 - (fr - r0)) * (1 - (fc - c0)) + b.value * (1 - (fr - r0)) * (fc - c0) + d.value * (fr - r0) * (1 - (fc - c0)) + e.value * (fr - r0) * (fc - c0)
  ELSE n.value END AS value
FROM k LEFT JOIN c AS a ON a.row = r0 AND a.col = c0 LEFT JOIN c AS b ON b.row = r0 AND b.col = c1 LEFT JOIN c AS d ON d.row = r1 AND d.col = c0
LEFT JOIN c AS e ON e.row = r1 AND e.col = c1 LEFT JOIN c AS n ON n.row = round_even(fr, 0)::BIGINT AND n.col = round_even(fc, 0)::BIGINT)"""


@query("raster_bilinear", f"SELECT p.id, round(v.value, 6) AS value FROM {SPOTS} AS p LEFT JOIN {bilinear_sql(SPOTS)} AS v USING (id)")
def raster_bilinear(spark, sf_dir):
    return raster.bilinear(spots(spark, sf_dir), cells(spark, sf_dir), grid(spark, sf_dir)).select("id", F.round("value", 6).alias("value"))


@query("raster_class_at", f"""
SELECT p.id, c.class_id FROM {SPOTS} AS p LEFT JOIN {CELLS} AS c ON x BETWEEN 500000 AND 501000 AND y BETWEEN 5400000 - {ROWS} * 10 AND 5400000
 AND c.row = least(floor((5400000e0 - y) / 10)::BIGINT, {ROWS} - 1) AND c.col = least(floor((x - 500000e0) / 10)::BIGINT, 99)""")
def raster_class_at(spark, sf_dir):
    return raster.nearest(spots(spark, sf_dir), cells(spark, sf_dir), grid(spark, sf_dir), value="class_id").select("id", F.col("value").alias("class_id"))


_T = f"(SELECT i AS id, 500105e0 + (i % 40) * 7.5e0 + 3.75e0 AS x, 5400000e0 - (i // 40) * 7.5e0 - 3.75e0 AS y FROM (SELECT unnest(range({ROWS} * 40)) AS i))"


@query("raster_regrid", f"SELECT id // 40 AS row, id % 40 AS col, round(value, 6) AS value FROM {_T} AS t LEFT JOIN {bilinear_sql(_T)} AS v USING (id)")
def raster_regrid(spark, sf_dir):
    g = grid(spark, sf_dir)
    return raster.regrid(cells(spark, sf_dir), g, Grid(40, g.height, 500_105.0, 5_400_000.0, 7.5)).select("row", "col", F.round("value", 6).alias("value"))


def _side(dx, dy):
    return bilinear_sql(f"(SELECT id, x + {dx} AS x, y + {dy} AS y FROM {SPOTS} AS q)")


@query("raster_slope_aspect", f"""
WITH g AS (SELECT p.id, (e.value - w.value) / 10 AS dx, (n.value - s.value) / 10 AS dy FROM {SPOTS} AS p LEFT JOIN {_side(5, 0)} AS e USING (id) LEFT JOIN {_side(-5, 0)} AS w USING (id)
 LEFT JOIN {_side(0, 5)} AS n USING (id) LEFT JOIN {_side(0, -5)} AS s USING (id))
SELECT id, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope,
 round(CASE WHEN dx IS NULL OR dy IS NULL THEN NULL WHEN dx = 0 AND dy = 0 THEN 180 ELSE fmod(degrees(atan2(-dx, -dy)) + 360, 360) END, 5) AS aspect FROM g""")
def raster_slope_aspect(spark, sf_dir):
    found = raster.slope_aspect(spots(spark, sf_dir), cells(spark, sf_dir), grid(spark, sf_dir), 5.0)
    return found.select("id", F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"))


_LINES = "(SELECT s_suppkey AS id, 500010e0 + s_suppkey AS x0, 5398510e0 + s_suppkey AS y0, 500900e0 - s_suppkey AS x1, 5399900e0 - s_suppkey AS y1 FROM supplier)"
_ALONG = f"(SELECT id * 100 + i AS id, i, x0 + (x1 - x0) * (i / 24e0) AS x, y0 + (y1 - y0) * (i / 24e0) AS y, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * (i / 24e0) AS distance FROM {_LINES} AS l, range(25) AS t(i))"


@query("raster_profile", f"SELECT id // 100 AS id, i::INT AS i, round(distance, 4) AS distance, round(value, 5) AS value FROM {_ALONG} AS a LEFT JOIN {bilinear_sql(_ALONG)} AS v USING (id)")
def raster_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "500010e0 + s_suppkey AS x0", "5398510e0 + s_suppkey AS y0", "500900e0 - s_suppkey AS x1", "5399900e0 - s_suppkey AS y1")
    return raster.profile(lines, cells(spark, sf_dir), grid(spark, sf_dir), 25).select("id", "i", F.round("distance", 4).alias("distance"), F.round("value", 5).alias("value"))


@query("raster_hillshade", f"""
WITH c AS (SELECT row, col, coalesce(value, 0) AS v FROM {CELLS} AS c0),
n AS (SELECT row, col, lag(v, 1, v) OVER (PARTITION BY row ORDER BY col) - lead(v, 1, v) OVER (PARTITION BY row ORDER BY col) AS nx,
             lead(v, 1, v) OVER (PARTITION BY col ORDER BY row) - lag(v, 1, v) OVER (PARTITION BY col ORDER BY row) AS nz FROM c)
SELECT row, col, round(0.35 + 0.65 * least(greatest((nx * -0.5 + 20 * 0.7 + nz * 0.5) / sqrt(0.99) / sqrt(nx * nx + 400 + nz * nz), 0), 1), 6) AS shade FROM n""")
def raster_hillshade(spark, sf_dir):
    filled = cells(spark, sf_dir).select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return raster.hillshade(filled, 10.0).select("row", "col", F.round("shade", 6).alias("shade"))


@query("raster_statistics", f"SELECT class_id, count(value) AS n_valid, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean FROM {CELLS} AS c GROUP BY 1")
def raster_statistics(spark, sf_dir):
    return raster.statistics(cells(spark, sf_dir), "class_id").withColumn("mean", F.round("mean", 6))


_A, _B = f"(SELECT row, col FROM {CELLS} AS c WHERE class_id < 2)", f"(SELECT row, col FROM {CELLS} AS c WHERE value > 60)"


def _ab(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.filter("class_id < 2"), c.filter("value > 60")


for _name, _op, _sql in (("union", masks.union, "UNION"), ("intersect", masks.intersect, "INTERSECT"), ("subtract", masks.subtract, "EXCEPT")):
    query(f"mask_{_name}", f"SELECT * FROM {_A} AS a {_sql} SELECT * FROM {_B} AS b")(lambda spark, sf_dir, op=_op: op(*_ab(spark, sf_dir)))


@query("mask_invert", f"SELECT i // 100 AS row, i % 100 AS col FROM (SELECT unnest(range({ROWS} * 100)) AS i) EXCEPT SELECT * FROM {_A} AS a")
def mask_invert(spark, sf_dir):
    return masks.invert(_ab(spark, sf_dir)[0], grid(spark, sf_dir))


@query("mask_dilate", f"""
SELECT DISTINCT row + dr AS row, col + dc AS col FROM (SELECT row, col FROM {CELLS} AS c WHERE value > 99) AS a, range(-3, 4) AS r(dr), range(-3, 4) AS q(dc)
WHERE abs(dr) + abs(dc) <= 3 AND row + dr BETWEEN 0 AND {ROWS} - 1 AND col + dc BETWEEN 0 AND 99""")
def mask_dilate(spark, sf_dir):
    return masks.dilate(cells(spark, sf_dir).filter("value > 99"), grid(spark, sf_dir), 25.0)


@query("mask_taller_area", f"SELECT count(*) AS cells, count(*) * 100e0 AS area FROM {CELLS} AS c WHERE value IS NOT NULL AND (col % 7) * 1e0 >= 3")
def mask_taller_area(spark, sf_dir):
    c = cells(spark, sf_dir)
    surface = c.withColumn("value", F.col("value") + (F.col("col") % 7) * 1.0)
    return masks.area(masks.taller_than(surface, c.withColumn("value", F.col("value") * 1.0), 2.5), grid(spark, sf_dir))


_TRACK = "(SELECT user_id AS id, epoch(ts) AS t, value * 1e0 AS x, (event_id % 50) * 2e0 AS y, 100e0 + event_id % 7 AS z, (event_id * 47 % 360) * 1e0 AS yaw, (event_id % 30) - 15e0 AS pitch, (event_id * 91 % 360) - 180e0 AS roll FROM events)"


def track(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t", "value * 1e0 AS x", "(event_id % 50) * 2e0 AS y", "100e0 + event_id % 7 AS z", "(event_id * 47 % 360) * 1e0 AS yaw",
        "(event_id % 30) - 15e0 AS pitch", "(event_id * 91 % 360) - 180e0 AS roll")


@query("track_length", f"""
SELECT id, count(*) AS n, round(sum(sqrt(dx * dx + dy * dy + dz * dz)), 4) AS length FROM (SELECT id, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy, coalesce(z - lag(z) OVER w, 0) AS dz
 FROM {_TRACK} AS t WINDOW w AS (PARTITION BY id ORDER BY t)) AS d GROUP BY id""")
def track_length(spark, sf_dir):
    t = track(spark, sf_dir)
    n = t.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return trajectory.length(t).join(n, "id").select("id", "n", F.round("length", 4).alias("length"))


@query("track_frames", f"""
WITH t AS (SELECT * FROM {_TRACK} AS t0), e AS (SELECT id, min(t) AS t0, max(t) AS t1 FROM t GROUP BY id),
f AS (SELECT id, t0 + i * 3600e0 AS t FROM e, unnest(range(floor((t1 - t0) / 3600)::BIGINT + 1)) AS r(i)),
a AS (SELECT f.id, f.t, s.t AS ta, s.x AS ax, s.yaw AS ayaw, s.roll AS aroll, s.z AS az FROM f ASOF JOIN t AS s ON f.id = s.id AND f.t >= s.t),
b AS (SELECT f.id, f.t, s.t AS bt, s.x AS bx, s.yaw AS byaw, s.roll AS broll, s.z AS bz FROM f ASOF JOIN t AS s ON f.id = s.id AND f.t <= s.t),
p AS (SELECT *, CASE WHEN bt > ta THEN (t - ta) / (bt - ta) ELSE 0 END AS part FROM a JOIN b USING (id, t))
SELECT id, round(t, 3) AS t, round(ax + (bx - ax) * part, 5) AS x, round(az + (bz - az) * part, 5) AS z,
 round(ayaw + (fmod(fmod(byaw - ayaw + 180, 360) + 360, 360) - 180) * part, 5) AS yaw, round(aroll + (fmod(fmod(broll - aroll + 180, 360) + 360, 360) - 180) * part, 5) AS roll FROM p""")
def track_frames(spark, sf_dir):
    t = track(spark, sf_dir)
    found = trajectory.poses_at(t, trajectory.frames(t, 3600.0))
    return found.select("id", F.round("t", 3).alias("t"), *(F.round(c, 5).alias(c) for c in ("x", "z", "yaw", "roll")))


_Q = "(SELECT vec_id AS id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS d FROM embeddings)"


def _unit(i):
    size = F.sqrt(sum(F.col("embedding")[k + i].cast("double") ** 2 for k in range(4)))
    return trajectory.quaternion(*(F.col("embedding")[k + i].cast("double") / size for k in range(4)))


@query("quaternion_slerp", """
WITH e AS (SELECT vec_id AS id, [embedding[k]::DOUBLE FOR k IN [1, 2, 3, 4]] AS p0, [embedding[k]::DOUBLE FOR k IN [5, 6, 7, 8]] AS q0 FROM embeddings),
u AS (SELECT id, [v / sqrt(list_sum([w * w FOR w IN p0])) FOR v IN p0] AS p, [v / sqrt(list_sum([w * w FOR w IN q0])) FOR v IN q0] AS q FROM e),
d AS (SELECT *, p[1] * q[1] + p[2] * q[2] + p[3] * q[3] + p[4] * q[4] AS dot FROM u),
a AS (SELECT *, acos(least(abs(dot), 1)) AS ang FROM d)
SELECT id, round(sin(0.7 * ang) / sin(ang) * p[1] + sin(0.3 * ang) / sin(ang) * sign(dot) * q[1], 6) AS x,
 round(sin(0.7 * ang) / sin(ang) * p[4] + sin(0.3 * ang) / sin(ang) * sign(dot) * q[4], 6) AS w FROM a""")
def quaternion_slerp(spark, sf_dir):
    q = trajectory.slerp(_unit(0), _unit(4), F.lit(0.3))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").select(F.col("vec_id").alias("id"), q.alias("q")).select("id", F.round("q.x", 6).alias("x"), F.round("q.w", 6).alias("w"))


@query("attitude_round_trip", """
SELECT s_suppkey AS id, round((s_suppkey * 47 % 360) - 179e0, 4) AS yaw, round((s_suppkey * 13 % 170) - 84e0, 4) AS pitch, round((s_suppkey * 91 % 360) - 179e0, 4) AS roll FROM supplier""")
def attitude_round_trip(spark, sf_dir):
    """Angles to a quaternion and back."""
    df = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "(s_suppkey * 47 % 360) - 179e0 AS y0", "(s_suppkey * 13 % 170) - 84e0 AS p0", "(s_suppkey * 91 % 360) - 179e0 AS r0")
    df = df.select("id", trajectory.rotation(F.col("y0"), F.col("p0"), F.col("r0")).alias("q"))
    return trajectory.with_euler(df).select("id", *(F.round(c, 4).alias(c) for c in ("yaw", "pitch", "roll")))


def _hills(spark) -> tuple[DataFrame, Grid]:
    """Plain ground at 100 with a ridge at 140, as wide as the flights below need."""
    g = Grid(200, 200, 500_000.0, 5_400_200.0, 1.0)
    return g.cells(spark).withColumn("value", F.when(F.col("col").between(95, 105), 140.0).otherwise(100.0)), g


def _poses(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "500020e0 + s_suppkey % 12 * 5 AS x", "5400100e0 AS y", "160e0 AS z", "90e0 AS yaw", "0e0 AS pitch", "0e0 AS roll")


@query("sensor_coverage")
def sensor_coverage(spark, sf_dir):
    """Cells seen by a cone, a pyramid and a cylinder from each pose, with occlusion."""
    cells_, g = _hills(spark)
    poses = _poses(spark, sf_dir)
    kinds = {"cone": sensors.cone_rays(poses, 9, 25, (0, -60, 0)), "pyramid": sensors.pyramid_rays(poses, 8, mount=(0, -50, 0)), "cylinder": sensors.cylinder_rays(poses, 9, 15.0)}
    found = None
    for kind, rays in kinds.items():
        hits = sensors.hit_ground(rays.withColumn("ray_id", F.struct("id", "ray")), cells_, g, 500.0)
        seen = sensors.seen_cells(hits, g).withColumn("sensor", F.lit(kind))
        found = seen if found is None else found.unionByName(seen)
    return found


@query("sensor_boresight", "SELECT s_suppkey AS id, 500020e0 + s_suppkey % 12 * 5 AS x, 5400100e0 AS y, 100e0 AS z FROM supplier")
def sensor_boresight(spark, sf_dir):
    """Ground straight below each pose."""
    cells_, g = _hills(spark)
    rays = sensors.boresight(_poses(spark, sf_dir)).withColumn("ray_id", F.col("id"))
    hits = sensors.hit_ground(rays, cells_, g, 500.0)
    return hits.select("id", F.round("hit_x", 4).alias("x"), F.round("hit_y", 4).alias("y"), F.round("hit_z", 4).alias("z"))


@query("sensor_line_of_sight", "SELECT s_suppkey AS id, s_suppkey % 60 * 3 > 44 AS visible FROM supplier")
def sensor_line_of_sight(spark, sf_dir):
    """Whether two points on either side of the ridge, ever higher, see each other."""
    cells_, g = _hills(spark)
    pairs = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "500050e0 AS x", "5400100e0 AS y", "96e0 + s_suppkey % 60 * 3 AS z", "500150e0 AS tx", "5400100e0 AS ty", "96e0 + s_suppkey % 60 * 3 AS tz")
    return sensors.can_see(pairs, cells_, g).select("id", "visible")
