"""Boxes and polygons. A polygon is an array<struct<x double, y double>> ring without its closing point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def in_box(x: Column, y: Column, box: tuple) -> Column:
    """Inclusive on all sides."""
    min_x, min_y, max_x, max_y = box
    return x.between(min_x, max_x) & y.between(min_y, max_y)


def boxes_meet(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def ring_from_points(points: list[tuple[float, float]]) -> Column:
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    if len(points) < 3:
        raise ValueError("a polygon needs three points")
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def ring_from_box(min_x, min_y, max_x, max_y) -> Column:
    c = lambda v: F.lit(v).cast("double") if not isinstance(v, Column) else v
    corner = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    return F.array(corner(min_x, min_y), corner(max_x, min_y), corner(max_x, max_y), corner(min_x, max_y))


def ring_from_wkt(text: Column) -> Column:
    """First ring of a (E)WKT polygon; a z is dropped, and so is the closing point; null where there is none."""
    ring = F.regexp_extract(text, r"(?is)polygon\s*z?m?\s*\(\s*\(([^)]*)\)", 1)
    points = F.transform(F.split(F.trim(ring), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(points, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y")))
    return F.when(ring != "", open_ring(points))


def ring_from_kml(text: Column) -> Column:
    """lon/lat points (x, y) of the first <coordinates> element, whatever its namespace."""
    body = F.xpath_string(text, F.lit("//*[local-name()='coordinates']"))
    points = F.transform(F.filter(F.split(F.trim(body), r"\s+"), lambda p: F.size(F.split(p, ",")) >= 2), lambda p: F.split(p, ","))
    return open_ring(F.transform(points, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))))


def open_ring(ring: Column) -> Column:
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, n - 1)).otherwise(ring)




def polygon_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the east crosses an odd number of edges."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda p, q: F.when(
        ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda n, c: n + c) % 2 == 1


def _turn(ox, oy, px, py, qx, qy) -> Column:
    return (px - ox) * (qy - oy) - (py - oy) * (qx - ox)


def polygon_meets_box(ring: Column, box: tuple) -> Column:
    """Overlap of bounds, then a point inside, a corner inside, or two edges that properly cross."""
    x0, y0, x1, y1 = box
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    opposite = lambda a, b: ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))

    def crosses(p, q):
        found = F.lit(False)
        for (cx, cy), (dx, dy) in zip(corners, corners[1:] + corners[:1]):
            found = found | (opposite(_turn(cx, cy, dx, dy, p["x"], p["y"]), _turn(cx, cy, dx, dy, q["x"], q["y"]))
                             & opposite(_turn(p["x"], p["y"], q["x"], q["y"], cx, cy), _turn(p["x"], p["y"], q["x"], q["y"], dx, dy)))
        return found

    low = lambda c: F.array_min(F.transform(ring, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(ring, lambda p: p[c]))
    near = boxes_meet((low("x"), low("y"), high("x"), high("y")), box)
    inside = F.exists(ring, lambda p: in_box(p["x"], p["y"], box))
    corner = F.lit(False)
    for cx, cy in corners:
        corner = corner | polygon_contains(ring, cx, cy)
    return near & (inside | corner | F.exists(F.zip_with(ring, after, crosses), lambda c: c))


def bounds(df: DataFrame, x: str = "x", y: str = "y", *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def overlap_join(left: DataFrame, right: DataFrame, cell: float, left_box=("l_min_x", "l_min_y", "l_max_x", "l_max_y"), right_box=("r_min_x", "r_min_y", "r_max_x", "r_max_y")) -> DataFrame:
    """Pairs of boxes that meet. Both sides are dealt to grid cells and meet in an equi-join; a pair that
    shares several cells is reported from the one that holds the lower left corner of its overlap."""
    def dealt(df, box):
        for axis, lo, hi in (("cx", box[0], box[2]), ("cy", box[1], box[3])):
            df = df.withColumn(axis, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
        return df

    a, b = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    home = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("cy"))
    return dealt(left, left_box).join(dealt(right, right_box), ["cx", "cy"]).filter(boxes_meet(a, b) & home).drop("cx", "cy")
