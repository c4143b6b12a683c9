"""Rasters as cell tables (row, col, value): sampling, regridding, slope, profiles, shading.

Row 0 is north; the origin is the outer corner of the north-west pixel. A cell without data has a
null value or no row. Sampling is an equi-join on the cell, so neither side has to fit anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators import tiles

#: Strips in which the columns of a raster are ordered.
STRIPS = 4096


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    origin_x: float
    origin_y: float
    pixel: float

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.origin_x, self.origin_y - self.height * self.pixel, self.origin_x + self.width * self.pixel, self.origin_y

    def contains(self, x: Column, y: Column) -> Column:
        x0, y0, x1, y1 = self.bounds
        return x.between(x0, x1) & y.between(y0, y1)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) by floor."""
        return F.floor((self.origin_y - y) / self.pixel), F.floor((x - self.origin_x) / self.pixel)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        """(x, y) of a cell's centre."""
        return self.origin_x + (col + 0.5) * self.pixel, self.origin_y - (row + 0.5) * self.pixel

    def fraction(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) in pixel centres, kept within the outermost ones."""
        keep = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
        return keep((self.origin_y - y) / self.pixel - 0.5, self.height), keep((x - self.origin_x) / self.pixel - 0.5, self.width)

    def cells(self, spark) -> DataFrame:
        n = spark.range(self.width * self.height)
        return n.select(F.floor(F.col("id") / self.width).alias("row"), (F.col("id") % self.width).alias("col"))


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid, x: str = "x", y: str = "y", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """points with `value`: bilinear between four centres; with a gap among them the nearest centre; null outside.

    Places are looked up, not rows, so any number of rows may share one. With `by`, points and cells
    meet only where these columns are equal.
    """
    fr, fc = grid.fraction(F.col(x), F.col(y))
    inside = grid.contains(F.col(x), F.col(y))
    placed = points.withColumns({"__fr": F.when(inside, fr), "__fc": F.when(inside, fc)})
    r0, c0 = F.floor("__fr"), F.floor("__fc")
    corner = lambda dr, dc, w: F.struct(
        F.least(r0 + dr, F.lit(grid.height - 1)).alias("row"), F.least(c0 + dc, F.lit(grid.width - 1)).alias("col"), w.alias("w"))
    wr, wc = F.col("__fr") - r0, F.col("__fc") - c0
    corners = F.array(corner(0, 0, (1 - wr) * (1 - wc)), corner(0, 1, (1 - wr) * wc), corner(1, 0, wr * (1 - wc)), corner(1, 1, wr * wc))
    asked = placed.filter("__fr is not null").select(*by, "__fr", "__fc", F.inline(corners))
    near = (F.col("row") == F.rint("__fr")) & (F.col("col") == F.rint("__fc"))
    joined = asked.join(cells.select(*by, "row", "col", F.col(value).cast("double").alias("__v")), [*by, "row", "col"], "left")
    # Four rows for each row that asks for the place.
    rows = F.count(F.lit(1))
    found = joined.groupBy(*by, "__fr", "__fc").agg(
        F.when(F.count("__v") == rows, F.sum(F.col("w") * F.col("__v")) / (rows / 4)).otherwise(F.max(F.when(near, F.col("__v")))).alias("value"))
    return placed.join(found, [*by, "__fr", "__fc"], "left").drop("__fr", "__fc")


def tiled(points: DataFrame, cells: DataFrame, grid_km: int, pixel: float, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """points with their tile (east_km, north_km) and `value`, sampled in the raster of that tile.

    cells: east_km, north_km (south-west corner of the tile), row, col and value, of any number of tiles.
    """
    n = round(grid_km * 1000 / pixel)
    at = tiles.with_tile(points, x, y, grid_km).drop("grid_km")
    at = at.withColumns({"__tx": F.col(x) - F.col("east_km") * 1000.0, "__ty": F.col(y) - F.col("north_km") * 1000.0})
    return bilinear(at, cells, Grid(n, n, 0.0, grid_km * 1000.0, pixel), "__tx", "__ty", value, ("east_km", "north_km")).drop("__tx", "__ty")


def elevation(points: DataFrame, cells: DataFrame, grid_km: int, pixel: float, epsg: int = 25832, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points (lat, lon) with x and y in the tiles' system, the tile and `value`."""
    return tiled(geodesy.with_projected(points, epsg, lat, lon), cells, grid_km, pixel)


def mosaic(cells: DataFrame, grid_km: int, pixel: float, target: Grid) -> DataFrame:
    """(row, col, value) of the target grid, each cell sampled at its centre in the tile that it lies in."""
    x, y = target.centre(F.col("row"), F.col("col"))
    spots = target.cells(cells.sparkSession).withColumns({"x": x, "y": y})
    return tiled(spots, cells, grid_km, pixel).select("row", "col", "value")


def nearest(points: DataFrame, cells: DataFrame, grid: Grid, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """points with `value` of the pixel they lie in; null outside or without data."""
    row, col = grid.cell(F.col(x), F.col(y))
    inside = grid.contains(F.col(x), F.col(y))
    keys = points.withColumns({
        "row": F.when(inside, F.least(row, F.lit(grid.height - 1))), "col": F.when(inside, F.least(col, F.lit(grid.width - 1)))})
    return keys.join(cells.select("row", "col", F.col(value).alias("value")), ["row", "col"], "left").drop("row", "col")


def regrid(cells: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """(row, col, value) of the target grid, sampled at its centres."""
    x, y = target.centre(F.col("row"), F.col("col"))
    spots = target.cells(cells.sparkSession).withColumns({"x": x, "y": y})
    return bilinear(spots, cells, grid).select("row", "col", "value")


def slope_aspect(points: DataFrame, cells: DataFrame, grid: Grid, step: float = 1.0, key: str = "id") -> DataFrame:
    """key, slope and aspect (degrees, downhill, clockwise from north) from central differences; null where a neighbour is."""
    around = F.array(*(F.struct(F.lit(n).alias("side"), (F.col("x") + dx * step).alias("sx"), (F.col("y") + dy * step).alias("sy"))
                       for n, dx, dy in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1))))
    spots = points.select(F.col(key).alias("__key"), F.inline(around)).withColumn("id", F.struct("__key", "side"))
    at = bilinear(spots.select("id", "sx", "sy"), cells, grid, "sx", "sy")
    side = lambda s: F.max(F.when(F.col("id.side") == s, F.col("value")))
    sides = at.groupBy(F.col("id.__key").alias(key)).agg(*(side(s).alias(s) for s in "ewns"))
    dx, dy = (F.col("e") - F.col("w")) / (2 * step), (F.col("n") - F.col("s")) / (2 * step)
    aspect = F.when((dx == 0) & (dy == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(-dx, -dy)) + 360.0, F.lit(360.0)))
    return sides.select(key, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), F.when(dx.isNotNull() & dy.isNotNull(), aspect).alias("aspect"))


def profile(lines: DataFrame, cells: DataFrame, grid: Grid, samples: int, key: str = "id") -> DataFrame:
    """key, i, x, y, distance, value: evenly spaced points of each line (x0, y0, x1, y1), both ends included."""
    if samples < 2:
        raise ValueError("a profile needs two samples")
    t = F.col("i") / F.lit(float(samples - 1))
    spots = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    spots = spots.withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * t, "y": F.col("y0") + (F.col("y1") - F.col("y0")) * t,
                               "distance": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * t})
    found = bilinear(spots.select(key, "i", "x", "y", "distance"), cells, grid)
    return found.select(key, "i", "x", "y", "distance", "value")


def hillshade(cells: DataFrame, pixel: float, light: tuple[float, float, float] = (-0.5, 0.7, 0.5)) -> DataFrame:
    """cells with shade: 0.35 and up to 0.65 by the angle between the surface and the light; edges repeat."""
    size = sum(v * v for v in light) ** 0.5
    lx, ly, lz = (v / size for v in light)
    along, across = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    side = lambda f, w: F.coalesce(f("value").over(w), F.col("value"))
    nx, ny, nz = side(F.lag, along) - side(F.lead, along), F.lit(2.0 * pixel), side(F.lead, across) - side(F.lag, across)
    dot = (nx * lx + ny * ly + nz * lz) / F.sqrt(nx * nx + ny * ny + nz * nz)
    return cells.withColumn("shade", 0.35 + 0.65 * F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)))


def height_colour(k: Column) -> tuple[Column, Column, Column]:
    """Green valleys over brown slopes to grey summits, for k from 0 to 1."""
    # The three colours.
    low, mid, high = (0.35, 0.48, 0.28), (0.62, 0.52, 0.38), (0.92, 0.92, 0.92)
    return tuple(F.when(k < 0.5, a + (b - a) * k * 2.0).otherwise(b + (c - b) * (k - 0.5) * 2.0) for a, b, c in zip(low, mid, high))


def statistics(cells: DataFrame, *by: str) -> DataFrame:
    return cells.groupBy(*by).agg(F.count("value").alias("n_valid"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg("value").alias("mean"))


def from_points(points: DataFrame, x: str = "x", y: str = "y", value: str = "value") -> tuple[DataFrame, Grid]:
    """Cells and grid of regularly spaced centres; the spacing is the smallest step between distinct eastings.

    Distinct eastings are ordered within STRIPS strips; only the strips' ends are put in one order.
    """
    b = points.agg(F.min(x), F.max(y), F.max(x), F.min(y), F.count(F.lit(1))).first()
    step = None
    if b[4] >= 3 and b[2] > b[0]:
        strip = F.floor((F.col("x") - b[0]) / ((b[2] - b[0]) / STRIPS))
        eastings = points.select(F.col(x).alias("x")).distinct().withColumn("strip", strip)
        inner = eastings.withColumn("d", F.lead("x").over(Window.partitionBy("strip").orderBy("x")) - F.col("x"))
        ends = inner.groupBy("strip").agg(F.min("d").alias("d"), F.min("x").alias("first"), F.max("x").alias("last"))
        step = ends.select(F.least("d", F.lead("first").over(Window.orderBy("strip")) - F.col("last")).alias("d")).agg(F.min("d")).first()[0]
    if step is None:
        raise ValueError("a raster needs three points")
    grid = Grid(round((b[2] - b[0]) / step) + 1, round((b[1] - b[3]) / step) + 1, b[0] - step / 2, b[1] + step / 2, step)
    row, col = grid.cell(F.col(x), F.col(y))
    return points.select(row.alias("row"), col.alias("col"), F.col(value).alias("value")), grid
