"""A raster as a triangle mesh: every n-th cell is a vertex, two triangles fill each square of four.

Vertices are numbered row by row over the thinned grid, so triangles follow from the grid alone and need no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import raster
from geoloom.operators.raster import Grid

#: Cells on a side of a baked picture at most, and where its light comes from. The share of an overlay's colour.
BAKED, LIGHT, TINT = 2048, (-0.45, 0.8, 0.4), 0.5


def stride(grid: Grid, most: int) -> int:
    """The smallest step that leaves at most `most` vertices (one at least)."""
    n = 1
    while _thinned(grid, n)[0] * _thinned(grid, n)[1] > max(most, 1):
        n += 1
    return n


def _thinned(grid: Grid, n: int) -> tuple[int, int]:
    return (grid.width - 1) // n + 1, (grid.height - 1) // n + 1


def vertices(cells: DataFrame, grid: Grid, most: int) -> DataFrame:
    """(vertex, x, y, height, u, v) of the cells that are kept: corner positions and texture coordinates, v upwards.
    Cells without a row have no vertex; a null value stays null."""
    n = stride(grid, most)
    across, _ = _thinned(grid, n)
    kept = cells.filter((F.col("row") % n == 0) & (F.col("col") % n == 0))
    return kept.select(
        (F.col("row") / n * across + F.col("col") / n).cast("long").alias("vertex"), (grid.origin_x + F.col("col") * grid.pixel).alias("x"),
        (grid.origin_y - F.col("row") * grid.pixel).alias("y"), F.col("value").alias("height"),
        (F.col("col") / max(grid.width - 1, 1)).alias("u"), (1.0 - F.col("row") / max(grid.height - 1, 1)).alias("v"))


def triangles(spark, grid: Grid, most: int) -> DataFrame:
    """(triangle, a, b, c): vertex numbers, two triangles a square, the upper right one first."""
    across, along = _thinned(grid, stride(grid, most))
    squares = spark.range(max(across - 1, 0) * max(along - 1, 0))
    a = F.floor(F.col("id") / max(across - 1, 1)) * across + F.col("id") % max(across - 1, 1)
    d = a + across + 1
    pair = F.array(*(F.struct((F.col("id") * 2 + k).alias("triangle"), a.alias("a"), b.alias("b"), c.alias("c")) for k, (b, c) in enumerate(((a + 1, d), (d, a + across)))))
    return squares.select(F.inline(pair))


def colours(cells: DataFrame, grid: Grid, overlays: list[tuple[DataFrame, tuple[int, int, int]]] = (), most: int = BAKED) -> DataFrame:
    """(row, col, r, g, b) of a picture of the terrain: colours by height, shaded, with overlays (cells and a colour of 0 to 255) mixed in, in their order.

    Of a grid that is larger than `most` on a side every n-th cell is taken, n being the smallest that does.
    Gaps count as the lowest height.
    """
    n = 1
    while grid.width // n > most or grid.height // n > most:
        n += 1
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    low, high = (0.0, 0.0) if low is None else (float(low), float(high))
    whole = grid.cells(cells.sparkSession).join(cells.select("row", "col", "value"), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(low)))
    shaded = raster.hillshade(whole, grid.pixel, LIGHT).filter((F.col("row") % n == 0) & (F.col("col") % n == 0))
    shaded = shaded.filter((F.col("row") < grid.height // n * n) & (F.col("col") < grid.width // n * n))
    base = raster.height_colour((F.col("value") - low) / max(0.001, high - low))
    out = shaded.select("row", "col", *((c * F.col("shade")).alias(k) for c, k in zip(base, "rgb")))
    for mask, tint in overlays:
        marked = out.join(mask.select("row", "col").distinct().withColumn("__in", F.lit(True)), ["row", "col"], "left")
        out = marked.select("row", "col", *(F.when(F.col("__in"), F.col(k) + (t / 255.0 - F.col(k)) * TINT).otherwise(F.col(k)).alias(k) for k, t in zip("rgb", tint)))
    return out.select((F.col("row") / n).cast("long").alias("row"), (F.col("col") / n).cast("long").alias("col"), "r", "g", "b")
