"""Sets of cells (row, col): algebra, growth, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.raster import Grid

CELL = ["row", "col"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(CELL).union(b.select(CELL)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(CELL).intersect(b.select(CELL))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(CELL).distinct().join(b.select(CELL).distinct(), CELL, "left_anti")


def invert(a: DataFrame, grid: Grid) -> DataFrame:
    return subtract(grid.cells(a.sparkSession), a)


def dilate(a: DataFrame, grid: Grid, metres: float) -> DataFrame:
    """Every cell within ceil(metres / pixel) steps to the four neighbours: rows first, then along each row as far as is left."""
    k = -int(-metres // grid.pixel)
    by_row = F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda d: F.struct((F.col("row") + d).alias("r"), (F.lit(k) - F.abs(d)).alias("left")))
    # Of the steps that reach a cell from several rows only the longest reach matters.
    reach = a.select(CELL).distinct().select("col", F.inline(by_row)).groupBy("r", "col").agg(F.max("left").alias("left"))
    spread = reach.select(F.col("r").alias("row"), F.explode(F.sequence(F.col("col") - F.col("left"), F.col("col") + F.col("left"))).alias("col"))
    return spread.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).distinct()


def taller_than(surface: DataFrame, terrain: DataFrame, metres: float) -> DataFrame:
    """Cells whose surface stands at least so far above the terrain."""
    # Whole rasters meet by a shuffle: Spark would go by the size of files, and millions of cells may lie in a small one.
    joined = surface.select(*CELL, F.col("value").alias("s")).join(terrain.select(*CELL, F.col("value").alias("t")).hint("merge"), CELL)
    return joined.filter(F.col("s") - F.col("t") >= metres).select(CELL)


def area(a: DataFrame, grid: Grid) -> DataFrame:
    return a.agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * grid.pixel * grid.pixel).alias("area"))


def same_grid(a: Grid, b: Grid) -> None:
    if a != b:
        raise ValueError("the masks lie on different grids")
