"""Bytes and texts of outputs: PNG, world files, GeoJSON, point lists, OBJ meshes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geodesy


def png_grey(grid: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG, stretched between the lowest and highest value; gaps are black."""
    ok = ~np.isnan(grid)
    low, high = (float(grid[ok].min()), float(grid[ok].max())) if ok.any() else (0.0, 0.0)
    grey = np.where(ok, np.rint((np.nan_to_num(grid) - low) / max(high - low, 1e-9) * 255), 0).astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in grey)
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def world_file(origin_x: float, origin_y: float, pixel: float) -> str:
    """Six lines; the last two are the centre of the first pixel."""
    return "\n".join(f"{v:.10g}" for v in (pixel, 0, 0, -pixel)) + f"\n{origin_x + pixel / 2:.4f}\n{origin_y - pixel / 2:.4f}\n"


def projection_file(zone: int = 32) -> str:
    """The text that names a raster's system beside it: ETRS89 / UTM."""
    return (f'PROJCS["ETRS89 / UTM zone {zone}N",GEOGCS["ETRS89",DATUM["European_Terrestrial_Reference_System_1989",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],'
            f'UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{6 * zone - 183}],PARAMETER["scale_factor",0.9996],'
            f'PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","{25800 + zone}"]]')


def found_features(finds: DataFrame, epsg: int = 25832) -> DataFrame:
    """One JSON text per coordinate that was found: a point feature that says where it comes from, how it was read, and its place in a system."""
    at = geodesy.with_projected(finds, epsg, "lat", "lon", "to_x", "to_y") if epsg != 4326 else finds.withColumns({"to_x": F.col("lon"), "to_y": F.col("lat")})
    names = F.create_map(*(x for code, name in geodesy.NAMES.items() for x in (F.lit(code), F.lit(name))))
    at = at.select("lat", "lon", "z", F.col("path").alias("sourcePath"), F.col("raw").alias("sourceRaw"), F.col("epsg").alias("detectedEpsg"), F.try_element_at(names, F.col("epsg")).alias("detectedCrs"),
                   F.round("confidence", 3).alias("confidence"), F.round("to_x", 3).alias(f"epsg{epsg}_x"), F.round("to_y", 3).alias(f"epsg{epsg}_y"))
    return geojson_features(at, z="z")


def geojson_features(df: DataFrame, lat: str = "lat", lon: str = "lon", z: str | None = None, properties: list[str] | None = None) -> DataFrame:
    """One JSON text per row: a point feature with 8 decimals, a height with 3."""
    point = [F.round(lon, 8), F.round(lat, 8)]
    at = F.array(*point)
    if z:
        at = F.when(F.col(z).isNull(), at).otherwise(F.array(*point, F.round(z, 3)))
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"),
        F.struct(*(properties or [c for c in df.columns if c not in (lat, lon, z)])).alias("properties"))).alias("value"))


def left_handed(east: Column, north: Column, up: Column) -> tuple[Column, Column, Column]:
    """East, north, up to the axes of a left-handed, y-up scene."""
    return east, up, north


def points_json(df: DataFrame, digits: int = 4) -> DataFrame:
    """name, tag and both sets of axes as JSON; minus zero is written as zero."""
    tidy = lambda c: F.round(c, digits) + 0.0
    x, y, z = left_handed(F.col("x"), F.col("y"), F.col("z"))
    return df.select(F.to_json(F.struct(
        "name", "tag", F.array(*(tidy(F.col(c)) for c in "xyz")).alias("enu"), F.array(tidy(x), tidy(y), tidy(z)).alias("scene"))).alias("value"))


def obj_text(triangles: np.ndarray, material: str = "surface") -> str:
    """A Wavefront mesh of n x 3 x 3 corners."""
    corners = triangles.reshape(-1, 3)
    lines = [f"usemtl {material}", *(f"v {x:.4f} {y:.4f} {z:.4f}" for x, y, z in corners)]
    return "\n".join([*lines, *(f"f {3 * i + 1} {3 * i + 2} {3 * i + 3}" for i in range(len(triangles)))]) + "\n"


def one_grid(cells: DataFrame, width: int, height: int) -> np.ndarray:
    """A bounded raster on the driver, for a file that holds one picture; larger rasters go tile by tile."""
    if width * height > 25_000_000:
        raise ValueError("write a raster of this size tile by tile")
    grid = np.full((height, width), np.nan, np.float32)
    got = cells.select("row", "col", F.col("value").cast("float")).toArrow()
    grid[got["row"].to_numpy(), got["col"].to_numpy()] = got["value"].to_numpy()
    return grid
