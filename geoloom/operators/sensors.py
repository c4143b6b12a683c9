"""Sensor rays, where they meet the ground, and which cells a flight has seen.

Rays are rows. A ray is marched in stretches that are equi-joined to coarse blocks of the terrain;
stretches that may meet the ground become steps, which are equi-joined to the cells through bilinear
sampling. The first step that is below the ground, or off the terrain, ends the ray.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import raster, trajectory
from geoloom.operators.raster import Grid


def _offsets_pyramid(quality: int, fov_h: float, fov_v: float) -> list[tuple[float, float]]:
    across, down = max(2, quality), max(2, quality * 3 // 4)
    th, tv = math.tan(math.radians(fov_h) / 2), math.tan(math.radians(fov_v) / 2)
    return [((2 * i / (across - 1) - 1) * th, (2 * j / (down - 1) - 1) * tv) for j in range(down) for i in range(across)]


def _rings(quality: int, least: int) -> list[tuple[float, float]]:
    """(share of the radius, angle) of rings whose number of rays grows with their size; the middle first."""
    rings = max(1, quality // 3)
    found = [(0.0, 0.0)]
    for ring in range(1, rings + 1):
        n = max(least, round(2 * math.pi * ring * quality / (3 * rings)))
        found += [(ring / rings, 2 * math.pi * i / n) for i in range(n)]
    return found


def _offsets_cone(quality: int, half_angle: float) -> list[tuple[float, float]]:
    tan = lambda s: math.tan(math.radians(half_angle * s))
    return [(tan(s) * math.cos(a), tan(s) * math.sin(a)) for s, a in _rings(quality, 6)]


def _ray_table(poses: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """One row per pose and offset; the offsets are a short constant list."""
    items = F.array(*(F.struct(F.lit(i).alias("ray"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(offsets)))
    return poses.select("*", F.inline(items))


def _directed(poses: DataFrame, offsets, mount: tuple[float, float, float]) -> DataFrame:
    turned = trajectory.multiply(trajectory.rotation(F.col("yaw"), F.col("pitch"), F.col("roll")), trajectory.rotation(*(F.lit(float(m)) for m in mount)))
    rays = _ray_table(poses.withColumn("__q", turned), offsets)
    f, r, u = (trajectory.rotate(F.col("__q"), *v) for v in ((0, 1, 0), (1, 0, 0), (0, 0, 1)))
    d = [a + b * F.col("a") + c * F.col("b") for a, b, c in zip(f, r, u)]
    rays = rays.withColumns({"__dx": d[0], "__dy": d[1], "__dz": d[2]})
    size = F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2 + F.col("__dz") ** 2)
    return rays.withColumns({"dx": F.col("__dx") / size, "dy": F.col("__dy") / size, "dz": F.col("__dz") / size}).drop("__q", "__dx", "__dy", "__dz", "a", "b")


def pyramid_rays(poses: DataFrame, quality: int, fov_h: float = 60, fov_v: float = 45, mount=(0, -90, 0)) -> DataFrame:
    return _directed(poses, _offsets_pyramid(quality, fov_h, fov_v), mount)


def cone_rays(poses: DataFrame, quality: int, half_angle: float = 20, mount=(0, -90, 0)) -> DataFrame:
    return _directed(poses, _offsets_cone(quality, half_angle), mount)


def boresight(poses: DataFrame, mount=(0, -90, 0)) -> DataFrame:
    return _directed(poses, [(0.0, 0.0)], mount)


def cylinder_rays(poses: DataFrame, quality: int, radius: float) -> DataFrame:
    """Parallel rays straight down."""
    rays = _ray_table(poses, [(radius * s * math.cos(p), radius * s * math.sin(p)) for s, p in _rings(quality, 8)])
    return rays.withColumns({"x": F.col("x") + F.col("a"), "y": F.col("y") + F.col("b"), "dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(-1.0)}).drop("a", "b")


def _coarse(terrain: DataFrame, grid: Grid, block: int) -> DataFrame:
    """Per block of cells the highest value in it and around it, and whether there is a gap or the edge of the terrain."""
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    own = terrain.filter("value is not null").groupBy(br.alias("br"), bc.alias("bc")).agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    size = lambda length, at: F.least(F.lit(block), F.lit(length) - at * block)
    own = own.withColumn("full", (F.col("n") >= size(grid.height, F.col("br")) * size(grid.width, F.col("bc"))).cast("int"))
    around = F.array(*(F.struct((F.col("br") + r).alias("br"), (F.col("bc") + c).alias("bc")) for r in (-1, 0, 1) for c in (-1, 0, 1)))
    spread = own.select("top", "full", F.inline(around))
    return spread.groupBy("br", "bc").agg(F.max("top").alias("top"), (F.sum("full") < 9).alias("gap"))


def _steps(rays: DataFrame, count: Column, step: float, terrain: DataFrame, grid: Grid, gaps: bool, block: int = 16) -> DataFrame:
    """Those of a ray's steps 1 to count (k, px, py, pz) that may be below the ground, or with `gaps` off it.

    Stretches of a ray as long as a block are compared with the block's highest ground first; a
    stretch that stays above it gives no steps.
    """
    size = max(1, int(block * grid.pixel / step))
    s = rays.withColumn("__n", count)
    s = s.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / size))))
    first, last = F.col("__j") * size + 1, F.least((F.col("__j") + 1) * size, F.col("__n"))
    at = lambda c, k: F.col(c) + F.col(f"d{c}") * (k * step)
    row, col = grid.cell(at("x", (first + last) / 2), at("y", (first + last) / 2))
    s = s.withColumns({"br": F.floor(row / block), "bc": F.floor(col / block), "__first": first, "__last": last, "__low": F.least(at("z", first), at("z", last))})
    s = s.join(_coarse(terrain, grid, block), ["br", "bc"], "left")
    may = F.coalesce(F.col("__low") <= F.col("top"), F.lit(gaps))
    if gaps:
        may = may | F.coalesce("gap", F.lit(True))
    s = s.filter(may).withColumn("k", F.explode(F.sequence("__first", "__last")))
    return s.withColumns({f"p{c}": at(c, F.col("k")) for c in "xyz"}).drop("br", "bc", "top", "gap", "__n", "__j", "__first", "__last", "__low")


#: What makes a ray.
WAY = ["x", "y", "z", "dx", "dy", "dz"]


def hit_ground(rays: DataFrame, terrain: DataFrame, grid: Grid, max_range: float, step: float | None = None, key: str = "ray_id") -> DataFrame:
    """rays with hit_x, hit_y, hit_z (null: none). rays has a unique key, x, y, z and a unit direction dx, dy, dz.

    A hit half a step earlier is taken if that point is below the ground, too. Rays that run the same way are marched once.
    """
    ways = rays.select(*WAY).distinct().withColumn("__way", F.struct(*WAY))
    hits = _hits(ways, terrain, grid, max_range, step, "__way").select(*(F.col("__way")[c].alias(f"__{c}") for c in WAY), "hit_x", "hit_y", "hit_z")
    same = [F.col(c) == F.col(f"__{c}") for c in WAY]
    return rays.join(hits, same, "left").drop(*(f"__{c}" for c in WAY))


def _hits(rays: DataFrame, terrain: DataFrame, grid: Grid, max_range: float, step: float | None, key: str) -> DataFrame:
    """rays with their hits, each marched for itself."""
    step = step or grid.pixel * 0.75
    top, lowest = terrain.agg(F.max("value"), F.min("value")).first()
    if top is None:
        return rays.withColumns({c: F.lit(None).cast("double") for c in ("hit_x", "hit_y", "hit_z")})
    # No step past the range, past the terrain's highest point when climbing, or past its lowest when falling.
    limit = F.floor(F.lit(max_range / step)) + 1
    climb = F.when(F.col("dz") > 0, F.greatest(F.ceil((F.lit(float(top) + 1.0) - F.col("z")) / (F.col("dz") * step)), F.lit(0)))
    fall = F.when(F.col("dz") < 0, F.greatest(F.ceil((F.lit(float(lowest)) - F.col("z")) / (F.col("dz") * step)), F.lit(0)) + 1)
    count = F.greatest(F.least(limit, F.coalesce(climb, limit), F.coalesce(fall, limit)), F.lit(1)).cast("long")
    steps = _steps(rays.select(key, "x", "y", "z", "dx", "dy", "dz"), count, step, terrain, grid, gaps=True)
    sampled = raster.bilinear(steps.select(key, "k", "px", "py", "pz"), terrain, grid, "px", "py")
    ended = sampled.filter(F.col("value").isNull() | (F.col("pz") <= F.col("value")))
    first = ended.groupBy(key).agg(F.min_by(F.struct("k", "px", "py", "value"), "k").alias("e"))
    met = rays.select(key, "x", "y", "z", "dx", "dy", "dz").join(first.filter("e.value is not null"), key)
    half = lambda c: F.col(c) + F.col(f"d{c}") * ((F.col("e.k") - 0.5) * step)
    back = met.select(key, "e", half("x").alias("bx"), half("y").alias("by"), half("z").alias("bz"))
    refined = raster.bilinear(back, terrain, grid, "bx", "by").withColumn("g", F.coalesce("value", "e.value"))
    use = F.col("bz") <= F.col("g")
    hits = refined.select(key, F.when(use, F.col("bx")).otherwise(F.col("e.px")).alias("hit_x"), F.when(use, F.col("by")).otherwise(F.col("e.py")).alias("hit_y"),
                          F.when(use, F.col("g")).otherwise(F.col("e.value")).alias("hit_z"))
    return rays.join(hits, key, "left")


def can_see(pairs: DataFrame, terrain: DataFrame, grid: Grid, step: float | None = None, key: str = "id") -> DataFrame:
    """pairs with `visible`: no step between (x, y, z) and (tx, ty, tz) is at or below the ground; gaps do not block."""
    step = step or grid.pixel * 0.75
    far = F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2 + (F.col("tz") - F.col("z")) ** 2)
    rays = pairs.withColumn("__far", far).filter("__far >= 1e-6")
    rays = rays.select(key, "x", "y", "z", "__far", *(((F.col(f"t{c}") - F.col(c)) / F.col("__far")).alias(f"d{c}") for c in "xyz"))
    count = F.ceil((F.col("__far") - step) / step) - 1
    steps = _steps(rays.filter(count >= 1), count, step, terrain, grid, gaps=False)
    sampled = raster.bilinear(steps.select(key, "px", "py", "pz"), terrain, grid, "px", "py")
    blocked = sampled.filter(F.col("pz") <= F.col("value")).select(key).distinct().withColumn("__blocked", F.lit(True))
    return pairs.join(blocked, key, "left").withColumn("visible", F.col("__blocked").isNull()).drop("__blocked")


def flight_coverage(samples: DataFrame, rays_of, terrain: DataFrame, grid: Grid, max_range: float, frame_step: float = 1.0, key: str = "id") -> DataFrame:
    """Per track the distinct cells seen from its frames. rays_of makes the rays (`ray`, directions) of a table of poses."""
    frames = trajectory.poses_at(samples, trajectory.frames(samples, frame_step, key), key)
    rays = rays_of(frames).withColumn("ray_id", F.struct(key, "t", "ray"))
    hits = hit_ground(rays, terrain, grid, max_range)
    return seen_cells(hits, grid, key)


def seen_cells(hits: DataFrame, grid: Grid, *by: str) -> DataFrame:
    """Distinct cells of the hits (of each value of the columns `by`)."""
    row, col = grid.cell(F.col("hit_x"), F.col("hit_y"))
    found = hits.filter("hit_x is not null").select(*by, row.alias("row"), col.alias("col")).distinct()
    return found.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
