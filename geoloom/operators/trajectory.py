"""Time-ordered poses (id, t, x, y, z, yaw, pitch, roll): interpolation, frames, lengths, rotations.

Angles are in degrees; yaw turns clockwise from north, pitch raises the nose, roll banks right.
Quaternions are structs of x, y, z, w.

A track is worked in stretches of time of some PER_STRETCH rows, so that one with a third of all
samples is spread over tasks. What a stretch needs of its neighbours, the last sample before it and
the first one behind it, comes from one row per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSE = ["x", "y", "z", "yaw", "pitch", "roll"]
#: Rows in a stretch on average, and frames that one row unfolds into at most.
PER_STRETCH = 50_000


def turn_between(a: Column, b: Column, t: Column) -> Column:
    """From a towards b on the shorter arc."""
    return a + (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) * t


def frames(samples: DataFrame, step: float, key: str = "id") -> DataFrame:
    """key and t at start + i * step up to the end of each track."""
    if step <= 0:
        raise ValueError("the step must be positive")
    ends = samples.groupBy(key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    part = F.lit(PER_STRETCH).cast("long")
    runs = ends.withColumn("n", F.floor((F.col("t1") - F.col("t0")) / step)).select(key, "t0", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / part))).alias("run"))
    each = F.sequence(F.col("run") * part, F.least(F.col("n"), (F.col("run") + 1) * part - 1))
    # The frames of one track are unfolded by many tasks.
    return runs.repartition(F.col(key), F.col("run")).select(key, "t0", F.explode(each).alias("i")).select(key, (F.col("t0") + F.col("i") * step).alias("t"))


def _stretched(rows: DataFrame, key: str, per: int) -> DataFrame:
    """rows with `__part`, the stretch of the track's time that t is in; a track's stretches are of equal length. Rows without a time are in the first."""
    spans = rows.groupBy(key).agg(F.min("t").alias("__t0"), F.max("t").alias("__t1"), F.ceil(F.count(F.lit(1)) / per).alias("__n"))
    place = F.floor((F.col("t") - F.col("__t0")) / (F.col("__t1") - F.col("__t0")) * F.col("__n"))
    many = (F.col("__n") > 1) & (F.col("__t1") > F.col("__t0"))
    both = rows.join(spans.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")))
    both = both.withColumn("__part", F.coalesce(F.when(many, F.least(place, F.col("__n") - 1)), F.lit(0).cast("long"))).drop("__key", "__t0", "__t1", "__n")
    # Dealt by stretches: else Spark keeps the rows as the join by the key alone has dealt them, a whole track in one task.
    return both.repartition(F.col(key), F.col("__part"))


def _beside(rows: DataFrame, key: str) -> DataFrame:
    """rows (with __part and a struct s, null in rows that are no samples) with before and after: the samples next to the row's stretch."""
    ends = rows.groupBy(key, "__part").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("t"))).alias("last"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("t"))).alias("first"))
    order = Window.partitionBy(key)
    before = F.last("last", ignorenulls=True).over(order.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(order.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), before.alias("before"), after.alias("after"))
    return rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at"))).drop("__key", "__at")


def poses_at(samples: DataFrame, times: DataFrame, key: str = "id", per: int = PER_STRETCH) -> DataFrame:
    """Pose of each (key, t) of times: between the two samples around it, the end samples beyond the ends.

    Samples and times are merged and ordered in stretches of a track; each time takes the sample before
    it from the order by time and the one after it from the reverse order, each carried along row by
    row, or from the stretches beside. A field that one of the two samples has not is null. Where
    samples have a quaternion `q`, the pose has one, too: between the two on the shorter great arc,
    null unless both samples have it.
    """
    own = [*POSE, *(["q"] if "q" in samples.columns else [])]
    named = F.struct("t", *own)
    both = samples.select(key, "t", F.lit(0).alias("kind"), named.alias("s")).unionByName(
        times.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast(samples.select(named.alias("s")).schema["s"].dataType).alias("s")))
    both = _stretched(both, key, per)
    so_far = lambda *order: F.last("s", ignorenulls=True).over(Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("a", so_far("t", "kind")).withColumn("b", so_far(F.desc("t"), F.desc("kind")))
    found = _beside(found, key).filter("kind = 1").select(key, "t", F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
    # Beyond the ends the one sample is both.
    found = found.select(key, "t", F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    span = b("t") - a("t")
    part = F.when(span > 0, (F.col("t") - a("t")) / span).otherwise(0.0)
    line = lambda c: (a(c) + (b(c) - a(c)) * part).alias(c)
    arc = lambda c: turn_between(a(c), b(c), part).alias(c)
    turned = [F.when(a("q").isNotNull() & b("q").isNotNull(), slerp(a("q"), b("q"), part)).alias("q")] if "q" in own else []
    return found.select(key, "t", line("x"), line("y"), line("z"), arc("yaw"), line("pitch"), arc("roll"), *turned)


def viewer_poses(samples: DataFrame, times: DataFrame, key: str = "id") -> DataFrame:
    """Position and quaternion of each (key, t) of times, where t counts from the track's first sample; angles become quaternions first."""
    turned = rotation(F.col("yaw"), F.col("pitch"), F.col("roll"))
    samples = samples.withColumn("q", F.coalesce(F.col("q"), turned) if "q" in samples.columns else turned)
    begin = samples.groupBy(key).agg(F.min("t").alias("__t0"))
    samples = samples.join(begin, key).withColumn("t", F.col("t") - F.col("__t0")).drop("__t0")
    return poses_at(samples, times, key).select(key, "t", "x", "y", "z", "q")


def placed(rows: DataFrame, order: str, key: str = "id", per: int = PER_STRETCH) -> DataFrame:
    """rows with place: their place in the track, from 0, by a number or time. A stretch's places begin where those before it end."""
    timed = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != "t"), F.struct(*([F.col("t")] if "t" in rows.columns else [F.lit(0).alias("none")])).alias("__own"), F.col(order).try_cast("double").alias("t"), F.col(order).alias("__order"))
    parts = _stretched(timed, key, per)
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__begin"))
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__order")) - 1
    both = parts.withColumn("__inside", inside).join(begin, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    return both.select(*(F.col("__own.t").alias("t") if c == "t" else F.col(f"`{c}`") for c in rows.columns), (F.col("__begin") + F.col("__inside")).alias("place"))


def timed_by_row(samples: DataFrame, order: str, interval: float, key: str = "id", per: int = PER_STRETCH) -> DataFrame:
    """samples of each track with t: the place in the order, times the interval."""
    return placed(samples, order, key, per).withColumn("t", F.col("place") * F.lit(float(interval))).drop("place")


def _steps(samples: DataFrame, key: str, per: int) -> DataFrame:
    """samples with __part and __d: the distance from the sample before, 0 for a track's first one. A position that is not known is no distance away."""
    rows = _stretched(samples, key, per).withColumn("s", F.struct("x", "y", "z"))
    inside = F.lag("s").over(Window.partitionBy(key, "__part").orderBy("t"))
    rows = _beside(rows.withColumn("p", inside), key).withColumn("p", F.coalesce("p", "before"))
    d = lambda c: F.coalesce(F.col(c) - F.col(f"p.{c}"), F.lit(0.0))
    return rows.withColumn("__d", F.sqrt(d("x") ** 2 + d("y") ** 2 + d("z") ** 2)).select(*samples.columns, "__part", "__d")


def length(samples: DataFrame, key: str = "id", per: int = PER_STRETCH) -> DataFrame:
    return _steps(samples.select(key, "t", "x", "y", "z"), key, per).groupBy(key).agg(F.sum("__d").alias("length"))


def cumulative(samples: DataFrame, key: str = "id", per: int = PER_STRETCH) -> DataFrame:
    """samples with the distance travelled so far: that of the stretches before, and of the stretch itself."""
    rows = _steps(samples, key, per)
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    done = rows.groupBy(key, "__part").agg(F.sum("__d").alias("d")).select(F.col(key).alias("__key"), F.col("__part").alias("__at"), F.coalesce(F.sum("d").over(before), F.lit(0.0)).alias("done"))
    so_far = F.sum("__d").over(Window.partitionBy(key, "__part").orderBy("t"))
    both = rows.withColumn("__d", so_far).join(done, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    return both.select(*samples.columns, (F.col("done") + F.col("__d")).alias("travelled"))


def quaternion(x, y, z, w) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def multiply(p: Column, q: Column) -> Column:
    return quaternion(
        p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
        p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
        p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
        p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"])


def rotation(yaw: Column, pitch: Column, roll: Column) -> Column:
    """yaw about -z, then pitch about x, then roll about y, in closed form."""
    half = lambda v: F.radians(v) / 2.0
    sy, cy, sp, cp, sr, cr = -F.sin(half(yaw)), F.cos(half(yaw)), F.sin(half(pitch)), F.cos(half(pitch)), F.sin(half(roll)), F.cos(half(roll))
    return quaternion(cy * sp * cr - sy * cp * sr, cy * cp * sr + sy * sp * cr, cy * sp * sr + sy * cp * cr, cy * cp * cr - sy * sp * sr)


def rotate(q: Column, vx, vy, vz) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion."""
    v = [F.lit(float(c)) if not isinstance(c, Column) else c for c in (vx, vy, vz)]
    u = [q["x"], q["y"], q["z"]]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    t = [2.0 * c for c in cross(u, v)]
    return tuple(a + q["w"] * b + c for a, b, c in zip(v, t, cross(u, t)))


def with_euler(df: DataFrame, q: str = "q", yaw: str = "yaw", pitch: str = "pitch", roll: str = "roll") -> DataFrame:
    """Angles of a body-to-scene quaternion, yaw and roll above -180 up to 180; roll is 0 when it looks straight up or down."""
    fx, fy, fz = rotate(F.col(q), 0, 1, 0)
    ux, uy, uz = rotate(F.col(q), 0, 0, 1)
    df = df.withColumns({"t_fx": fx, "t_fy": fy, "t_fz": fz, "t_ux": ux, "t_uy": uy, "t_uz": uz})
    flat = F.sqrt(F.col("t_fx") ** 2 + F.col("t_fy") ** 2)
    rx, ry = F.col("t_fy") / flat, -F.col("t_fx") / flat
    # Up without roll: right x forward.
    upx, upy, upz = ry * F.col("t_fz"), -rx * F.col("t_fz"), rx * F.col("t_fy") - ry * F.col("t_fx")
    # Half a turn is 180 on whichever side of it rounding has put the arc.
    half = lambda v: F.when(v < -180.0 + 1e-9, v + 360.0).otherwise(v)
    banked = F.degrees(F.atan2(F.col("t_ux") * rx + F.col("t_uy") * ry, F.col("t_ux") * upx + F.col("t_uy") * upy + F.col("t_uz") * upz))
    df = df.withColumns({yaw: half(F.degrees(F.atan2("t_fx", "t_fy"))), pitch: F.degrees(F.asin(F.least(F.greatest(F.col("t_fz"), F.lit(-1.0)), F.lit(1.0)))),
                         roll: F.when(flat < 1e-6, 0.0).otherwise(half(banked))})
    return df.drop("t_fx", "t_fy", "t_fz", "t_ux", "t_uy", "t_uz")


def slerp(p: Column, q: Column, t: Column) -> Column:
    """Along the shorter great arc; nearly equal rotations are mixed in a straight line."""
    dot = p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"] + p["w"] * q["w"]
    sign, near = F.when(dot < 0, -1.0).otherwise(1.0), F.abs(dot) > 1.0 - 1e-6
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    a = F.when(near, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / F.sin(angle))
    b = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return quaternion(*(a * p[c] + b * q[c] for c in "xyzw"))
