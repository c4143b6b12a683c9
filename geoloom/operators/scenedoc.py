"""A whole job as one document: which map, which track, which sensor, which areas, which outputs.

The document is JSON with comments and commas before closing brackets; members' names are compared
without case, and members that are not known are ignored. It is checked as a whole, and all faults
are named, before any Spark job runs. run() then makes one DataFrame per area, coverage and set of
points, and writes what the document asks for. Paths are relative to the document's folder.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators import catalog, masks, raster, sensors, trajectory
from geoloom.operators.raster import Grid
from geoloom.sources import bundle, files, formats, rasters, tracks

_STRING = r'"(?:[^"\\]|\\.)*"'


def strict(text: str) -> str:
    """Without comments, and without commas before closing brackets; strings stay as they are."""
    text = re.sub(rf"({_STRING})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(rf"({_STRING})|,(?=\s*[}}\]])", lambda m: m[1] or "", text, flags=re.S)


@dataclass
class MapSpec:
    """Heights from a file, or from the tiles of a state that lie in the cache."""

    terrainFile: str | None = None
    surfaceFile: str | None = None
    utmZone: int = 32
    state: str | None = None
    bbox: list | None = None
    cache: str = "tilecache"
    resolution: float = 1.0
    surfaceModel: bool = False
    classificationFile: str | None = None


@dataclass
class MappingSpec:
    fields: dict = field(default_factory=dict)
    positionEpsg: int = 25832
    timeDivisor: float = 1.0
    angleToDegrees: float = 1.0
    fallbackSampleInterval: float = 1.0

    def mapping(self) -> tracks.Mapping:
        return tracks.Mapping(dict(self.fields), self.positionEpsg, self.timeDivisor, self.angleToDegrees, self.fallbackSampleInterval)


@dataclass
class TrackSpec:
    file: str = ""
    mapping: MappingSpec | None = None


@dataclass
class SensorSpec:
    type: str = "pyramid"
    name: str = "sensor"
    maxRangeMeters: float = 5000
    mountYawDeg: float = 0
    mountPitchDeg: float = -90
    mountRollDeg: float = 0
    fovHorizontalDeg: float = 60
    fovVerticalDeg: float = 45
    halfAngleDeg: float = 20
    radiusMeters: float = 250


@dataclass
class AreaSpec:
    name: str = "area"
    objectsTallerThan: float | None = None
    inClass: int | None = None
    dilateMeters: float = 0
    geoTiff: str | None = None


@dataclass
class OutputSpec:
    coverageGeoTiff: str | None = None
    frameStepSeconds: float = 1.0
    quality: int = 32
    unityPoints: str | None = None
    pointStepSeconds: float = 1.0
    includeTrajectory: bool = True
    includeBoresight: bool = True
    unityScene: str | None = None


@dataclass
class Document:
    map: MapSpec = field(default_factory=MapSpec)
    trajectory: TrackSpec | None = None
    sensor: SensorSpec | None = None
    areas: list[AreaSpec] = field(default_factory=list)
    outputs: OutputSpec = field(default_factory=OutputSpec)


# The names of a sensor's shapes.
SHAPES = {"pyramid": "pyramid", "camera": "pyramid", "frustum": "pyramid", "cone": "cone", "level": "cone", "cylinder": "cylinder"}
_INNER = {"MapSpec": MapSpec, "TrackSpec": TrackSpec, "MappingSpec": MappingSpec, "SensorSpec": SensorSpec, "OutputSpec": OutputSpec}


def _read(kind, value, at: str, faults: list[str]):
    """An instance of a spec from a JSON object; what doesn't fit is a fault."""
    if not isinstance(value, dict):
        faults.append(f"{at} must be an object")
        return kind()
    given = {k.lower(): v for k, v in value.items()}
    made = {}
    for f in fields(kind):
        if f.name.lower() not in given:
            continue
        v, place, named = given[f.name.lower()], f"{at}.{f.name}".lstrip("."), str(f.type)
        if v is None:
            if "None" not in named:
                faults.append(f"{place} must not be null")
            else:
                made[f.name] = None
            continue
        inner = next((c for n, c in _INNER.items() if named.split(" ")[0] == n), None)
        if inner:
            made[f.name] = _read(inner, v, place, faults)
        elif named.startswith("list[AreaSpec]"):
            if not isinstance(v, list):
                faults.append(f"{place} must be an array")
                continue
            made[f.name] = [_read(AreaSpec, x, f"{place}[{i}]", faults) for i, x in enumerate(v)]
        else:
            whole = isinstance(v, int) and not isinstance(v, bool)
            number = whole or isinstance(v, float) and math.isfinite(v)
            fits = {"str": isinstance(v, str), "int": whole, "float": number, "bool": isinstance(v, bool), "list": isinstance(v, list), "dict": isinstance(v, dict) and all(isinstance(x, str) for x in v.values())}
            if not fits[named.split(" ")[0]]:
                faults.append(f"{place} must be {named.split(' ')[0]}")
            else:
                made[f.name] = v
    return kind(**made)


def faults_of(doc: Document) -> list[str]:
    """What is wrong with a document, apart from its form."""
    m, o, found = doc.map, doc.outputs, []
    if not m.terrainFile:
        if not m.state:
            found.append("map needs either terrainFile or state and bbox")
        else:
            if m.state.lower() not in {s for s, *_ in catalog.STATES}:
                found.append(f"map.state {m.state!r} is not known")
            if m.bbox is None or len(m.bbox) != 4 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in m.bbox):
                found.append("map.bbox must be [minE, minN, maxE, maxN]")
            elif m.bbox[0] >= m.bbox[2] or m.bbox[1] >= m.bbox[3]:
                found.append("map.bbox is empty")
            if m.resolution <= 0:
                found.append("map.resolution must be positive")
    if m.utmZone not in (32, 33):
        found.append("map.utmZone must be 32 or 33")
    if doc.trajectory is not None:
        if not doc.trajectory.file:
            found.append("trajectory.file is missing")
        if doc.trajectory.mapping is not None:
            found += [f"trajectory.mapping: {x}" for x in doc.trajectory.mapping.mapping().faults()]
    if doc.sensor is not None:
        if doc.sensor.type.lower() not in SHAPES:
            found.append(f"sensor.type {doc.sensor.type!r} is not known; use pyramid, cone or cylinder")
        if doc.sensor.maxRangeMeters <= 0:
            found.append("sensor.maxRangeMeters must be positive")
    for i, a in enumerate(doc.areas):
        if a.objectsTallerThan is None and a.inClass is None:
            found.append(f"areas[{i}] ({a.name}) needs a condition: objectsTallerThan or inClass")
        elif a.objectsTallerThan is not None and not (m.surfaceFile if m.terrainFile else m.surfaceModel):
            found.append(f"areas[{i}] ({a.name}) needs the surface model")
        elif a.objectsTallerThan is None and not m.classificationFile:
            found.append(f"areas[{i}] ({a.name}) needs map.classificationFile")
        if a.dilateMeters < 0:
            found.append(f"areas[{i}] ({a.name}): dilateMeters must not be negative")
    if o.coverageGeoTiff and (doc.trajectory is None or doc.sensor is None):
        found.append("outputs.coverageGeoTiff needs a trajectory and a sensor")
    if o.unityPoints and doc.trajectory is None:
        found.append("outputs.unityPoints needs a trajectory")
    found += [f"outputs.{n} must be positive" for n in ("frameStepSeconds", "pointStepSeconds", "quality") if getattr(o, n) <= 0]
    if o.unityScene:
        names = [bundle.overlay_file(n) for n in [*(["coverage"] if doc.trajectory and doc.sensor else []), *(a.name for a in doc.areas)]]
        if len(set(names)) < len(names):
            found.append("outputs.unityScene: two overlays have the same file name")
    return found


def parse(text: str) -> Document:
    """A checked document; a ValueError names all faults."""
    try:
        value = json.loads(strict(text.removeprefix("﻿")))
    except (ValueError, RecursionError) as e:
        raise ValueError(f"the document is no JSON: {e}") from e
    found: list[str] = []
    doc = _read(Document, value, "", found)
    found += [] if found else faults_of(doc)
    if found:
        raise ValueError("; ".join(found))
    return doc


def load(path: str) -> Document:
    return parse(files.read_text(path))


# --- what the document speaks of, as DataFrames


def load_grid(spark: SparkSession, path: str, box: tuple | None = None) -> tuple[DataFrame, Grid]:
    """Cells (row, col, value) and grid of a raster file, a folder of rasters that lie on one grid, XYZ text, or an archive of either, by its ending."""
    lower = path.lower()
    if lower.endswith(".xyz"):
        return raster.from_points(formats.read_xyz(spark, path))
    if lower.endswith(".zip"):
        (_, size), = files.listed(path, (".zip",))
        if not rasters.entries(path, size):
            return raster.from_points(formats.read_zipped_xyz(spark, path))
    grid = rasters.grid_of(spark, path, box)
    cells = rasters.read_rasters(spark, path, box)
    row, col = grid.cell(F.col("x"), F.col("y"))
    return cells.select(row.alias("row"), col.alias("col"), F.col("value").cast("double").alias("value")).filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)), grid


@dataclass
class Scene:
    """A map and what belongs to it. Positions are in the map's system; the anchor is the middle of its bounds."""

    terrain: DataFrame
    grid: Grid
    zone: int = 32
    surface: tuple[DataFrame, Grid] | None = None
    classes: tuple[DataFrame, Grid] | None = None
    samples: DataFrame | None = None

    @property
    def anchor(self) -> tuple[float, float]:
        x0, y0, x1, y1 = self.grid.bounds
        return (x0 + x1) / 2, (y0 + y1) / 2

    def _centres(self) -> DataFrame:
        x, y = self.grid.centre(F.col("row"), F.col("col"))
        return self.terrain.filter("value IS NOT NULL").select("row", "col", "value").withColumns({"x": x, "y": y})

    def taller_than(self, metres: float) -> DataFrame:
        """Cells whose surface, sampled at the cell's centre, stands so far above the terrain."""
        cells, grid = self.surface
        if grid == self.grid:
            return masks.taller_than(cells, self.terrain, metres)
        at = raster.bilinear(self._centres().select("row", "col", "x", "y", F.col("value").alias("ground")).withColumnsRenamed({"row": "own_row", "col": "own_col"}), cells, grid)
        return at.filter(F.col("value") - F.col("ground") >= metres).select(F.col("own_row").alias("row"), F.col("own_col").alias("col"))

    def in_class(self, number: int) -> DataFrame:
        """Cells whose centre lies in a cell of the class."""
        cells, grid = self.classes
        if grid == self.grid:
            return cells.filter(F.round("value") == number).select("row", "col")
        x, y = self.grid.centre(F.col("row"), F.col("col"))
        spots = self.grid.cells(cells.sparkSession).select(F.col("row").alias("own_row"), F.col("col").alias("own_col"), x.alias("x"), y.alias("y"))
        at = raster.nearest(spots, cells, grid)
        return at.filter(F.round("value") == number).select(F.col("own_row").alias("row"), F.col("own_col").alias("col"))


def build(spark: SparkSession, doc: Document, base: str) -> Scene:
    resolve = lambda p: p if "://" in p or p.startswith("/") else f"{base.rstrip('/')}/{p}"
    m = doc.map
    if m.terrainFile:
        scene = Scene(*load_grid(spark, resolve(m.terrainFile)), zone=m.utmZone)
        if m.surfaceFile:
            scene.surface = load_grid(spark, resolve(m.surfaceFile))
    else:
        zone, datasets = next((z, d) for s, z, _, d in catalog.STATES if s == m.state.lower())
        box = tuple(float(v) for v in m.bbox)
        target = Grid(math.ceil((box[2] - box[0]) / m.resolution), math.ceil((box[3] - box[1]) / m.resolution), box[0], box[3], m.resolution)
        wide = (box[0] - 2, box[1] - 2, box[2] + 2, box[3] + 2)

        def layer(name: str) -> DataFrame:
            cells, grid = load_grid(spark, f"{resolve(m.cache).rstrip('/')}/{m.state.lower()}/{name}", wide)
            return raster.regrid(cells, grid, target)

        scene = Scene(layer("dgm1"), target, zone)
        name = next((d for d in catalog.SURFACES if d in datasets), None)
        if m.surfaceModel and name:
            scene.surface = (layer(name), target)
    if m.classificationFile:
        scene.classes = load_grid(spark, resolve(m.classificationFile))
    if doc.trajectory is not None:
        spec = doc.trajectory.mapping
        scene.samples = tracks.load(spark, resolve(doc.trajectory.file), spec.mapping() if spec else None)
    return scene


def _attitude(poses: DataFrame) -> DataFrame:
    """Poses whose angles are those of the quaternion where there is one."""
    if "q" not in poses.columns:
        return poses
    both = trajectory.with_euler(poses, yaw="q_yaw", pitch="q_pitch", roll="q_roll")
    return both.withColumns({c: F.when(F.col("q").isNotNull(), F.col(f"q_{c}")).otherwise(F.col(c)) for c in ("yaw", "pitch", "roll")}).drop("q", "q_yaw", "q_pitch", "q_roll")


def rays_of(sensor: SensorSpec, quality: int) -> Callable[[DataFrame], DataFrame]:
    mount = (sensor.mountYawDeg, sensor.mountPitchDeg, sensor.mountRollDeg)
    shape = SHAPES[sensor.type.lower()]
    if shape == "pyramid":
        return lambda poses: sensors.pyramid_rays(_attitude(poses), quality, sensor.fovHorizontalDeg, sensor.fovVerticalDeg, mount)
    if shape == "cone":
        return lambda poses: sensors.cone_rays(_attitude(poses), quality, sensor.halfAngleDeg, mount)
    return lambda poses: sensors.cylinder_rays(_attitude(poses), quality, sensor.radiusMeters)


def coverage(scene: Scene, sensor: SensorSpec, step: float, quality: int) -> DataFrame:
    """Cells that the sensor sees from any frame of the track."""
    seen = sensors.flight_coverage(scene.samples.drop("i", "extra"), rays_of(sensor, quality), scene.terrain, scene.grid, sensor.maxRangeMeters, step)
    return seen.select("row", "col").distinct()


def _frames(scene: Scene, step: float) -> DataFrame:
    """The track's poses by frame, with k, the frame's number."""
    rows = scene.samples.drop("i", "extra")
    begin = rows.groupBy("id").agg(F.min("t").alias("t0"))
    poses = _attitude(trajectory.poses_at(rows, trajectory.frames(rows, step)))
    return poses.join(begin, "id").withColumn("k", F.round((F.col("t") - F.col("t0")) / step).cast("long")).drop("t0")


POINT = ["i", "name", "tag", "east", "north", "up", "yaw", "pitch", "roll"]


def add_point(points: DataFrame | None, spark: SparkSession, anchor: tuple[float, float], name: str, x: float, y: float, z: float, tag: str = "", epsg: int = 25832) -> DataFrame:
    """points with one more, behind the others, given in any registered system (x is the longitude and y the latitude in EPSG:4326)."""
    at = spark.createDataFrame([(name, tag, float(x), float(y), float(z))], "name string, tag string, px double, py double, up double")
    at = geodesy.with_converted(at, epsg, 25832, "px", "py", "x", "y") if epsg != 25832 else at.withColumns({"x": F.col("px"), "y": F.col("py")})
    place = F.lit(0).cast("long") if points is None else F.lit((points.agg(F.max("i")).first()[0] or -1) + 1)
    one = at.select(place.alias("i"), "name", "tag", (F.col("x") - anchor[0]).alias("east"), (F.col("y") - anchor[1]).alias("north"), "up", *(F.lit(0.0).alias(c) for c in ("yaw", "pitch", "roll")))
    return one if points is None else points.unionByName(one)


def point_set(scene: Scene, sensor: SensorSpec | None, step: float, track: bool, sight: bool) -> DataFrame:
    """The track's frames, and behind them the places the sensor looks at; frames that look past the ground have none and keep their number."""
    frames, (ax, ay), out = _frames(scene, step), scene.anchor, None
    named = lambda df, tag: df.withColumns({"name": F.concat(F.lit(f"{tag}_"), F.col("k").cast("string")), "tag": F.lit(tag)})
    if track:
        out = named(frames, "trajectory").select(F.col("k").alias("i"), "name", "tag", (F.col("x") - ax).alias("east"), (F.col("y") - ay).alias("north"), F.col("z").alias("up"), "yaw", "pitch", "roll")
    if sight and sensor is not None:
        base = (frames.agg(F.max("k")).first()[0] or 0) + 1 if track else 0
        mount = (sensor.mountYawDeg, sensor.mountPitchDeg, sensor.mountRollDeg)
        rays = sensors.cylinder_rays(frames, 1, 0.0).filter("ray = 0") if SHAPES[sensor.type.lower()] == "cylinder" else sensors.boresight(frames, mount)
        hits = sensors.hit_ground(rays.withColumn("ray_id", F.struct("id", "k")), scene.terrain, scene.grid, sensor.maxRangeMeters).filter("hit_x IS NOT NULL")
        zero = [F.lit(0.0).alias(c) for c in ("yaw", "pitch", "roll")]
        found = named(hits, "boresight").select((F.col("k") + base).alias("i"), "name", "tag", (F.col("hit_x") - ax).alias("east"), (F.col("hit_y") - ay).alias("north"), F.col("hit_z").alias("up"), *zero)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else scene.terrain.sparkSession.createDataFrame([], "i long, name string, tag string, east double, north double, up double, yaw double, pitch double, roll double")


@dataclass
class Result:
    """What a run made: paths in the order of writing, messages, areas by name (coverage first), points."""

    written: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    areas: dict[str, DataFrame] = field(default_factory=dict)
    points: DataFrame | None = None
    scene: Scene | None = None


#: Cells of a terrain that is made once which joins may send to every worker, at most. Spark goes by the size of the files, and nine million cells may take 1.5 MB.
BROADCAST_CELLS = 200_000


def made_once(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder: what several outputs read is made once."""
    path = files.scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan(spark: SparkSession, doc: Document, base: str, once: bool = False) -> Result:
    """The areas and points that the document asks for, as DataFrames; no output is written. Areas with one name are united.

    With `once` the heights, the track, areas and points are tables of the shared folder.
    """
    if found := faults_of(doc):
        raise ValueError("; ".join(found))
    scene, o = build(spark, doc, base), doc.outputs
    if once:
        scene.terrain = made_once(scene.terrain, "terrain")
        if scene.grid.width * scene.grid.height > BROADCAST_CELLS:
            scene.terrain = scene.terrain.hint("merge")
        scene.samples = None if scene.samples is None else made_once(scene.samples, "track")
    if scene.samples is not None and scene.samples.filter("q IS NOT NULL").isEmpty():
        scene.samples = scene.samples.drop("q")
    out = Result(scene=scene)
    if (o.coverageGeoTiff or o.unityScene) and scene.samples is not None and doc.sensor is not None:
        out.areas["coverage"] = coverage(scene, doc.sensor, o.frameStepSeconds, o.quality)
    for a in doc.areas:
        mask = scene.taller_than(a.objectsTallerThan) if a.objectsTallerThan is not None else scene.in_class(a.inClass)
        mask = masks.dilate(mask, scene.grid, a.dilateMeters) if a.dilateMeters > 0 else mask
        out.areas[a.name] = masks.union(out.areas[a.name], mask) if a.name in out.areas else mask
    if scene.samples is not None:
        out.points = point_set(scene, doc.sensor, o.pointStepSeconds, o.includeTrajectory, o.includeBoresight)
    if once:
        out.areas = {name: made_once(mask, "area") for name, mask in out.areas.items()}
        out.points = made_once(out.points, "points") if out.points is not None and (o.unityPoints or o.unityScene) else out.points
    return out


def sensor_facts(s: SensorSpec) -> dict:
    """A sensor as a bundle's manifest has it; what its shape lacks is 0, and a cylinder looks straight down."""
    shape = SHAPES[s.type.lower()]
    has = lambda kind, v: v if shape == kind else 0
    mount = (0, -90, 0) if shape == "cylinder" else (s.mountYawDeg, s.mountPitchDeg, s.mountRollDeg)
    return {"type": shape, "name": s.name, "maxRangeMeters": s.maxRangeMeters, **dict(zip(("mountYawDeg", "mountPitchDeg", "mountRollDeg"), mount)),
            "fovHorizontalDeg": has("pyramid", s.fovHorizontalDeg), "fovVerticalDeg": has("pyramid", s.fovVerticalDeg), "halfAngleDeg": has("cone", s.halfAngleDeg), "radiusMeters": has("cylinder", s.radiusMeters)}


def run(spark: SparkSession, doc: Document, base: str) -> Result:
    """Carries a document out."""
    out, o = plan(spark, doc, base, once=True), doc.outputs
    scene, resolve = out.scene, lambda p: p if "://" in p or p.startswith("/") else f"{base.rstrip('/')}/{p}"
    epsg = 25800 + scene.zone
    out.log.append(f"Map: {scene.grid.width} x {scene.grid.height} cells")

    def save(name: str, path: str) -> None:
        out.written += rasters.save_mask(out.areas[name], scene.grid, resolve(path), epsg=epsg)

    for name, mask in out.areas.items():
        out.log.append(f"{'Coverage' if name == 'coverage' and o.coverageGeoTiff else f'Area {name}'}: {mask.count() * scene.grid.pixel ** 2:.0f} m²")
    for a in doc.areas:
        if a.geoTiff:
            save(a.name, a.geoTiff)
    if o.coverageGeoTiff:
        save("coverage", o.coverageGeoTiff)
    if o.unityPoints:
        folder, _, name = resolve(o.unityPoints).rpartition("/")
        made = bundle.write_points(out.points, folder, name, bundle.anchor_facts(spark, scene.anchor, scene.zone))
        out.written += [f"{folder}/{r['name']}" for r in made]
        out.log.append(f"Points: {sum(r['bytes'] for r in made)} bytes in {len(made)} files")
    if o.unityScene:
        out.written += bundle.write_bundle(resolve(o.unityScene), scene.terrain, scene.grid, scene.anchor, scene.zone, list(out.areas.items()), scene.samples, out.points, sensor_facts(doc.sensor) if doc.sensor else None)
    return out
