"""Scene bundles: a folder with heights, overlays, a track, points, and a manifest that names them.

Tasks write hidden files, each from the rows of one part; when all are written, the driver names
them, the manifest last, so a reader that finds a manifest finds all files. Heights are 32-bit floats
row by row from the north; gaps are flattened to the lowest height. A grid of up to MOST_CELLS cells
is one file; a larger one is a file per band of rows, which the manifest lists. Tracks and points are
files of up to MOST_ROWS rows.

Cases: a grid without a height has heights of 0; a mask's cells outside of the grid are ignored;
without a track or points the manifest names no such file; an older bundle in the folder loses its
manifest first; overlays whose names give one file name are refused.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators.raster import Grid
from geoloom.sources import files, pictures

#: Cells of a file of heights or of an overlay, and rows of a file of samples or points, at most. Rows that a reading task takes at once.
MOST_CELLS, MOST_ROWS, READ_CELLS = 25_000_000, 1_000_000, 1 << 20
# Names of the files, colours of overlays in turn, and the members of samples and points.
HEIGHTS, TRACK, POINTS, MANIFEST = "terrain_heights.r32", "trajectory.json", "points.json", "manifest.json"
COLOURS = [(46, 204, 113), (231, 76, 60), (52, 152, 219), (241, 196, 15), (155, 89, 182)]
FRAME = "local ENU meters; unity = (east, up, north), left-handed Y-up"
WRITTEN = "part long, name string, temp string, bytes long"


def overlay_file(name: str) -> str:
    return f"overlay_{''.join(c.lower() if c.isalnum() else '_' for c in name)}.png"


def part_name(name: str, part: int, parts: int) -> str:
    stem, _, end = name.rpartition(".")
    return name if parts == 1 else f"{stem}_{part:04d}.{end}"


def _grids(folder: str, job: str, names: list[str], width: int, height: int, band: int, parts: int, low: float):
    """Writes one file per (what, part): heights (what 0) or an overlay, from the cells of its band of rows."""

    def finish(what, part, cells):
        if what == 0:
            return [cells.astype("<f4").tobytes()]
        return [pictures.encode(cells.astype(np.uint8))]

    def run(batches):
        made, now, cells = [], None, None

        def close():
            if now is not None:
                temp = files.hidden(folder, job)
                made.append((now[1], part_name(names[now[0]], now[1], parts), temp, files.write(temp, finish(*now, cells))))

        for batch in batches:
            what, part = batch.column("what").to_numpy(), batch.column("part").to_numpy()
            rows, cols, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
            edges = np.flatnonzero((np.diff(what) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                if (int(what[a]), int(part[a])) != now:
                    close()
                    now = (int(what[a]), int(part[a]))
                    cells = np.full((min(band, height - now[1] * band), width), low if now[0] == 0 else 0, np.float32)
                ok = ~np.isnan(values[a:b])
                cells[rows[a:b][ok] - now[1] * band, cols[a:b][ok]] = values[a:b][ok]
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["part", "name", "temp", "bytes"])

    return run


def _lists(folder: str, job: str, head: str):
    """Writes one JSON file per part: the head, and an array of the rows' texts. The files get their names when all are known."""

    def run(batches):
        made, now, held = [], None, []

        def texts():
            yield head.encode()
            yield b",\n".join(held)
            yield b"]}\n"

        def close():
            if now is not None:
                temp = files.hidden(folder, job)
                made.append((now, "", temp, files.write(temp, texts())))
                held.clear()

        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                if part != now:
                    close()
                    now = part
                held.append(text.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["part", "name", "temp", "bytes"])

    return run


def _rounded(name: str, c, digits: int = 4):
    """Rounded, and never minus zero."""
    return (F.round(c, digits) + 0.0).alias(name)


def sample_texts(samples: DataFrame, anchor: tuple[float, float]):
    """t and the JSON text of each sample; positions are around the anchor."""
    q = lambda c, rest: _rounded(f"q{c}", F.coalesce(F.col(f"q.{c}"), F.lit(rest)), 6)
    has = "q" in samples.columns
    turned = [q(c, 1.0 if c == "w" else 0.0) if has else F.lit(1.0 if c == "w" else 0.0).alias(f"q{c}") for c in "xyzw"]
    flag = (F.col("q").isNotNull() if has else F.lit(False)).alias("hasQuat")
    text = F.to_json(F.struct(_rounded("t", F.col("t")), _rounded("x", F.col("x") - anchor[0]), _rounded("y", F.col("y") - anchor[1]), _rounded("z", F.col("z")),
                              *(_rounded(f"{c}Deg", F.col(c)) for c in ("yaw", "pitch", "roll")), *turned, flag))
    return samples.select("t", text.alias("text"))


def point_texts(points: DataFrame):
    """i and the JSON text of each point (name, tag, and east, north, up around the anchor, with angles)."""
    e, n, u = (F.col(c) for c in ("east", "north", "up"))
    text = F.to_json(F.struct("name", "tag", _rounded("x", e), _rounded("y", n), _rounded("z", u), _rounded("unityX", e), _rounded("unityY", u), _rounded("unityZ", n),
                              _rounded("unityEulerX", -F.col("pitch")), _rounded("unityEulerY", F.col("yaw")), _rounded("unityEulerZ", -F.col("roll"))))
    return points.select("i", text.alias("text"))


def anchor_facts(spark: SparkSession, anchor: tuple[float, float], zone: int) -> dict:
    epsg = 25833 if zone == 33 else 25832
    at = geodesy.with_geographic(spark.createDataFrame([tuple(map(float, anchor))], "x double, y double"), epsg).select("lat", "lon").first()
    return {"utmEasting": anchor[0], "utmNorthing": anchor[1], "utmZone": zone, "epsg": epsg, "latitude": round(at["lat"], 8), "longitude": round(at["lon"], 8)}


def _stage(rows: DataFrame, order: list[str], run) -> list[dict]:
    """Writes parts; returns part, name, temp and bytes of each, in order. Only names come to the driver."""
    made = rows.repartition(*order[:-1] or order).sortWithinPartitions(*order).mapInArrow(run, WRITTEN).collect()
    return sorted((r.asDict() for r in made), key=lambda r: (r["name"], r["part"]))


def _list_files(texts: DataFrame, order: str, folder: str, job: str, name: str, head: str) -> list[dict]:
    """Stages the files of a list (text, part and what orders it); one without rows where there are none."""
    made = _stage(texts, ["part", order], _lists(folder, job, head))
    if not made:
        temp = files.hidden(folder, job)
        made = [{"temp": temp, "bytes": files.write(temp, [head.encode(), b"]}\n"])}]
    return [r | {"part": k, "name": part_name(name, k, len(made))} for k, r in enumerate(made)]


def write_points(points: DataFrame, folder: str, name: str, anchor: dict, job: str | None = None, most: int = MOST_ROWS, publish: bool = True) -> list:
    """Writes points (i, name, tag, east, north, up, yaw, pitch, roll) as JSON."""
    job = job or uuid.uuid4().hex
    texts = point_texts(points).withColumn("part", F.floor(F.col("i") / most))
    head = json.dumps({"anchor": {**anchor, "frame": FRAME}})[:-1] + ', "points": ['
    made = _list_files(texts, "i", folder, job, name, head)
    if publish:
        files.publish([(r["temp"], f"{folder.rstrip('/')}/{r['name']}") for r in made])
        files.discard(folder, job)
    return made


def write_bundle(folder: str, cells: DataFrame, grid: Grid, anchor: tuple[float, float], zone: int = 32, overlays: list[tuple[str, DataFrame]] = (), samples: DataFrame | None = None,
                 points: DataFrame | None = None, sensor: dict | None = None, most_cells: int = MOST_CELLS, most_rows: int = MOST_ROWS) -> list[str]:
    """Writes a bundle and returns the paths of its files, the manifest last. overlays: names and sets of cells (row, col)."""
    spark, folder, job = cells.sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    names = [HEIGHTS, *(overlay_file(n) for n, _ in overlays)]
    if len(set(names)) < len(names):
        raise ValueError("two overlays have the same file name")
    facts = cells.agg(F.min("value"), F.max("value")).first()
    low, high = (0.0, 0.0) if facts[0] is None else map(float, facts)
    band = max(1, most_cells // grid.width)
    parts = -(-grid.height // band)
    try:
        shape = "what int, row long, col long, value float"
        inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)
        rows = spark.createDataFrame([(w, k * band, 0, None) for w in range(len(names)) for k in range(parts)], shape)
        rows = rows.unionByName(cells.filter("value IS NOT NULL").select(F.lit(0).alias("what"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("float")))
        for k, (_, mask) in enumerate(overlays, 1):
            rows = rows.unionByName(mask.select(F.lit(k).alias("what"), F.col("row").cast("long"), F.col("col").cast("long"), F.lit(255.0).cast("float").alias("value")))
        rows = rows.filter(inside).withColumn("part", F.floor(F.col("row") / band))
        made = _stage(rows, ["what", "part", "row"], _grids(folder, job, names, grid.width, grid.height, band, parts, low))
        track_file, points_file = "", ""
        anchored = anchor_facts(spark, anchor, zone)
        if samples is not None:
            texts = sample_texts(samples, anchor)
            t0, t1, n = samples.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
            count = -(-n // most_rows) if n and t1 > t0 else 1
            part = F.least(F.floor((F.col("t") - F.lit(t0)) / F.lit(t1 - t0) * count), F.lit(count - 1)) if count > 1 else F.lit(0).cast("long")
            own = _list_files(texts.withColumn("part", part), "t", folder, job, TRACK, '{"samples": [')
            made, track_file = made + own, own[0]["name"]
        if points is not None:
            own = write_points(points, folder, POINTS, anchored, job, most_rows, publish=False)
            made, points_file = made + own, own[0]["name"]
        listed = lambda name: [r["name"] for r in sorted(made, key=lambda r: r["part"]) if r["name"] in (name, part_name(name, r["part"], 2))]
        several = lambda name, one: {} if len(listed(name)) < 2 else {one: listed(name)}
        x, y = grid.origin_x + 0.5 * grid.pixel - anchor[0], grid.origin_y - 0.5 * grid.pixel - anchor[1]
        manifest = {
            "version": 1, "anchor": anchored,
            "terrain": {"heightsFile": listed(HEIGHTS)[0], **several(HEIGHTS, "heightsFiles"), "width": grid.width, "height": grid.height, "pixelSize": grid.pixel, "originX": round(x, 4), "originZTop": round(y, 4),
                        "minHeight": round(low, 2), "maxHeight": round(high, 2), "orthoFile": ""},
            "overlays": [{"name": n, "file": listed(f)[0], **several(f, "files"), **dict(zip("rgb", COLOURS[k % len(COLOURS)])), "visibleByDefault": True} for k, ((n, _), f) in enumerate(zip(overlays, names[1:]))],
            "trajectoryFile": track_file, **several(TRACK, "trajectoryFiles"), "pointsFile": points_file, **several(POINTS, "pointsFiles"), **({"sensor": sensor} if sensor else {}),
        }
        files.clear(folder, (MANIFEST,))
        temp = files.hidden(folder, job)
        files.write(temp, [json.dumps(manifest, indent=2).encode()])
        moves = [(r["temp"], f"{folder}/{r['name']}") for r in made]
        files.publish([*moves, (temp, f"{folder}/{MANIFEST}")])
        return [new for _, new in moves] + [f"{folder}/{MANIFEST}"]
    finally:
        files.discard(folder, job)


def read_manifest(folder: str) -> dict:
    return json.loads(files.read_text(f"{folder.rstrip('/')}/{MANIFEST}"))


def _floats(folder: str, width: int):
    def run(batches):
        for batch in batches:
            for name, at, first, rows in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "first", "rows"))):
                source = files.opened(f"{folder}/{name}")
                values = np.frombuffer(source.read(at * width * 4, rows * width * 4), "<f4")
                source.close()
                r, c = (i.ravel() for i in np.indices((rows, width), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(r + first + at), pa.array(c), pa.array(values)], ["row", "col", "value"])

    return run


def read_heights(spark: SparkSession, folder: str, read_cells: int = READ_CELLS) -> DataFrame:
    """row, col and value of a bundle's heights, read by parts of the files. Files that don't have the manifest's size are refused."""
    folder, terrain = folder.rstrip("/"), read_manifest(folder)["terrain"]
    width, height, parts, row = terrain["width"], terrain["height"], [], 0
    for name in terrain.get("heightsFiles", [terrain["heightsFile"]]):
        source = files.opened(f"{folder}/{name}")
        size = source.size
        source.close()
        if size % (4 * width):
            raise ValueError(f"{name}: no whole rows of {width} heights")
        n, step = size // (4 * width), max(1, read_cells // width)
        parts += [(name, at, row, min(step, n - at)) for at in range(0, n, step)]
        row += n
    if row != height:
        raise ValueError(f"the heights have {row} rows, the manifest says {height}")
    deal = spark.createDataFrame(parts, "name string, at long, first long, rows long").repartition(max(1, len(parts)))
    return deal.mapInArrow(_floats(folder, width), "row long, col long, value float")


def _listed(spark: SparkSession, folder: str, one: str, many: str, member: str, shape: str) -> DataFrame:
    manifest, folder = read_manifest(folder), folder.rstrip("/")
    names = manifest.get(many, [manifest[one]] if manifest[one] else [])
    if not names:
        return spark.createDataFrame([], shape)
    texts = spark.read.text([f"{folder}/{n}" for n in names], wholetext=True)
    return texts.select(F.inline(F.from_json("value", f"STRUCT<{member}: ARRAY<STRUCT<{shape}>>>")[member]))


def read_track(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle's samples, with positions around the anchor."""
    return _listed(spark, folder, "trajectoryFile", "trajectoryFiles", "samples", "t DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, yawDeg DOUBLE, pitchDeg DOUBLE, rollDeg DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, hasQuat BOOLEAN")


def read_points(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(spark, folder, "pointsFile", "pointsFiles", "points", "name STRING, tag STRING, x DOUBLE, y DOUBLE, z DOUBLE, unityX DOUBLE, unityY DOUBLE, unityZ DOUBLE, unityEulerX DOUBLE, unityEulerY DOUBLE, unityEulerZ DOUBLE")


def read_overlay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """row and col of the cells inside an overlay."""
    folder, manifest = folder.rstrip("/"), read_manifest(folder)
    found = next((o for o in manifest["overlays"] if o["name"] == name), None)
    if found is None:
        raise ValueError(f"there is no overlay {name!r}")
    names, width = found.get("files", [found["file"]]), manifest["terrain"]["width"]
    # Bands have the same number of rows, but for the last one.
    band = -(-manifest["terrain"]["height"] // len(names)) if len(names) == 1 else None
    out = None
    for k, n in enumerate(names):
        pixels = pictures.read_pictures(spark, f"{folder}/{n}").filter("r > 0.5").select("row", "col")
        if k == 0 and len(names) > 1:
            source = files.opened(f"{folder}/{n}")
            band = int.from_bytes(source.read(20, 4), "big")
            source.close()
        pixels = pixels.select((F.col("row") + k * band).alias("row"), "col")
        out = pixels if out is None else out.unionByName(pixels)
    return out.filter(F.col("col") < width)
