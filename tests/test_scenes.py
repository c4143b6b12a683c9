"""Tracks from files, pictures, bundles and scene documents."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoloom.operators import scenedoc
from geoloom.operators.raster import Grid
from geoloom.sources import bundle, files, geotiff, pictures, rasters, tracks

# --- tracks


def test_the_same_samples_from_text_and_json(spark, tmp_path):
    (tmp_path / "f.csv").write_text('time;easting;"northing";alt;heading;speed;note\n\n0;691000,5;5334000,5;520;90;31,5;x\n10;691100,5;5334000,5;540;;32,0;\nnone;;;;;;y\n20;;5334000,5;1;2;3;\n')
    records = [{"time": 0, "easting": "691000.5", "northing": 5334000.5, "alt": 520, "heading": 90, "speed": 31.5, "note": "x"}, {"time": 10, "easting": 691100.5, "northing": 5334000.5, "alt": 540, "heading": None, "speed": 32.0},
               "no record", {"note": True}, {"time": 20, "northing": 5334000.5, "alt": 1, "heading": 2, "speed": 3}]
    (tmp_path / "f.JSON").write_text("﻿" + json.dumps({"meta": {"rows": []}, "n": 5, "rows": records, "more": [1]}, indent=1))
    (tmp_path / "g.json").write_text(json.dumps(records))
    made = []
    for name in ("f.csv", "f.JSON", "g.json"):
        table = tracks.read_table(spark, str(tmp_path / name))
        mapping = tracks.suggest(table)
        assert mapping.fields == {"time": "time", "easting": "x", "northing": "y", "alt": "z", "heading": "yaw"}
        assert tracks.columns(table) == ["time", "easting", "northing", "alt", "heading", "speed"]
        mapping.fields["Speed"] = "Extra"
        made.append(sorted((r.i, r.t, r.x, r.y, r.z, r.yaw, r.pitch, r.q, tuple(r.extra.items())) for r in tracks.samples(table, mapping).collect()))
    assert made[0] == made[1] == made[2] == [(0, 0.0, 691000.5, 5334000.5, 520.0, 90.0, 0.0, None, (("Speed", 31.5),)), (1, 10.0, 691100.5, 5334000.5, 540.0, 0.0, 0.0, None, (("Speed", 32.0),))]


def test_roles_by_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,c1,c2,c3\n7,11.5,48.1,0\n8,11.6,48.1,1\n")
    (tmp_path / "b.csv").write_text("c1\tc2\n4467000\t5334000\n4467100\t5334000\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    mapped = {n: tracks.suggest(tracks.read_table(spark, str(tmp_path / f"{n}.csv"))) for n in "abc"}
    assert mapped["a"].fields == {"c1": "longitude", "c2": "latitude"}
    assert mapped["b"].fields == {"c1": "x", "c2": "y"} and mapped["b"].epsg == 31468
    assert mapped["c"].fields == {}
    a, b = (tracks.load(spark, str(tmp_path / f"{n}.csv")).orderBy("i").collect() for n in "ab")
    assert [r.t for r in a] == [0.0, 1.0] and abs(a[0].x - 686000) < 2000 and abs(b[1].x - b[0].x - 100) < 0.2
    with pytest.raises(ValueError, match="a position needs"):
        tracks.load(spark, str(tmp_path / "c.csv"))


def test_quaternions_win_and_units(spark, tmp_path):
    h = math.sqrt(0.5)
    (tmp_path / "q.csv").write_text(f"time,x,y,z,yaw,qx,qy,qz,qw\n0,691000,5334000,520,7,0,0,{-2 * h},{2 * h}\n10000,691100,5334000,540,7,0,0,0,1\n20000,691100,5334000,540,1,0,0,,1\n")
    mapping = tracks.Mapping({"time": "Time", "x": "X", "y": "Y", "yaw": "yaw", "qx": "QuatX", "qy": "QuatY", "qz": "QuatZ", "qw": "QuatW"}, time_divisor=1000, angle_to_degrees=180 / math.pi)
    got = tracks.samples(tracks.read_table(spark, str(tmp_path / "q.csv")), mapping).orderBy("i").collect()
    assert [round(r.yaw, 3) for r in got] == [90.0, 0.0, round(180 / math.pi, 3)] and [r.t for r in got] == [0, 10, 20] and got[2].q is None and abs(got[0].q.w - h) < 1e-9


def test_all_faults_of_a_mapping():
    m = tracks.Mapping({"a": "X", "b": "Height", "c": "yaw"}, epsg=99, time_divisor=0, angle_to_degrees=0, interval=0)
    assert m.faults(["a", "b"]) == ["column 'b' has the unknown role 'Height'", "there is no column 'c'", "a position needs x and y, or latitude and longitude", "the time divisor must not be 0", "the factor of angles must not be 0", "the interval must be positive"]
    assert tracks.Mapping({"a": "x", "b": "Y"}, epsg=99).faults() == ["EPSG:99 is not registered"]


def test_records_are_numbered_over_blocks(spark, tmp_path):
    n = 20_000
    (tmp_path / "l.csv").write_text("x,y,k\n" + "".join(f"{691000 + k},5334000,{k}\n" if k % 7 else "-,-,-\n" for k in range(n)))
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert spark.read.text(str(tmp_path / "l.csv")).select("_metadata.file_block_start").distinct().count() > 3
        table = tracks.read_delimited(spark, str(tmp_path / "l.csv"))
        got = table.select("i", F.col("cells")[2]["v"].alias("k")).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)
    assert [r.i for r in got] == list(range(len(got))) and [int(r.k) for r in got] == [k for k in range(n) if k % 7]


def test_empty_files(spark, tmp_path):
    for name, text in (("a.csv", ""), ("b.csv", "x,y\n"), ("c.json", "[]"), ("d.json", '{"a": 1}'), ("e.json", "no json"), ("f.json", "")):
        (tmp_path / name).write_text(text)
        assert tracks.read_table(spark, str(tmp_path / name)).count() == 0
        with pytest.raises(ValueError, match="no records"):
            tracks.load(spark, str(tmp_path / name))


def test_paths_are_written_with_fixed_decimals(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 2.123456789)], "name string, x double, y double").coalesce(1)
    tracks.write_path(rows, str(tmp_path / "o"), ["name", "x", "y"], 2)
    assert next((tmp_path / "o").glob("part-*")).read_text() == "name,x,y\na,1.00,2.12\n"


# --- pictures


def filtered(lines, step, kinds):
    """Rows behind the filters, by their definition."""
    out, above = b"", [0] * len(lines[0])
    for line, kind in zip(lines, kinds):
        row = []
        for i, v in enumerate(line):
            a, c, b = (line[i - step], above[i - step]) * 1 + (above[i],) if i >= step else (0, 0, above[i])
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - [0, a, b, (a + b) // 2, best][kind]) % 256)
        out += bytes([kind, *row])
        above = line
    return out


def png(width, height, bits, colour, raw, extra=b""):
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    packed = zlib.compress(raw)
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + extra + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("colour", [pictures.GREY, pictures.RGB, pictures.GREY_ALPHA, pictures.RGB_ALPHA])
def test_pictures_of_all_kinds(bits, colour):
    rng = np.random.default_rng(bits + colour)
    n, size = pictures.SAMPLES[colour], bits // 8
    values = rng.integers(0, 1 << bits, (11, 7, n)).astype(f">u{size}")
    lines = values.view(np.uint8).reshape(11, -1).tolist()
    data = png(7, 11, bits, colour, filtered(lines, n * size, [k % 5 for k in range(11)]))
    got, share = pictures.decode(data), values.astype(float) / ((1 << bits) - 1)
    for k in range(3):
        assert np.allclose(got[..., k], share[..., k if n >= 3 else 0])
    assert np.allclose(got[..., 3], share[..., -1] if n in (2, 4) else 1.0)
    again = pictures.decode(pictures.encode(values.astype(f"u{size}")))
    assert np.array_equal(again, got)


def test_palettes_and_bad_pictures(spark, tmp_path):
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    data = png(2, 1, 8, pictures.PALETTE, bytes([0, 0, 1]), chunk(b"PLTE", bytes([255, 0, 0, 0, 0, 51])) + chunk(b"tRNS", bytes([0])))
    (tmp_path / "p.png").write_bytes(data)
    got = pictures.read_pictures(spark, str(tmp_path)).orderBy("col").collect()
    assert [(r.row, r.col, r.r, r.g, r.b, r.a) for r in got] == [(0, 0, 1.0, 0.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.2, 1.0)]
    wrong = bytearray(data)
    wrong[50] ^= 1
    for bad, why in ((bytes(wrong), "check sum"), (data[:-6], "cut off"), (b"GIF89a", "not a PNG"), (png(1, 1, 4, 0, b"\0\0"), "not supported"), (png(1, 1, 8, 0, b"\7\0"), "filter 7")):
        with pytest.raises(ValueError, match=why):
            pictures.decode(bad)
    (tmp_path / "p.png").write_bytes(bytes(wrong))
    with pytest.raises(PySparkException, match=r"p\.png: the check sum"):
        pictures.read_pictures(spark, str(tmp_path)).count()


# --- bundles


@pytest.mark.parametrize("most", [bundle.MOST_CELLS, 700])
def test_a_bundle_comes_back(spark, tmp_path, most):
    grid = Grid(30, 50, 500_000.0, 5_400_000.0, 2.0)
    height = lambda r, c: None if (r * 30 + c) % 13 == 0 else 100.25 + r * 2 + c
    cells = spark.createDataFrame([(r, c, height(r, c)) for r in range(50) for c in range(30)], "row long, col long, value double").repartition(5)
    mask = spark.createDataFrame([(3, 4), (49, 29), (20, 0), (70, 2)], "row long, col long")
    samples = spark.createDataFrame([(float(t), 500_010.0 + t, 5_399_950.0, 130.0, 90.0, 0.0, 0.0) for t in range(9)], "t double, x double, y double, z double, yaw double, pitch double, roll double")
    points = spark.createDataFrame([(k, f"p{k}", "a", -0.00001, 2.0, 3.0, 10.0, 20.0, 30.0) for k in range(7)], "i long, name string, tag string, east double, north double, up double, yaw double, pitch double, roll double")
    folder, anchor = str(tmp_path / "b"), (500_030.0, 5_399_950.0)
    sensor = scenedoc.sensor_facts(scenedoc.SensorSpec(type="cone", halfAngleDeg=25))
    paths = bundle.write_bundle(folder, cells, grid, anchor, overlays=[("Rïdge 1", mask), ("none", mask.limit(0))], samples=samples, points=points, sensor=sensor, most_cells=most, most_rows=4 if most == 700 else 100)
    assert paths[-1].endswith("manifest.json") and sorted(p.rpartition("/")[2] for p in paths) == sorted(p.name for p in (tmp_path / "b").iterdir())
    m = bundle.read_manifest(folder)
    if most > 700:
        assert sorted(p.rpartition("/")[2] for p in paths) == ["manifest.json", "overlay_none.png", "overlay_rïdge_1.png", "points.json", "terrain_heights.r32", "trajectory.json"]
    else:
        assert len(m["terrain"]["heightsFiles"]) == 3 and len(m["overlays"][0]["files"]) == 3 and m["pointsFiles"] == ["points_0000.json", "points_0001.json"]
    assert (m["terrain"]["originX"], m["terrain"]["originZTop"], m["terrain"]["minHeight"], m["terrain"]["maxHeight"]) == (-29.0, 49.0, 101.25, 100.25 + 98 + 29)
    assert m["anchor"]["epsg"] == 25832 and abs(m["anchor"]["longitude"] - 9) < 0.01 and m["sensor"]["halfAngleDeg"] == 25 and m["sensor"]["radiusMeters"] == 0
    got = {(r.row, r.col): r.value for r in bundle.read_heights(spark, folder, read_cells=100).collect()}
    assert len(got) == 1500 and all(v == (101.25 if height(*k) is None else height(*k)) for k, v in got.items())
    assert sorted(map(tuple, bundle.read_overlay(spark, folder, "Rïdge 1").collect())) == [(3, 4), (20, 0), (49, 29)] and bundle.read_overlay(spark, folder, "none").count() == 0
    track = bundle.read_track(spark, folder).orderBy("t").collect()
    assert [(r.t, r.x, r.y, r.yawDeg, r.qw, r.hasQuat) for r in track] == [(t, -20.0 + t, 0.0, 90.0, 1.0, False) for t in range(9)]
    point = bundle.read_points(spark, folder).orderBy("name").first()
    assert (point.x, point.unityY, point.unityZ, point.unityEulerX, point.unityEulerY, point.unityEulerZ) == (0.0, 3.0, 2.0, -20.0, 10.0, -30.0)
    assert "-0.0," not in files.read_text(f"{folder}/{m['pointsFile']}")


def test_bundles_that_do_not_fit(spark, tmp_path):
    grid, folder = Grid(4, 3, 0.0, 3.0, 1.0), str(tmp_path / "b")
    empty = spark.createDataFrame([], "row long, col long, value double")
    bundle.write_bundle(folder, empty, grid, (500_000.0, 5_400_000.0))
    assert {r.value for r in bundle.read_heights(spark, folder).collect()} == {0.0} and bundle.read_track(spark, folder).count() == 0 and bundle.read_points(spark, folder).count() == 0
    (tmp_path / "b" / bundle.HEIGHTS).write_bytes(b"\0" * 4 * 8)
    with pytest.raises(ValueError, match="2 rows, the manifest says 3"):
        bundle.read_heights(spark, folder)
    (tmp_path / "b" / bundle.HEIGHTS).write_bytes(b"\0" * 47)
    with pytest.raises(ValueError, match="no whole rows"):
        bundle.read_heights(spark, folder)
    with pytest.raises(ValueError, match="same file name"):
        bundle.write_bundle(folder, empty, grid, (500_000.0, 5_400_000.0), overlays=[("a b", empty), ("A_b", empty)])
    with pytest.raises(ValueError, match="no overlay"):
        bundle.read_overlay(spark, folder, "x")


# --- documents


def test_tolerant_documents():
    doc = scenedoc.parse("""{ // the map
      "MAP": {"TerrainFile": "a//b.tif", "utmzone": 33, "unknown": [1, 2,], },
      /* a sensor */ "sensor": {"Type": "Camera", "fovhorizontaldeg": 70, },
      "areas": [{"name": "x, } y", "inClass": 3, "dilateMeters": 2}], "Map2": null,
      "map": {"terrainFile": "a//b.tif", "classificationFile": "c.tif", "utmZone": 33,}, "trajectory": null,
    }""")
    assert doc.map.terrainFile == "a//b.tif" and doc.map.utmZone == 33 and doc.areas[0].name == "x, } y" and doc.sensor.fovHorizontalDeg == 70 and doc.sensor.type == "Camera" and doc.trajectory is None


def test_all_faults_of_a_document():
    with pytest.raises(ValueError) as e:
        scenedoc.parse('{"map": {"state": "xx", "bbox": [1, 2, 3]}, "sensor": {"type": "laser"}, "areas": [{}, {"name": "b", "inClass": 1}, {"objectsTallerThan": 2}], "outputs": {"coverageGeoTiff": "c.tif", "unityPoints": "p.json", "quality": 0}}')
    for part in ("map.state 'xx'", "map.bbox must be", "sensor.type 'laser'", "areas[0] (area) needs a condition", "areas[1] (b) needs map.classificationFile", "areas[2] (area) needs the surface", "coverageGeoTiff needs", "unityPoints needs", "quality must be positive"):
        assert part in str(e.value)
    for text, why in (("{}", "terrainFile or state"), ("[1]", "must be an object"), ("{", "no JSON"), ('{"map": {"terrainFile": 5}, "areas": {}}', "map.terrainFile must be str; areas must be an array"), ('{"map": {"terrainFile": "a"}, "trajectory": {"mapping": {"fields": {"a": "Q"}}}}', "unknown role 'Q'")):
        with pytest.raises(ValueError, match=why):
            scenedoc.parse(text)


def ridge(folder, name="terrain.tif", high=140.0):
    heights = np.full((60, 60), 100.0, np.float32)
    heights[:, 28:33] = high
    (folder / name).write_bytes(geotiff.encode(heights, 500_000.0, 5_400_060.0, 1.0))


def test_a_document_is_carried_out(spark, tmp_path):
    ridge(tmp_path)
    (tmp_path / "flight.csv").write_text("time,easting,northing,alt,heading\n0,500010,5400030,160,90\n10,500020,5400030,160,90\n")
    doc = scenedoc.parse('{"map": {"terrainFile": "terrain.tif"}, "trajectory": {"file": "flight.csv"}, "sensor": {"type": "cone", "name": "spot", "halfAngleDeg": 10, "maxRangeMeters": 300},'
                         '"outputs": {"coverageGeoTiff": "coverage.tif", "unityPoints": "points.json", "frameStepSeconds": 5, "pointStepSeconds": 5, "quality": 8, "unityScene": "bundle"}}')
    out = scenedoc.run(spark, doc, str(tmp_path))
    assert [p.removeprefix(f"{tmp_path}/") for p in out.written] == ["coverage.tif", "points.json", *(f"bundle/{n}" for n in ("terrain_heights.r32", "overlay_coverage.png", "trajectory.json", "points.json", "manifest.json"))] or len(out.written) == 7
    assert all((tmp_path / p).exists() for p in out.written) and any(x.startswith("Coverage:") for x in out.log)
    meta, seen = geotiff.decode((tmp_path / "coverage.tif").read_bytes())
    assert seen.shape == (60, 60) and (meta["origin_x"], meta["origin_y"], meta["epsg"]) == (500_000.0, 5_400_060.0, 25832)
    cells = {(int(r), int(c)) for r, c in np.argwhere(seen == 1)}
    assert cells == {tuple(r) for r in out.areas["coverage"].collect()} and {c for _, c in cells} <= set(range(0, 33)) and len(cells) > 50
    points = json.loads((tmp_path / "points.json").read_text())["points"]
    assert [p["name"] for p in points] == ["trajectory_0", "trajectory_1", "trajectory_2", "boresight_0", "boresight_1", "boresight_2"]
    assert (points[1]["x"], points[1]["y"], points[1]["z"], points[4]["x"], points[4]["z"]) == (-15.0, 0.0, 160.0, -15.0, 100.0)
    assert bundle.read_manifest(str(tmp_path / "bundle"))["overlays"][0]["name"] == "coverage"
    more = scenedoc.add_point(out.points, spark, out.scene.anchor, "mark", 500_031.0, 5_400_029.0, 7.0, "own")
    last = more.orderBy(F.desc("i")).first()
    assert (last.i, last.name, last.east, last.north, last.up) == (6, "mark", 1.0, -1.0, 7.0)
    far = scenedoc.add_point(None, spark, out.scene.anchor, "geo", 9.0, 48.75, 1.0, epsg=4326).first()
    assert far.i == 0 and abs(far.east + 30) < 1e-3


def test_areas_over_other_grids_and_large_masks(spark, tmp_path):
    ridge(tmp_path)
    wide = np.full((40, 40), 101.0, np.float32)
    wide[10:12, 10:12] = 120.0
    (tmp_path / "surface.tif").write_bytes(geotiff.encode(wide, 499_990.0, 5_400_070.0, 2.0))
    classes = np.zeros((20, 20), np.float32)
    classes[3, 4] = 5
    (tmp_path / "classes.tif").write_bytes(geotiff.encode(classes, 500_000.0, 5_400_060.0, 3.0))
    doc = scenedoc.parse('{"map": {"terrainFile": "terrain.tif", "surfaceFile": "surface.tif", "classificationFile": "classes.tif"}, "areas": [{"name": "tall", "objectsTallerThan": 19}, {"name": "five", "inClass": 5, "dilateMeters": 1, "geoTiff": "out/five.tif"}]}')
    out = scenedoc.run(spark, doc, str(tmp_path))
    tall = {tuple(r) for r in out.areas["tall"].collect()}
    # The surface's four high cells are x 500010 to 500014 and y 5400046 to 5400050; between their centres it is 20 above the ground.
    assert tall == {(r, c) for r in range(11, 13) for c in range(11, 13)}
    core = {(r, c) for r in range(9, 12) for c in range(12, 15)}
    grown = core | {(r + a, c + b) for r, c in core for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))}
    assert {tuple(r) for r in out.areas["five"].collect()} == grown and out.written == [f"{tmp_path}/out/five.tif"]
    parts = rasters.save_mask(out.areas["five"], out.scene.grid, str(tmp_path / "parts.tif"), one_file=100)
    assert len(parts) == 1 and parts[0] == str(tmp_path / "parts" / "raster_0_0.tif")
    assert {(r.row, r.col) for r in rasters.read_rasters(spark, parts[0]).filter("value = 1").collect()} == grown


def test_terrain_by_ending(spark, tmp_path):
    import zipfile

    (tmp_path / "a.xyz").write_text("".join(f"{500_000.5 + c} {5_400_000.5 - r} {r * 10 + c}\n" for r in range(4) for c in range(5)))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "a.xyz", "in.xyz")
    (tmp_path / "tiles").mkdir()
    for k in range(3):
        (tmp_path / "tiles" / f"{k}.tif").write_bytes(geotiff.encode(np.full((4, 5), float(k), np.float32), 500_000.0 + 5 * k, 5_400_001.0, 1.0))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.write(tmp_path / "tiles" / "1.tif", "1.tif")
    want = Grid(5, 4, 500_000.0, 5_400_001.0, 1.0)
    for name in ("a.xyz", "x.zip"):
        cells, grid = scenedoc.load_grid(spark, str(tmp_path / name))
        assert grid == want and {(r.row, r.col): r.value for r in cells.collect()} == {(r, c): r * 10 + c for r in range(4) for c in range(5)}
    cells, grid = scenedoc.load_grid(spark, str(tmp_path / "tiles"))
    assert grid == Grid(15, 4, 500_000.0, 5_400_001.0, 1.0) and {(r.col // 5, r.value) for r in cells.collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    cells, grid = scenedoc.load_grid(spark, str(tmp_path / "t.zip"))
    assert grid.origin_x == 500_005.0 and cells.count() == 20
    cells, grid = scenedoc.load_grid(spark, str(tmp_path / "tiles"), (500_006.0, 5_399_990.0, 500_007.0, 5_400_010.0))
    assert grid == Grid(5, 4, 500_005.0, 5_400_001.0, 1.0) and cells.select("col").distinct().count() == 1
    (tmp_path / "tiles" / "odd.tif").write_bytes(geotiff.encode(np.zeros((2, 2), np.float32), 500_000.3, 5_400_001.0, 1.0))
    with pytest.raises(ValueError, match="one grid"):
        scenedoc.load_grid(spark, str(tmp_path / "tiles"))


def test_a_state_from_its_cache(spark, tmp_path):
    for name, value in (("dgm1", 10.0), ("dom20", 25.0)):
        (tmp_path / "tilecache" / "by" / name).mkdir(parents=True)
        for k in range(2):
            (tmp_path / "tilecache" / "by" / name / f"{k}.tif").write_bytes(geotiff.encode(np.full((20, 10), value + k, np.float32), 690_000.0 + 10 * k, 5_335_020.0, 1.0))
    doc = scenedoc.parse('{"map": {"state": "BY", "bbox": [690004, 5335004, 690016, 5335016], "resolution": 2, "surfaceModel": true}, "areas": [{"objectsTallerThan": 15}]}')
    out = scenedoc.plan(spark, doc, str(tmp_path))
    assert out.scene.grid == Grid(6, 6, 690_004.0, 5_335_016.0, 2.0) and out.areas["area"].count() == 36
    assert {(r.col, round(r.value, 3)) for r in out.scene.terrain.collect()} == {(c, 10.0 if c < 3 else 11.0) for c in range(6)}
