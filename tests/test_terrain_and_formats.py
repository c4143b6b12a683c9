"""Rasters, masks, trajectories, sensors, files and rules on small examples."""

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import imagery, masks, raster, rules, sensors, trajectory
from geoloom.operators.raster import Grid
from geoloom.sources import formats, geotiff, sinks


def test_bilinear(spark):
    g = Grid(2, 2, 100.0, 200.0, 1.0)
    cells = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0)], "row long, col long, value double")
    at = spark.createDataFrame([(1, 101.0, 199.0), (2, 100.1, 199.9), (3, 99.0, 199.0)], "id int, x double, y double")
    assert {r.id: r.value for r in raster.bilinear(at, cells, g).collect()} == {1: 25.0, 2: 10.0, 3: None}
    gap = cells.withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 1), None).otherwise(F.col("value")))
    assert {r.id: r.value for r in raster.bilinear(at, gap, g).collect()}[2] == 10.0


def test_bilinear_of_repeated_rows(spark):
    g = Grid(2, 2, 100.0, 200.0, 1.0)
    cells = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0)], "row long, col long, value double")
    at = spark.createDataFrame([(1, 101.0, 199.5), (1, 101.0, 199.5), (1, 101.0, 199.5), (1, 100.5, 199.5), (2, 101.4, 198.9), (2, 101.4, 198.9), (None, 5.0, None)], "id int, x double, y double")
    got = sorted((r.id or 0, round(r.value, 9) if r.value is not None else -1) for r in raster.bilinear(at, cells, g).collect())
    assert got == [(0, -1), (1, 10.0), (1, 15.0), (1, 15.0), (1, 15.0), (2, 31.0), (2, 31.0)]


def test_tiles_are_sampled_on_their_own(spark):
    cells = spark.createDataFrame([(e, n, r, c, e * 1000.0 + n * 100 + r * 10 + c) for e in (0, 1) for n in (0, 2) for r in (0, 1) for c in (0, 1)], "east_km int, north_km int, row long, col long, value double")
    at = spark.createDataFrame([(1, 500.0, 500.0), (2, 999.0, 250.0), (3, 1001.0, 250.0), (4, 1500.0, 2500.0), (5, 500.0, 1500.0)], "id int, x double, y double")
    got = {r.id: (r.east_km, r.north_km, r.value) for r in raster.tiled(at, cells, 1, 500.0).collect()}
    # Half way between four centres; at the edge the tile's own outermost centres.
    assert got == {1: (0, 0, 5.5), 2: (0, 0, 11.0), 3: (1, 0, 1010.0), 4: (1, 2, 1205.5), 5: (0, 1, None)}
    assert raster.mosaic(cells, 1, 500.0, Grid(4, 2, 0.0, 1000.0, 500.0)).orderBy("row", "col").select("value").toPandas().value.tolist() == [0, 1, 1000, 1001, 10, 11, 1010, 1011]


def test_rays_over_gaps_and_hills(spark):
    """The coarse comparison loses no hit: against marching every step in Python."""
    import random

    g, rng = Grid(50, 40, 0.0, 40.0, 1.0), random.Random(5)
    height = {(r, c): 5 * math.sin(r / 5) + 4 * math.cos(c / 4) for r in range(40) for c in range(50) if not (20 < r < 24 and 30 < c < 35)}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in height.items()], "row long, col long, value double")

    def ground(x, y):
        if not (0 <= x <= 50 and 0 <= y <= 40):
            return None
        fr, fc = min(max(40 - y - 0.5, 0), 39), min(max(x - 0.5, 0), 49)
        r0, c0 = math.floor(fr), math.floor(fc)
        near = [(min(r0 + a, 39), min(c0 + b, 49), (fr - r0 if a else 1 - fr + r0) * (fc - c0 if b else 1 - fc + c0)) for a in (0, 1) for b in (0, 1)]
        values = [height.get((r, c)) for r, c, _ in near]
        return sum(v * w for v, (_, _, w) in zip(values, near)) if None not in values else height.get((round(fr), round(fc)))

    rays, wanted = [], {}
    for i in range(60):
        d = [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(-0.3, 0.4)]
        size = math.sqrt(sum(v * v for v in d))
        x, y, z, dx, dy, dz = rng.uniform(5, 45), rng.uniform(5, 35), rng.uniform(10, 20), *(v / size for v in d)
        rays.append((i, x, y, z, dx, dy, dz))
        for k in range(1, int(80 / 0.75) + 2):
            h = ground(x + dx * k * 0.75, y + dy * k * 0.75)
            if h is None:
                break
            if z + dz * k * 0.75 <= h:
                wanted[i] = k
                break
    frame = spark.createDataFrame(rays, "ray_id int, x double, y double, z double, dx double, dy double, dz double")
    hits = {r.ray_id: r for r in sensors.hit_ground(frame, cells, g, 80.0).filter("hit_x is not null").collect()}
    assert hits.keys() == wanted.keys() and len(wanted) > 10
    for i, k in wanted.items():
        along = math.dist((hits[i].hit_x, hits[i].hit_y), rays[i][1:3])
        flat = math.hypot(*rays[i][4:6])
        assert (k - 0.5) * 0.75 * flat - 1e-6 <= along <= k * 0.75 * flat + 1e-6


def test_flight_coverage(spark):
    cells, g = ridge(spark)
    s = spark.createDataFrame([(1, 0.0, 500040.0, 5400100.0, 130.0, 0.0, 0.0, 0.0), (1, 2.0, 500060.0, 5400100.0, 130.0, 0.0, 0.0, 0.0), (2, 0.0, 500150.0, 5400050.0, 130.0, 0.0, 0.0, 0.0), (2, 1.0, 500150.0, 5400050.0, 130.0, 0.0, 0.0, 0.0)],
                              "id int, t double, x double, y double, z double, yaw double, pitch double, roll double")
    seen = sensors.flight_coverage(s, lambda p: sensors.cylinder_rays(p, 9, 5.0), cells, g, 500.0, 1.0).collect()
    assert len(seen) == len({tuple(r) for r in seen}) and {r.id for r in seen} == {1, 2}
    assert {r.col // 10 for r in seen if r.id == 1} >= {3, 4, 5, 6} and {r.col // 10 for r in seen if r.id == 2} <= {14, 15}


def test_quaternions_between_samples(spark):
    turn = lambda c: trajectory.rotation(F.col(c), F.lit(0.0), F.lit(0.0))
    s = spark.createDataFrame([(1, 4.0, 0.0, 350.0), (1, 14.0, 100.0, 10.0), (1, 24.0, 100.0, 20.0)], "id int, t double, x double, yaw double")
    s = s.withColumns({c: F.lit(0.0) for c in ("y", "z", "pitch", "roll")}).withColumn("q", F.when(F.col("t") < 20, turn("yaw")))
    times = spark.createDataFrame([(1, 9.0), (1, 19.0)], "id int, t double")
    got = {r.t: r for r in trajectory.with_euler(trajectory.poses_at(s, times).withColumnRenamed("yaw", "y0"), yaw="yaw2", pitch="p2", roll="r2").collect()}
    assert abs((got[9.0].yaw2 + 180) % 360 - 180) < 1e-6 and got[19.0].q is None and got[19.0].y0 == 15
    seen = trajectory.viewer_poses(s, spark.createDataFrame([(1, 5.0), (1, 15.0), (1, -1.0)], "id int, t double"))
    facts = {r.t: r for r in trajectory.with_euler(seen).collect()}
    assert abs((facts[5.0].yaw + 180) % 360 - 180) < 1e-6 and abs(facts[15.0].yaw - 15) < 1e-6 and facts[-1.0].x == 0


def test_xyz(spark):
    text = spark.createDataFrame([(f"{729002.5 + 5 * c} {5433007.5 - 5 * r} {r * 3 + c}",) for r in range(2) for c in range(3) if (r, c) != (1, 1)] + [("bad line",)], "value string")
    cells, g = raster.from_points(formats.parse_xyz(text))
    assert g == Grid(3, 2, 729000.0, 5433010.0, 5.0) and cells.count() == 5


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
def test_geotiff(spark, tmp_path, compression):
    grid = np.arange(35, dtype=np.float32).reshape(5, 7) * 1.5
    grid[2, 3] = np.nan
    data = geotiff.encode(grid, 500000, 5400000, 2.0)
    if compression != "none":
        order, t = geotiff.tags(data)
        start = t[geotiff.STRIP_AT][0]
        raw = data[start:]
        packed = zlib.compress(raw) if compression == "deflate" else lzw_encode(raw)
        data = bytearray(data[:start] + packed)
        for k in range(13):
            at = 10 + 12 * k
            tag, = struct.unpack("<H", data[at : at + 2])
            if tag == geotiff.COMPRESSION:
                data[at + 8 : at + 12] = struct.pack("<I", 8 if compression == "deflate" else 5)
            if tag == geotiff.STRIP_BYTES:
                data[at + 8 : at + 12] = struct.pack("<I", len(packed))
    (tmp_path / "a.tif").write_bytes(bytes(data))
    rows = {(r.row, r.col): r.value for r in geotiff.read_cells(spark, str(tmp_path)).collect()}
    assert len(rows) == 35 and rows[2, 3] is None and rows[4, 6] == 51.0
    meta = geotiff.read_metadata(spark, str(tmp_path)).first()
    assert (meta.width, meta.height, meta.origin_x, meta.origin_y, meta.pixel) == (7, 5, 500000, 5400000, 2)
    with pytest.raises(ValueError):
        geotiff.tags(b"no TIFF at all")


def lzw_encode(data: bytes) -> bytes:
    """Clear codes often enough that every code has nine bits."""
    bits = ""
    for i in range(0, len(data), 100):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[i : i + 100])
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw_repeats():
    assert geotiff.lzw(int(f"{256:09b}{65:09b}{258:09b}{259:09b}{257:09b}000", 2).to_bytes(6, "big")) == b"AAAAAA"


def test_zip(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("readme.txt", "nothing")
        z.writestr(zipfile.ZipInfo("a.xyz"), "1 2 3\n4 5 6\n", zipfile.ZIP_DEFLATED)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    assert formats.read_zipped_xyz(spark, str(tmp_path)).count() == 2
    entries = {r.name: r for r in formats.read_zip_directories(spark, str(tmp_path)).collect()}
    assert {r.name: r for r in formats.read_zip_directories(spark, str(tmp_path), whole_bytes=1).collect()} == entries
    e = entries["a.xyz"]
    assert formats.zip_entry(raw.getvalue(), e.header, e.packed, e.method) == b"1 2 3\n4 5 6\n"


def test_flight_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text("time;easting;northing;alt;heading;speed\n0;691000,5;5334000,5;520;90;31,5\n1;691031,5;5334000,5;;90;x\n")
    df = formats.read_flight_table(spark, str(tmp_path / "f.csv"))
    roles = formats.suggest_roles(df.columns)
    r = formats.with_roles(df, roles).orderBy("t").collect()
    assert r[0].x == 691000.5 and r[1].z is None and r[0].extra == {"speed": 31.5} and r[1].extra == {}


def test_metalink_and_stac(spark):
    xml = '<metalink xmlns="urn:x"><file name="a.tif"><url>u1</url><url priority="2">u2</url></file><file name="b.tif"></file></metalink>'
    assert [tuple(r) for r in formats.metalink_jobs(spark.createDataFrame([(xml,)], "value string")).collect()] == [("a.tif", ["u1", "u2"])]
    page = '{"features": [{"id": "dgm1_32_550_5800_1_ni", "properties": {"datetime": "2020-01-01T00:00:00Z"}, "assets": {"Tif": {"href": "h"}}}, {"id": "x", "properties": {}, "assets": {}}]}'
    got = formats.stac_items(spark.createDataFrame([(page,)], "value string")).collect()
    assert len(got) == 2 and got[0].assets == {"Tif": "h"} and got[1].taken is None


def test_png_and_world_file():
    data = sinks.png_grey(np.array([[0, 1], [2, np.nan]], np.float32))
    assert data.startswith(b"\x89PNG") and zlib.decompress(data[data.index(b"IDAT") + 4 : -16]) == b"\0\x00\x80\0\xff\x00"
    assert sinks.world_file(100, 200, 2).split() == ["2", "0", "0", "-2", "101.0000", "199.0000"]


def test_masks(spark):
    g = Grid(10, 10, 0.0, 100.0, 10.0)
    one = spark.createDataFrame([(5, 5)], "row long, col long")
    assert masks.dilate(one, g, 15.0).count() == 13 and masks.invert(one, g).count() == 99
    corner = spark.createDataFrame([(0, 0)], "row long, col long")
    assert masks.dilate(corner, g, 10.0).count() == 3
    assert masks.area(one, g).first() == (1, 100.0)
    with pytest.raises(ValueError):
        masks.same_grid(g, Grid(9, 10, 0.0, 100.0, 10.0))


def test_trajectory(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 350.0, 0.0, 0.0), (1, 10.0, 100.0, 0.0, 20.0, 10.0, 0.0, 0.0)], "id int, t double, x double, y double, z double, yaw double, pitch double, roll double")
    times = spark.createDataFrame([(1, 5.0), (1, -3.0), (1, 99.0), (1, 10.0)], "id int, t double")
    r = {x.t: x for x in trajectory.poses_at(s, times).collect()}
    assert r[5.0].yaw % 360 == 0 and r[5.0].x == 50 and r[-3.0].x == 0 and r[99.0].x == 100 and r[10.0].z == 20
    assert abs(trajectory.length(s).first().length - 101.98) < 0.05
    assert trajectory.frames(s, 3.0).count() == 4


def ridge(spark):
    g = Grid(200, 200, 500_000.0, 5_400_200.0, 1.0)
    return g.cells(spark).withColumn("value", F.when(F.col("col").between(95, 105), 140.0).otherwise(100.0)), g


@pytest.mark.parametrize("kind, low, high", [("cone", 9.0, 11.8), ("cylinder", 13.0, 16.5)])
def test_footprints(spark, kind, low, high):
    cells, g = ridge(spark)
    pose = spark.createDataFrame([(1, 500040.0, 5400100.0, 130.0, 0.0, 0.0, 0.0)], "id int, x double, y double, z double, yaw double, pitch double, roll double")
    rays = sensors.cone_rays(pose, 24) if kind == "cone" else sensors.cylinder_rays(pose, 24, 15.0)
    seen = sensors.seen_cells(sensors.hit_ground(rays.withColumn("ray_id", F.col("ray")), cells, g, 500.0), g).collect()
    far = max(math.hypot(r.col + 0.5 - 40, r.row + 0.5 - 100) for r in seen)
    assert low <= far <= high


def test_line_of_sight(spark):
    cells, g = ridge(spark)
    pairs = spark.createDataFrame([(1, 500050.0, 5400100.0, 110.0, 500150.0, 5400100.0, 110.0), (2, 500050.0, 5400100.0, 150.0, 500150.0, 5400100.0, 150.0), (3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                  "id int, x double, y double, z double, tx double, ty double, tz double")
    assert {r.id: r.visible for r in sensors.can_see(pairs, cells, g).collect()} == {1: False, 2: True, 3: True}


def test_rules(spark):
    spec = {"version": 1, "organize": [{"collection": "trees", "match": {"name_regex": "^veg_tree_"}}, {"collection": "veg", "match": {"name_regex": "^veg_"}}, {"collection": "tagged", "match": {"prop": {"name": "k", "equals": "v"}}}]}
    df = spark.createDataFrame([("veg_tree_1", {}), ("veg_x", {"k": "v"}), ("b", {"k": "v"}), ("b", {})], "name string, props map<string,string>")
    got = [r[0] for r in df.select(rules.first_match(rules.load_rules(spec), F.col("name"), props=F.col("props"))).collect()]
    assert got == ["trees", "veg", "tagged", None]
    with pytest.raises(ValueError):
        rules.load_rules({"version": 2})


def test_images(spark):
    px = spark.createDataFrame([("sky", r, c, 0.2, 0.4, 0.9) for r in range(4) for c in range(4)] + [("grass", r, c, 0.2, 0.6, 0.1) for r in range(4) for c in range(4)], "image string, row int, col int, r double, g double, b double")
    got = {r.image: r for r in imagery.summary(px).collect()}
    assert got["sky"].ground_pixel_ratio == 0 and got["grass"].ground_pixel_ratio == 1
    assert {r.image: r.verdict for r in imagery.verdicts(px).collect()} == {"sky": "EMPTY", "grass": "EMPTY"}
    assert {r.rmse for r in imagery.rmse(px, px).collect()} == {0.0}
