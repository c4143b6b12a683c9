"""Textured meshes, their files, baked colours, addresses of states."""

import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoloom.operators import catalog, detection, jsoncoords, surface
from geoloom.operators.raster import Grid
from geoloom.sources import meshes, sinks


def binary(points, uv=None):
    return struct.pack("<II", len(points), len(points) // 3) + np.asarray(points, "<f4").tobytes() + (b"" if uv is None else np.asarray(uv, "<f4").tobytes())


def nodes(spark, rows):
    return spark.createDataFrame([(n, bytearray(d), *c) for n, d, c in rows], "node int, data binary, cx double, cy double, cz double")


SQUARE = [(0, 0, 1), (10, 0, 1), (10, 10, 2), (0, 0, 1), (10, 10, 2), (0, 10, 3)]
UV = [(0, 0), (1, 0), (1, 1), (0, 0), (1, 1), (0, 0.25)]


def test_corners_and_numbers(spark):
    rows = [(7, binary(SQUARE, UV), (100.0, 200.0, 5.0)), (3, binary(SQUARE[:3]), (0.0, 0.0, 0.0)), (5, binary([]), (0.0, 0.0, 0.0))]
    found = meshes.corners(nodes(spark, rows)).orderBy("node", "i").collect()
    assert [(r.node, r.i, r.x, r.y, r.z, r.u, r.v) for r in found[:1]] == [(3, 0, 0.0, 0.0, 1.0, None, None)] and len(found) == 9
    assert (found[-1].x, found[-1].y, found[-1].z, found[-1].v) == (100.0, 210.0, 8.0, 0.25)
    kept = meshes.in_area(meshes.corners(nodes(spark, rows)), (100.0, 200.0, 105.0, 220.0))
    got = meshes.numbered(kept.unionByName(meshes.corners(nodes(spark, rows[1:])))).orderBy("vertex").collect()
    # Of the square only the upper triangle has its centroid in the box.
    assert [(r.node, r.i, r.k, r.vertex) for r in got] == [(3, 0, 0, 0), (3, 1, 1, 1), (3, 2, 2, 2), (7, 3, 0, 3), (7, 4, 1, 4), (7, 5, 2, 5)]
    with pytest.raises(PySparkException, match="node 9: a mesh is cut off"):
        meshes.corners(nodes(spark, [(9, binary(SQUARE)[:-1], (0.0, 0.0, 0.0))])).count()
    plain = spark.createDataFrame([(1, bytearray(binary(SQUARE)))], "node int, data binary")
    assert meshes.corners(plain).filter("u IS NULL").count() == 6


def test_glb_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    many = rng.integers(0, 5, (300, 3)).astype(float)
    texture = rng.random((300, 2)).astype(np.float32)
    found = meshes.corners(nodes(spark, [(1, binary(many, texture), (10.0, 0.0, 0.0)), (2, binary(SQUARE), (0.0, 0.0, 0.0))])).repartition(7)
    assert meshes.write_meshes(found, str(tmp_path / "o"), "glb", (10.0, 0.0)) == ["node_1.glb", "node_2.glb"] == sorted(p.name for p in (tmp_path / "o").iterdir())
    back = {(r.path[-5], r.i): r for r in meshes.read_glb(spark, str(tmp_path / "o")).collect()}
    assert len(back) == 306
    for k in range(300):
        r = back["1", k]
        assert (r.x, r.y, r.z) == tuple(many[k]) and abs(r.u - texture[k][0]) < 1e-7
    assert back["2", 5].u is None and (back["2", 5].x, back["2", 5].y, back["2", 5].z) == (-10.0, 10.0, 3.0)
    data = (tmp_path / "o" / "node_2.glb").read_bytes()
    n, = struct.unpack("<I", data[12:16])
    head = json.loads(data[20 : 20 + n])
    # Corners that are alike are one vertex; the bounds are those of the positions; all parts begin at multiples of four.
    assert n % 4 == 0 and len(data) % 4 == 0 and all(v["byteOffset"] % 4 == 0 for v in head["bufferViews"])
    assert head["accessors"][0]["count"] == 4 and head["accessors"][0]["min"] == [-10.0, 0.0, 1.0] and head["accessors"][0]["max"] == [0.0, 10.0, 3.0] and head["accessors"][1]["max"] == [3]
    with pytest.raises(ValueError, match="cut off"):
        meshes.decode_glb(data[:-4])


def test_obj_files(spark, tmp_path):
    found = meshes.corners(nodes(spark, [(4, binary(SQUARE[:3], UV[:3]), (0.0, 0.0, 0.0)), (5, binary(SQUARE[3:]), (0.0, 0.0, 0.0))]))
    assert meshes.write_meshes(found, str(tmp_path), "obj") == ["node_4.mtl", "node_4.obj", "node_5.mtl", "node_5.obj"]
    lines = (tmp_path / "node_4.obj").read_text().splitlines()
    assert lines == ["mtllib node_4.mtl", "o node_4", "v 0.0000 0.0000 1.0000", "v 10.0000 0.0000 1.0000", "v 10.0000 10.0000 2.0000", "vt 0.000000 1.000000", "vt 1.000000 1.000000", "vt 1.000000 0.000000", "usemtl m4", "f 1/1 2/2 3/3"]
    assert (tmp_path / "node_5.obj").read_text().splitlines()[-1] == "f 1 2 3" and "map_Kd tex/node_4.jpg" in (tmp_path / "node_4.mtl").read_text()
    assert meshes.obj_text("x", np.array(SQUARE[:3]), None, base=6).splitlines()[-1] == "f 7 8 9"
    with pytest.raises(ValueError):
        meshes.write_meshes(found, str(tmp_path), "ply")


def test_baked_colours(spark):
    grid = Grid(9, 7, 0.0, 7.0, 1.0)
    flat = grid.cells(spark).withColumn("value", F.when(F.col("col") == 8, 10.0).otherwise(0.0)).filter("row + col <> 3")
    mark = spark.createDataFrame([(0, 0), (2, 4)], "row long, col long")
    got = {(r.row, r.col): (r.r, r.g, r.b) for r in surface.colours(flat, grid, [(mark, (255, 0, 0))], most=4).collect()}
    assert set(got) == {(r, c) for r in range(3) for c in range(4)}
    light = np.array(surface.LIGHT) / np.linalg.norm(surface.LIGHT)
    shade = 0.35 + 0.65 * light[1]
    assert np.allclose(got[1, 1], np.array([0.35, 0.48, 0.28]) * shade) and np.allclose(got[0, 0], np.array([0.35, 0.48, 0.28]) * shade * 0.5 + np.array([0.5, 0, 0]))
    assert surface.colours(flat, grid).count() == 63


def test_addresses(spark):
    tiles = spark.createDataFrame([(512, 5403), (97, 5400)], "east_km int, north_km int")
    of = lambda s, d: [list(r.mirrors) for r in catalog.state_jobs(tiles, s, d).orderBy(F.desc("east_km")).collect()]
    assert of("bw", "lod2")[0] == ["https://opengeodata.lgl-bw.de/data/lod2/LoD2_32_511_5402_2_bw.zip"]
    assert of("bb", "dgm1")[1][0].endswith("/dgm/tif/dgm_33097-5400.zip") and len(of("th", "dgm1")[0]) == 2 and "2014-2019/dgm1_512_5403" in of("th", "dgm1")[0][1]
    assert catalog.state_jobs(tiles, "th", "dom1").first().file == "dom1_32_512_5403_1_th_2020-2025.zip"
    assert tiles.select(catalog.entry_name("hb", "dgm1", F.col("east_km"), F.col("north_km")).alias("n")).collect()[1].n == "dgm1_32097_5400_1_hb.xyz"
    with pytest.raises(KeyError):
        catalog.state_jobs(tiles, "he", "dgm1")


def test_found_features_and_doubt(spark):
    docs = spark.createDataFrame([(1, '{"a": {"lat": 48.5, "lon": 11.5, "alt": 3}, "b": [11.0, 49.0]}')], "id int, json string")
    finds = jsoncoords.find_coordinates(docs)
    texts = [json.loads(r.value) for r in sinks.found_features(finds).collect()]
    one = next(t for t in texts if t["properties"]["sourcePath"] == "$.a")
    assert one["geometry"]["coordinates"] == [11.5, 48.5, 3.0] and one["properties"]["detectedEpsg"] == 4326 and abs(one["properties"]["epsg25832_x"] - 684_700) < 500
    low = detection.with_doubt(spark.createDataFrame([(0.59,), (0.6,), (None,)], "confidence double"))
    assert [r.doubtful for r in low.collect()] == [True, False, True]
    assert 'AUTHORITY["EPSG","25833"]' in sinks.projection_file(33) and '"central_meridian",15' in sinks.projection_file(33)
