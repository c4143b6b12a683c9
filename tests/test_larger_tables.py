"""What only larger tables or odd rows bring up."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import geometry, jsoncoords, masks, raster, scene, scenedoc, sensors, tiles, trajectory
from geoloom.plans import points, scenes
from geoloom.sources import geotiff, rasters


def test_half_a_turn_is_180(spark):
    rows = spark.sql("SELECT * FROM VALUES (-136e0, 63e0, 180e0), (-136e0, 73e0, 180e0), (180e0, 12e0, 180e0), (180e0, -40e0, 7e0), (179.9e0, 1e0, -179.9e0) AS t(y0, p0, r0)")
    got = trajectory.with_euler(rows.withColumn("q", trajectory.rotation(F.col("y0"), F.col("p0"), F.col("r0"))))
    for r in got.select("y0", "p0", "r0", *(F.round(c, 4).alias(c) for c in ("yaw", "pitch", "roll"))).collect():
        assert (r.yaw, r.pitch, r.roll) == (r.y0, r.p0, r.r0)


def test_tile_names_of_many_kilometres(spark):
    files = ["32689_5333_20_DOM.tif", "689_5333.tif", "321004_5541_20_DOM.tif", "328912_10793_20_DOM.tif", "3268_5333.tif", "32_5333.tif"]
    r = spark.createDataFrame([(f,) for f in files], "f string").select(*tiles.tile_from_file(F.col("f"))).collect()
    assert [tuple(x) for x in r] == [(689, 5333), (689, 5333), (1004, 5541), (8912, 10793), (3268, 5333), (None, None)]
    items = ["dgm1_32_550_5800_1_ni", "dgm1_32_1004_5541_1_ni", "dgm1_32_8912_10793_1_ni", "dgm1_32_55_5800_1_ni"]
    r = spark.createDataFrame([(f,) for f in items], "f string").select(*tiles.tile_from_item(F.col("f"))).collect()
    assert [tuple(x) for x in r] == [(550, 5800), (1004, 5541), (8912, 10793), (None, None)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_polygon_is_read_once(spark, tmp_path):
    spark.sql("SELECT id AS c_custkey FROM range(400)").write.parquet(f"{tmp_path}/customer.parquet")
    got = points.polygon_contains(spark, str(tmp_path))
    assert "regexp_extract" not in plan_of(got)
    assert 0 < got.count() < 400


def test_documents_of_one_file_are_dealt_to_all_cores(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id", """concat('{"site": {"lat": 48.', id, ', "lon": 11.5}}') AS json""")
    found = jsoncoords.find_coordinates(docs)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in found.collect()) == list(range(40))


def test_first_blocks_of_points_where_many_overlap(spark):
    rnd = random.Random(5)
    spots = [(i, rnd.choice([rnd.uniform(-700, 2600), rnd.randint(-7, 26) * 100.0]), rnd.uniform(-700, 2600)) for i in range(400)]
    blocks = []
    for rank in range(120):
        x, y, w, h = rnd.uniform(-500, 2000), rnd.randint(-5, 20) * 100.0, rnd.uniform(50, 1500), rnd.choice([100.0, 700.0, 1300.0])
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        if rank % 3 == 0:
            corners = [(x, y), (x + w, y + h / 3), (x + w / 2, y + h), (x + w / 3, y + h / 2)]
        blocks.append((rank * 7 % 120, f"b{rank}", corners))
    rows = spark.createDataFrame(blocks, f"rank int, name string, ring {geometry.RING}")
    got = {r.id: r.name for r in scene.blocks_of_points(spark.createDataFrame(spots, "id int, x double, y double"), rows, 500.0).select("id", "name").collect()}

    def holds(ring, x, y):
        return sum((py > y) != (qy > y) and x < px + (qx - px) * (y - py) / (qy - py) for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    for i, x, y in spots:
        assert got[i] == next((n for _, n, ring in sorted(blocks) if holds(ring, x, y)), None)


def test_blocks_behind_one_that_covers_a_cell_are_left_out(spark):
    blocks = spark.range(300).selectExpr("CAST(id AS INT) AS rank", "concat('b', id) AS name").withColumn("ring", geometry.ring_from_box(-100.0, -100.0, 1100.0, 900.0))
    kept = {(r["__cx"], r["__cy"]): r["count"] for r in scene.blocks_in_cells(blocks, 500.0).groupBy("__cx", "__cy").count().collect()}
    assert len(kept) == 12 and kept[0, 0] == kept[1, 0] == 1 and kept[2, 0] == kept[0, 1] == 300


def test_union_of_overlapping_boxes(spark):
    rnd = random.Random(8)
    boxes = [(x, y, x + rnd.choice([0, 400, 9_000, 70_000]), y + rnd.choice([0, 700, 5_000, 40_000])) for x, y in ((rnd.uniform(-30_000, 90_000), rnd.choice([rnd.uniform(-9_000, 60_000), 3_000.0])) for _ in range(60))]
    df = spark.createDataFrame(boxes, "min_x double, min_y double, max_x double, max_y double")
    for km in (1, 2):
        got = [tuple(r) for r in tiles.union_tiles(df, km).collect()]
        want = {(e * km, n * km) for x0, y0, x1, y1 in boxes for e in range(math.floor(x0 / km / 1000), math.ceil(x1 / km / 1000)) for n in range(math.floor(y0 / km / 1000), math.ceil(y1 / km / 1000))}
        assert len(got) == len(want) and set(got) == want


def test_areas_that_cover_each_other_are_not_unfolded(spark):
    # 2,000 areas of a million tiles each: two thousand million rows if each were unfolded.
    df = spark.range(2000).selectExpr("0e0 AS min_x", "0e0 AS min_y", "1000000e0 + id AS max_x", "1000000e0 AS max_y")
    assert tiles.union_tiles(df).count() == 1002 * 1000


def test_rays_that_run_the_same_way_are_marched_once(spark, monkeypatch):
    g = raster.Grid(20, 20, 0.0, 20.0, 1.0)
    cells = g.cells(spark).withColumn("value", F.lit(5.0))
    rays = spark.range(600).selectExpr("id AS ray_id", "5.5e0 + id % 3 AS x", "5.5e0 AS y", "9e0 AS z", "0e0 AS dx", "0e0 AS dy", "-1e0 AS dz")
    marched, march = [], sensors._hits
    monkeypatch.setattr(sensors, "_hits", lambda ways, *rest: (marched.append(ways.count()), march(ways, *rest))[1])
    got = sensors.hit_ground(rays, cells, g, 50.0).collect()
    assert marched == [3] and len(got) == 600
    assert all((r.hit_x, r.hit_y, r.hit_z) == (r.x, 5.5, 5.0) for r in got)


def joined_by(df) -> set[str]:
    """The kinds of join that have run."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return {kind for kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin") if kind in text}


def test_whole_rasters_meet_by_a_shuffle_however_small_their_files_are(spark, tmp_path, monkeypatch):
    g = raster.Grid(400, 300, 0.0, 300.0, 1.0)
    flat = scenedoc.made_once(g.cells(spark).withColumn("value", F.lit(5.0)), "cells")
    tall = masks.taller_than(flat.withColumn("value", F.when(F.col("col") < 7, 8.0).otherwise(5.0)), flat, 3.0)
    mask, given = scenedoc.made_once(tall, "area"), []
    monkeypatch.setattr(rasters, "save_grid", lambda cells, *rest, **more: given.append(cells))
    monkeypatch.setattr(rasters, "write_rasters", lambda cells, *rest, **more: given.append(cells))
    rasters.save_mask(mask, g, f"{tmp_path}/mask.tif")
    rasters.write_mask(mask, g.cells(spark), str(tmp_path), 0.0, 300.0, 1.0)
    assert joined_by(tall) == {"SortMergeJoin"} and {tuple(r) for r in tall.collect()} == {(r, c) for r in range(300) for c in range(7)}
    for cells in given:
        assert joined_by(cells) == {"SortMergeJoin"} and cells.groupBy("value").count().orderBy("value").collect() == [(0.0, 300 * 393), (1.0, 300 * 7)]
    assert len(given) == 2


def test_a_large_terrain_is_not_sent_to_every_worker(spark, tmp_path):
    found = {}
    for name, (h, w) in {"large": (500, 450), "small": (50, 40)}.items():
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(np.full((h, w), 7.0, np.float32), 0.0, float(h), 1.0))
        made = scenedoc.plan(spark, scenedoc.parse(f'{{"map": {{"terrainFile": "{name}.tif"}}}}'), str(tmp_path), once=True).scene
        spots = spark.range(40).selectExpr("id", "id + 0.5e0 AS x", "3.5e0 AS y")
        at = raster.nearest(spots, made.terrain, made.grid)
        found[name] = joined_by(at)
        assert [r.value for r in at.collect()] == [7.0] * 40
    assert found == {"large": {"SortMergeJoin"}, "small": {"BroadcastHashJoin"}}


def test_scene_areas_over_rasters_of_many_files(spark, tmp_path, monkeypatch):
    n = 205_300
    spark.range(n).selectExpr("id AS o_orderkey", "id * 13 % 997 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    save, made = rasters.save_grid, []

    def in_many(*given, **more):
        made.append(save(*given, **{**more, "one_file": 1000}))
        return made[-1]

    monkeypatch.setattr(rasters, "save_grid", in_many)
    got = {r.area: (r.cells, r.places) for r in scenes.scene_areas(spark, str(tmp_path)).collect()}
    tall = [(k // 200, k % 200) for k in range(n) if k * 13 % 997 * 7 % 23 >= 20]
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2]
    grown = {(k // 200 + i, k % 200 + j) for k in range(n) if k * 31 % 17 == 3 for i, j in near}
    grown = [(r, c) for r, c in grown if 0 <= r <= (n - 1) // 200 and 0 <= c < 200]
    assert [len(paths) for paths in made] == [2] * 5
    assert got == {name: (len(cells), sum(r * 7 + c for r, c in cells)) for name, cells in (("tall", tall), ("class", grown))}
