"""Tracks in stretches, and texts that must not be mixed up."""

import json
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import addresses
from geoloom.operators import catalog, jsoncoords, scene, trajectory
from geoloom.sources import formats

POSE = "id int, t double, x double, y double, z double, yaw double, pitch double, roll double"


def plain_pose(rows, t):
    """Between the samples around t, fields in the order of POSE; null where one of them is."""
    before, after = [r for r in rows if r[1] <= t], [r for r in rows if r[1] > t]
    a, b = (before[-1] if before else after[0]), (after[0] if after else before[-1])
    part = (t - a[1]) / (b[1] - a[1]) if b[1] > a[1] else 0.0
    out = []
    for k in range(2, 8):
        u, v = a[k], b[k]
        if u is None or v is None:
            out.append(None)
        elif k in (5, 7):
            out.append(u + ((v - u + 180) % 360 - 180) * part)
        else:
            out.append(u + (v - u) * part)
    return out


@pytest.mark.parametrize("per", [trajectory.PER_STRETCH, 7])
def test_poses_in_stretches(spark, per):
    rng = random.Random(4)
    tracks = {i: sorted({round(rng.uniform(0, 100) ** (3 if i == 1 else 1), 3) for _ in range(n)}) for i, n in ((1, 300), (2, 40), (3, 1), (None, 5))}
    rows = [(i, t, *(rng.uniform(-200, 200) if rng.random() > 0.1 else None for _ in range(6))) for i, ts in tracks.items() for t in ts]
    times = [(i, rng.uniform(-10, 110) if k % 5 else rng.choice(ts)) for i, ts in tracks.items() for k in range(120)]
    got = trajectory.poses_at(spark.createDataFrame(rows, POSE), spark.createDataFrame(times, "id int, t double"), per=per).collect()
    want = {}
    for i, t in times:
        want.setdefault((i, t), []).append(plain_pose([r for r in rows if r[0] == i], t))
    assert len(got) == len(times)
    for r in got:
        for u, v in zip(tuple(r)[2:], want[r.id, r.t][0]):
            assert (u is None) == (v is None) and (u is None or math.isclose(u, v, abs_tol=1e-6))


@pytest.mark.parametrize("per", [trajectory.PER_STRETCH, 5])
def test_lengths_in_stretches(spark, per):
    rng = random.Random(8)
    rows = [(i, float(t * (t if i == 1 else 1)), rng.random(), rng.random() if t != 7 else None, 0.0) for i, n in ((1, 60), (2, 23), (None, 4), (5, 1)) for t in range(n)]
    frame = spark.createDataFrame(rows, "id int, t double, x double, y double, z double").withColumn("part", F.lit("a column of the table"))
    so_far, want = {}, {}
    for a, b in zip([None, *rows], rows):
        d = 0.0 if a is None or a[0] != b[0] else math.sqrt(sum(0.0 if u is None or v is None else (u - v) ** 2 for u, v in zip(a[2:], b[2:])))
        so_far[b[0]] = so_far.get(b[0], 0.0) + d
        want[b[0], b[1]] = so_far[b[0]]
    got = trajectory.cumulative(frame, per=per)
    assert got.columns == [*frame.columns, "travelled"]
    assert {(r.id, r.t): round(r.travelled, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert {r.id: round(r.length, 9) for r in trajectory.length(frame, per=per).collect()} == {k: round(v, 9) for k, v in so_far.items()}


@pytest.mark.parametrize("per", [trajectory.PER_STRETCH, 4])
def test_places_in_stretches(spark, per):
    rows = [(i, k * k, -float(k)) for i, n in ((1, 40), (2, 3), (None, 5)) for k in range(n)]
    got = trajectory.timed_by_row(spark.createDataFrame(rows, "id int, k int, t double").repartition(3), "k", 0.5, per=per).collect()
    assert sorted((r.id or 0, r.k, r.t) for r in got) == sorted((i or 0, k, math.isqrt(k) * 0.5) for i, k, _ in rows)
    back = trajectory.placed(spark.createDataFrame(rows, "id int, k int, t double"), "t", per=per)
    assert back.columns == ["id", "k", "t", "place"] and all(r.k == r.t ** 2 for r in back.collect())
    poses = spark.createDataFrame(rows[:9], "id int, k int, t double")
    named = scene.named_frames(poses, "p", F.col("k") % 2 == 0)
    assert sorted(r.name for r in named.collect()) == sorted(f"p_{8 - k}" for k in range(0, 9, 2))


def test_long_tracks_unfold_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "PER_STRETCH", 10)
    s = spark.createDataFrame([(1, 0.0), (1, 25.0), (2, 3.0), (3, 0.0), (3, 9.5)], "id int, t double")
    got = sorted(map(tuple, trajectory.frames(s, 0.5).collect()))
    assert got == sorted([(1, k / 2) for k in range(51)] + [(2, 3.0)] + [(3, k / 2) for k in range(20)])


KML = "<kml><Placemark><name>A</name><Polygon><coordinates>{}</coordinates></Polygon></Placemark></kml>"


def test_placemarks_of_several_texts(spark):
    points = ["11.5,48.1 11.6,48.1 11.6,48.2 11.5,48.2", "9.5,48.1 9.6,48.1 9.6,48.2", "9,48 9,49"]
    texts = spark.createDataFrame([(k, KML.format(p)) for k, p in enumerate(points)], "file int, value string").repartition(3)
    got = {r.file: (r.name, len(r.ring)) for r in scene.placemarks(texts, id_col="file").collect()}
    assert got == {0: ("A", 4), 1: ("A", 3)}
    assert sorted(len(r.ring) for r in scene.placemarks(texts).collect()) == [3, 4]
    assert scene.placemarks(texts.limit(0)).count() == 0


def test_the_last_page_counts(spark):
    link = "dgm1_32_{}_5700_1_nw_{}.tif"
    pages = spark.createDataFrame([(2, link.format(500, 2001) + " " + link.format(501, 2009)), (1, link.format(500, 2010) + " " + link.format(500, 2011)), (3, link.format(501, 2002))], "page int, value string").repartition(3)
    pattern = r"(dgm1_32_(\d{3})_(\d{4})_1_nw_\d{4}\.tif)"
    got = {r.east_km: r.url[-8:-4] for r in formats.url_index(pages, pattern, order="page").collect()}
    assert got == {500: "2001", 501: "2002"}
    one = formats.url_index(pages, pattern).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, formats.url_index(pages.coalesce(1), pattern).collect()))
    grid = "<script>f('{{\"type\": \"FeatureCollection\", \"features\": [{}]}}')</script>"
    feature = lambda label, k: json.dumps({"properties": {"label": label, "id": k}})
    pages = spark.createDataFrame([(1, grid.format(feature("a", 9) + "," + feature("b", 1))), (2, grid.format(feature("a", 3)))], "page int, value string").repartition(2)
    assert {r.label: r.id for r in catalog.page_grid(pages, order="page").collect()} == {"a": 3, "b": 1}


def test_deeply_nested_documents_give_nothing(spark):
    deep = "[" * 100_000 + "]" * 100_000
    docs = spark.createDataFrame([(1, deep), (2, '{"lat": 48.5, "lon": 11.5}'), (3, None), (4, "{"), (5, '{"lat": 1e999, "lon": 2}')], "id int, json string")
    got = [(r.id, r.lat, r.lon) for r in jsoncoords.find_coordinates(docs).collect()]
    assert got == [(2, 48.5, 11.5)]


def test_folders_at_any_depth(spark):
    """A hundred levels, a folder that is listed twice, one that nothing lists, and one whose parent is missing."""
    folder = lambda names, *files: json.dumps({"navigation": [{"name": n} for n in names], "searchresult": {"downloads": [{"fileExtension": "zip", "downloadLink": {"uri": f}} for f in files]}})
    pages, path = [], "top"
    for k in range(100):
        pages.append((path, folder([f"d{k}", f"d{k}", "", "gone"], f"/{k}.zip")))
        path += f"/d{k}"
    pages += [(path, folder([".."], "/last.zip", "https://other.org/x.zip")), ("top/unlisted", folder([], "/no.zip")), ("top/gone/below", folder([], "/no.zip")), ("topper", folder([], "/no.zip"))]
    got = catalog.category_archives(spark.createDataFrame(pages, "path string, value string"), "top", "https://h.org")
    assert sorted(r.url for r in got.collect()) == sorted([f"https://h.org/{k}.zip" for k in range(100)] + ["https://h.org/last.zip", "https://other.org/x.zip"])
    assert catalog.category_archives(spark.createDataFrame([], "path string, value string"), "top", "h").count() == 0


def test_credentials(spark):
    cases = {
        None: (None, None, None, None), "": ("", None, None, ""), "  proxy:8080// ": ("http://proxy:8080", None, None, "  proxy:8080// "),
        "http://u:p@h/": ("http://h", "u", "p", "http://***:***@h/"), "https://u@h": ("https://h", "u", None, "https://***:***@h"),
        "http://a%40b:p%3A+%2B:q@c@h:1": ("http://h:1", "a@b", "p:++:q@c", "http://***:***@h:1"), "u:p@h": ("http://h", "u", "p", "u:p@h"),
        "http://h/x://y": ("http://h/x://y", None, None, "http://h/x://y"), "http://u:%zz@h": ("http://h", "u", "%zz", "http://***:***@h"), "http://:@h": ("http://h", "", "", "http://***:***@h"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string")
    got = rows.select("u", addresses.split_credentials(F.col("u")).alias("s"), addresses.masked(F.col("u")).alias("m")).select("u", "s.*", "m").collect()
    assert {r.u: tuple(r)[1:] for r in got} == cases


def test_failure_codes(spark):
    rows = [("SSL", None, None), ("ssl", None, "got 407"), ("timeout", 500, "x"), ("host", None, None), ("Socket", None, ""), (None, 404, None), (None, None, None), (None, 407, None)]
    df = spark.createDataFrame(rows, "k string, s int, t string")
    assert [r[0] for r in df.select(addresses.failure_code(F.col("k"), F.col("s"), F.col("t"))).collect()] == ["SSL", "PROXY_AUTH", "TIMEOUT", "DNS", "PROXY", "HTTP", "OTHER", "PROXY_AUTH"]


def test_jobs_of_areas_and_height_datasets(spark):
    areas = spark.createDataFrame([(691_500.0, 5_333_200.0, 692_500.0, 5_333_900.0), (691_900.0, 5_333_300.0, 692_100.0, 5_333_400.0)], "min_x double, min_y double, max_x double, max_y double")
    of = lambda s, d: sorted((r.file, r.megabytes) for r in catalog.area_jobs(areas, s, d).collect())
    assert of("by", "laser") == [("32691_5333.laz", 800.0), ("32692_5333.laz", 800.0)]
    assert of("by", "lod2") == [("690_5332.gml", 50.0), ("692_5332.gml", 50.0)]
    # Both kilometres lie in one odd and even cell each: 691 and, for 692, 691 again.
    assert of("bw", "dgm1") == [("dgm1_32_691_5332_2_bw.zip", None)]
    assert catalog.area_jobs(areas.limit(0), "by", "dgm1").count() == 0
    assert catalog.height_dataset("BY", "DGM5") == "dgm5"
    for state, dataset in (("sh", "dom1"), ("xx", "dgm1")):
        with pytest.raises(ValueError):
            catalog.height_dataset(state, dataset)


def test_stretches_of_one_track_are_dealt_to_several_tasks(spark):
    # As with tables of which Spark doesn't know that their spans are small.
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 1000, 1, 4).selectExpr("'flight' AS id", "id * 1e0 AS t")
        parts = trajectory._stretched(rows, "id", 10)
        got = parts.withColumn("n", F.row_number().over(Window.partitionBy("id", "__part").orderBy("t"))).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == 1000 and len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len({(r.task, r["__part"]) for r in got}) == len({r["__part"] for r in got}) == 100
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
