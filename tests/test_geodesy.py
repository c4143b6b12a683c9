"""Golden vectors of coordinate conversion, detection, angles, polygons and tiles."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps
from geoloom.operators import detection, geometry, jsoncoords, tiles

LAT, LON = 48.137222, 11.575556


@pytest.mark.parametrize("epsg, x, y, tolerance", [
    (25832, 691607.8605, 5334760.3881, 1e-3), (31468, 4468517.5446, 5333330.4531, 2e-3), (31467, 3691761.0929, 5336456.5594, 2e-3), (3857, 1288584.9996, 6129714.1232, 1e-3),
])
def test_golden_vectors(spark, epsg, x, y, tolerance):
    r = geodesy.with_projected(spark.createDataFrame([(LAT, LON)], "lat double, lon double"), epsg).first()
    assert abs(r.x - x) < tolerance and abs(r.y - y) < tolerance


def test_zone_33(spark):
    r = geodesy.with_projected(spark.createDataFrame([(52.52, 13.405)], "lat double, lon double"), 25833).first()
    assert abs(r.x - 391779.2593) < 1e-3 and abs(r.y - 5820072.1591) < 1e-3


@pytest.mark.parametrize("epsg", sorted(geodesy.NAMES))
def test_round_trips(spark, epsg):
    df = spark.createDataFrame([(47.5, 7.1), (54.9, 13.2), (50.0, 10.0)], "la double, lo double")
    r = steps.apply(df, [*geodesy.from_geo(epsg, "la", "lo", "x", "y"), *geodesy.to_geo(epsg, "x", "y", "lat", "lon")]).collect()
    assert all(abs(v.la - v.lat) < 1e-7 and abs(v.lo - v.lon) < 1e-7 for v in r)


def test_prefix_and_unknown(spark):
    r = geodesy.with_converted(spark.createDataFrame([(691607.8605, 5334760.3881)], "a double, b double"), 25832, 4647, "a", "b", "x", "y").first()
    assert abs(r.x - 32691607.8605) < 1e-3
    with pytest.raises(KeyError, match="25832"):
        geodesy.known(1234)


@pytest.mark.parametrize("a, b, epsg, swapped", [
    (48.137222, 11.575556, 4326, False), (11.575556, 48.137222, 4326, True), (691607.86, 5334760.39, 25832, False), (5334760.39, 691607.86, 25832, True),
    (4468517.54, 5333330.45, 31468, False), (32691607.86, 5334760.39, 4647, False), (1288585.0, 6129714.1, 3857, False),
])
def test_detection(spark, a, b, epsg, swapped):
    r = detection.best_reading(spark.createDataFrame([(a, b)], "a double, b double")).first()
    assert (r.epsg, r.swapped) == (epsg, swapped) and abs(r.lat - LAT) < 1e-5 and abs(r.lon - LON) < 1e-5


# One place (or none) in the spellings that have to be understood.
SPELLINGS = ["48°08'14.0\"N 11°34'32.0\"E", "N48°08'14\" E11°34'32\"", "48 08 14 N, 11 34 32 E", "11 34 32 E, 48 08 14 N", "48d08m14s N; 11d34m32s E", "48°08′14″N/11°34′32″E", "48,137222° 11,575556°",
             "48.137222N 11.575556E", "N 48 08.2333 E 11 34.5333", "48:08:14 N 11:34:32 E"]
NO_ANGLES = ["", "Sensor 12 34", "48°08'14\"N", "N E", "98°N 11°E", "1 2 3 4 5 N", "48 | 11 | 5 N", "a48N 11E", None]


def test_dms(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SPELLINGS)] + [(100 + i, t) for i, t in enumerate(NO_ANGLES)], "id int, text string")
    got = {r.id: (r.lat, r.lon) for r in jsoncoords.with_angles(rows, "text").collect()}
    for i, text in enumerate(SPELLINGS):
        assert abs(got[i][0] - 48.137222) < 1e-4 and abs(got[i][1] - 11.575556) < 1e-4, text
    assert all(got[100 + i] == (None, None) for i in range(len(NO_ANGLES)))
    south = spark.createDataFrame([("33°51'S 151°12'E",), ("-33.85° 151.2°",), ("W 70°40' S 33°27'",)], "text string")
    assert [(round(r.lat, 3), round(r.lon, 3)) for r in jsoncoords.with_angles(south, "text").collect()] == [(-33.85, 151.2), (-33.85, 151.2), (-33.45, -70.667)]


def test_dms_format(spark):
    r = spark.createDataFrame([(48.137222, -11.575556)], "lat double, lon double").selectExpr(f"{geodesy.dms('lat', 'N', 'S')} AS a", f"{geodesy.dms('lon', 'E', 'W')} AS b").first()
    assert (r.a, r.b) == ("48°08'14.00\"N", "11°34'32.00\"W")


def test_messy_json(spark):
    doc = """{ // site
      "site": {"lat": 48.137, "lon": 11.576, "alt": 520.0}, "junk": [1, 2], "screen": [1920, 1080],
      "utm": {"rechtswert": "691607,86", "hochwert": "5334760,39"}, "arr": [11.576, 48.137, 521.3], "txt": "48°08'14\\"N 11°34'32\\"E", "two": "691607.86 5334760.39",}"""
    r = {x.path: x for x in jsoncoords.find_coordinates(spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "id long, json string")).collect()}
    assert set(r) == {"$.site", "$.utm", "$.arr", "$.txt", "$.two"}
    assert all(abs(x.lat - 48.137) < 1e-3 and abs(x.lon - 11.576) < 1e-3 for x in r.values())
    assert (r["$.site"].z, r["$.arr"].z, r["$.utm"].epsg) == (520.0, 521.3, 25832)


def test_json_shapes(spark):
    """Repeated names, own names, texts in arrays, heights with a comma, comments inside texts, and values at the top."""
    docs = ['{"lat": 1, "lat": 48.1, "lon": 11.5, "ele": "47,5"}', '{"Breitengrad": 48.1, "l": 11.5}', '["48.1 11.5", "n", true, {"x": null}]', '{"a": "// 48.1", "b": "48.1; 11.5; 520"}', '"48.1 11.5"',
            '{"lat": "200,5", "lon": "400,5"}', '[48.1, 11.5', '{"a": {"b": [[11.5, 48.1]]}}', '{"p": {"lat": 48.1}, "lon": 11.5}', "[NaN, 1]", '{"e": 691607.86, "n": 5334760.39, "z": 4}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, json string")
    options = jsoncoords.Options(extra={"lat": ["BREITENGRAD"], "lon": ["L"]})
    got = {r.id: (r.path, r.kind, round(r.lat, 1), round(r.lon, 1), r.z) for r in jsoncoords.find_coordinates(rows, options=options).collect()}
    assert got == {
        0: ("$", "geo", 48.1, 11.5, 47.5), 1: ("$", "geo", 48.1, 11.5, None), 2: ("$[0]", "bare", 48.1, 11.5, None), 3: ("$.b", "bare", 48.1, 11.5, 520.0), 4: ("$", "bare", 48.1, 11.5, None),
        7: ("$.a.b[0]", "bare", 48.1, 11.5, None), 10: ("$", "named", 48.1, 11.6, 4.0)}


def test_assumed_system(spark):
    found = jsoncoords.find_coordinates(spark.createDataFrame([(1, '{"p": [4468517.54, 5333330.45]}')], "id long, json string"), options=jsoncoords.Options(assume_epsg=31468))
    r = found.first()
    assert r.epsg == 31468 and abs(r.lat - LAT) < 1e-5


def test_polygons(spark):
    df = spark.createDataFrame([("SRID=25832;POLYGON Z((0 0 1, 10 0 1, 10 10 1, 0 10 1, 0 0 1))", "<kml xmlns='x'><a><coordinates>0,0 10,0,5 10,10 0,0</coordinates></a></kml>")], "wkt string, kml string")
    r = df.select(geometry.ring_from_wkt(F.col("wkt")).alias("w"), geometry.ring_from_kml(F.col("kml")).alias("k")).first()
    assert [(p.x, p.y) for p in r.w] == [(0, 0), (10, 0), (10, 10), (0, 10)] and len(r.k) == 3
    ring = geometry.ring_from_points([(0, 0), (10, 0), (10, 10), (0, 10)])
    at = lambda x, y: geometry.polygon_contains(ring, F.lit(x), F.lit(y))
    thin = geometry.ring_from_points([(-5, 4), (20, 5), (-5, 5)])
    box = tuple(F.lit(float(v)) for v in (0, 0, 10, 10))
    r = spark.range(1).select(at(5.0, 5.0), at(15.0, 5.0), geometry.polygon_meets_box(thin, box), geometry.polygon_meets_box(ring, tuple(F.lit(float(v)) for v in (20, 20, 30, 30)))).first()
    assert tuple(r) == (True, False, True, False)


def test_tiles(spark):
    df = tiles.with_tile(spark.createDataFrame([(691607.86, 5334760.39)], "x double, y double"), grid_km=2)
    assert df.select("east_km", "north_km").first() == (690, 5334)
    box = spark.createDataFrame([(689500.0, 5333500.0, 691500.0, 5334500.0)], "min_x double, min_y double, max_x double, max_y double")
    assert tiles.covering_tiles(box).count() == 6
    cell = tiles.odd_even_cell(F.lit(514), F.lit(5403))
    assert spark.range(1).select(*cell).first() == (513, 5402)
    r = spark.range(1).select(*tiles.tile_from_file(F.lit("32689_5333_20_DOM.tif")), *tiles.tile_from_file(F.lit("none"))).first()
    assert tuple(r) == (689, 5333, None, None)
