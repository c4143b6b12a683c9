"""The raster data source and sink, and files that are read by ranges."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from geoloom.sources import files, geotiff, rasters


def tiff(grid, kind="f4", packed=None, tile=None, strip=2, predictor=1, order="<", nodata=None, epsg=None, pixel=2.0):
    """A raster in any of the forms that are understood, written field by field."""
    h, w = grid.shape
    cells = grid.astype(np.dtype(kind).newbyteorder(order))
    parts = [np.pad(cells[r : r + tile, c : c + tile], ((0, max(0, r + tile - h)), (0, max(0, c + tile - w)))) for r in range(0, h, tile) for c in range(0, w, tile)] if tile else [cells[r : r + strip] for r in range(0, h, strip)]
    body, at, places, sizes = b"", 8, [], []
    for p in parts:
        if predictor == 2:
            lane = p.view(np.dtype(f"u{p.itemsize}").newbyteorder(order)).astype(f"u{p.itemsize}")
            p = np.concatenate([lane[:, :1], np.diff(lane, axis=1)], axis=1).astype(np.dtype(f"u{p.itemsize}").newbyteorder(order))
        data = {None: lambda x: x, "deflate": zlib.compress, "lzw": lzw}[packed](p.tobytes())
        places.append(at + len(body))
        sizes.append(len(data))
        body += data
    form, bits = {"f": 3, "u": 1, "i": 2}[kind[0]], int(kind[1]) * 8
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits]), (259, 3, [{None: 1, "deflate": 8, "lzw": 5}[packed]]), (317, 3, [predictor]), (339, 3, [form]),
              (33550, 12, [pixel, pixel, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0])]
    fields += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 3, [strip]), (279, 4, sizes)]
    fields += [(42113, 2, f"{nodata}\0".encode())] if nodata is not None else []
    fields += [(34735, 3, [1, 1, 0, 1, 3072, 0, 1, epsg])] if epsg else []
    at += len(body)
    begin, behind, directory = at + 2 + 12 * len(fields) + 4, b"", struct.pack(order + "H", len(fields))
    for tag, code, v in sorted(fields, key=lambda f: f[0]):
        raw = v if code == 2 else struct.pack(f"{order}{len(v)}{geotiff.FIELD[code]}", *v)
        directory += struct.pack(order + "HHI", tag, code, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", begin + len(behind)))
        behind += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + directory + struct.pack(order + "I", 0) + behind


def lzw(data: bytes) -> bytes:
    """Codes of 9 bits, the table cleared before it would need more."""
    codes = [256]
    for k in range(0, len(data), 200):
        codes += [*data[k : k + 200], 256]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def seen(df):
    return {(r.path.rpartition("/")[2], r.row, r.col): r.value for r in df.collect()}


FORMS = [("f4", None, None, 1, "<"), ("f4", "deflate", None, 1, ">"), ("f4", "lzw", 16, 1, "<"), ("u1", "lzw", None, 2, "<"), ("u2", "deflate", 16, 2, ">"), ("u4", None, 16, 1, ">"), ("i2", "deflate", None, 2, "<"), ("i4", "lzw", 16, 2, "<")]


def test_all_forms(spark, tmp_path):
    rng = np.random.default_rng(3)
    grids = {}
    for k, (kind, packed, tile, predictor, order) in enumerate(FORMS):
        low, high = (-100, 100) if kind[0] in "fi" else (0, 200)
        grids[f"{k}.tif"] = grid = rng.integers(low, high, (37, 23)).astype(np.float32)
        (tmp_path / f"{k}.tif").write_bytes(tiff(grid, kind, packed, tile, 5, predictor, order, nodata=7))
    for part in (1, rasters.PART_BYTES):
        got = seen(rasters.read_rasters(spark, str(tmp_path), part_bytes=part))
        assert len(got) == len(FORMS) * 37 * 23
        assert all(got[n, r, c] == (None if g[r, c] == 7 else g[r, c]) for n, g in grids.items() for r in range(37) for c in range(23))


def reads(monkeypatch):
    counted = []
    own = files.Ranges.read
    monkeypatch.setattr(files.Ranges, "read", lambda self, at, n: counted.append((at, n)) or own(self, at, n))
    return counted


@pytest.mark.parametrize("zipped", [None, zipfile.ZIP_STORED])
def test_a_box_reads_only_its_blocks(tmp_path, monkeypatch, zipped):
    grid = np.arange(160 * 160, dtype=np.float32).reshape(160, 160)
    data, path = tiff(grid, tile=16, nodata=-1), tmp_path / "a.tif"
    if zipped is not None:
        path = tmp_path / "a.zip"
        with zipfile.ZipFile(path, "w", zipped) as z:
            z.writestr("notes.txt", "x" * 1000)
            z.writestr("in/a.tif", data)
    else:
        path.write_bytes(data)
    # Rows 20 to 29 and columns 40 to 49: one tile high, two wide.
    box = (1000 + 40 * 2.0, 2000 - 30 * 2.0, 1000 + 50 * 2.0, 2000 - 20 * 2.0)
    for part in (3000, 1 << 30):
        counted = reads(monkeypatch)
        reader = rasters.GeoTiffReader({"path": str(tmp_path), "box": ",".join(map(str, box)), "partbytes": str(part)})
        tasks = reader.partitions()
        batches = [b for t in tasks for b in reader.read(t)]
        got = {(r, c): v for b in batches for r, c, v in zip(*(b.column(k).to_pylist() for k in ("row", "col", "value")))}
        assert got == {(r, c): grid[r, c] for r in range(20, 30) for c in range(40, 50)}
        assert sum(n == 16 * 16 * 4 for _, n in counted) == 2
        assert sum(n for _, n in counted) < len(data) / 4 + 2 * formats_tail(zipped)
        monkeypatch.undo()


def formats_tail(zipped):
    from geoloom.sources import formats

    return 0 if zipped is None else 4 * formats.ZIP_TAIL


def test_filters_narrow_the_box(tmp_path):
    reader = rasters.FilteringReader({"path": str(tmp_path), "box": "0,0,100,100"})
    asked = [GreaterThanOrEqual(("x",), 20.0), LessThan(("x",), 40), EqualTo(("y",), 7.0), EqualTo(("path",), "a")]
    assert list(reader.pushFilters(asked)) == asked and reader.box == (20.0, 7.0, 40.0, 7.0)
    for bad in ("1,2,3", "5,0,1,1"):
        with pytest.raises(ValueError):
            rasters.parsed_box(bad)


def test_filters_of_a_query(spark, tmp_path):
    grid = np.arange(64 * 64, dtype=np.float32).reshape(64, 64)
    (tmp_path / "a.tif").write_bytes(tiff(grid, tile=16))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rasters.read_rasters(spark, str(tmp_path)).filter("x < 1010 AND y >= 1990 AND value > 1")
        assert seen(got) == {("a.tif", r, c): grid[r, c] for r in range(5) for c in range(5) if grid[r, c] > 1}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives(spark, tmp_path):
    rng = random.Random(2)
    grid = np.array([[rng.random() for _ in range(90)] for _ in range(70)], np.float32)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("stored.tif"), tiff(grid, tile=32))
        z.writestr("deflated.TIFF", tiff(grid * 2, strip=9), zipfile.ZIP_DEFLATED)
        z.writestr("other.txt", "no raster")
    for part in (1, 20_000, 1 << 30):
        got = seen(rasters.read_rasters(spark, str(tmp_path), part_bytes=part))
        assert len(got) == 2 * 70 * 90 and all(got["two.zip!stored.tif", r, c] == grid[r, c] and got["two.zip!deflated.TIFF", r, c] == grid[r, c] * 2 for r in range(70) for c in range(90))


def test_a_large_archive_is_not_loaded(tmp_path, monkeypatch):
    """An archive of over 64 MB: a box reads its directory, a header and one tile."""
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z, z.open("ballast.bin", "w", force_zip64=True) as f:
        for _ in range(70):
            f.write(b"\1" * (1 << 20))
    with zipfile.ZipFile(tmp_path / "large.zip", "a") as z:
        z.writestr("a.tif", tiff(np.ones((256, 256), np.float32), tile=64))
    counted = reads(monkeypatch)
    reader = rasters.GeoTiffReader({"path": str(tmp_path / "large.zip"), "box": "1000,1990,1010,2000"})
    assert sum(b.num_rows for t in reader.partitions() for b in reader.read(t)) == 25
    assert sum(n for _, n in counted) < 1 << 20


def test_deflated_entries_by_parts():
    data = bytes(random.Random(1).choices(range(40), k=3_000_000))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", data)
        info = z.infolist()[0]
    entry = files.Deflated(files.Held(packed.getvalue()), info.header_offset, info.compress_size, info.file_size)
    for at, n in [(0, 10), (5, 100), (1_500_000, 20), (1_400_000, 900_000), (2_999_990, 50), (0, 3)]:
        assert entry.read(at, n) == data[at : at + n]


def test_bad_files(spark, tmp_path):
    assert rasters.read_rasters(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.tif").write_bytes(b"no raster at all")
    with pytest.raises(PySparkException, match=r"a\.tif: not a classic TIFF"):
        rasters.read_rasters(spark, str(tmp_path)).count()
    with pytest.raises(FileNotFoundError):
        files.listed(str(tmp_path / "none"), (".tif",))


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, tmp_path, packed):
    """Two rasters over several files, with gaps, cells given twice and one raster that has a third of nothing."""
    cells = spark.range(600 * 700).selectExpr("id div 700 AS row", "id % 700 AS col", "CASE WHEN id % 11 > 0 THEN id % 5003 / 2e0 END AS value", "CASE WHEN id % 700 < 300 THEN 'a/b' END AS name", "1 AS raster")
    again = spark.createDataFrame([(5, 6, -5.0, "a/b", 1), (5, 6, 1e6, "a/b", 1)], cells.schema)
    path = str(tmp_path / "out")
    rasters.write_rasters(cells.unionByName(again), path, 1000.0, 2000.0, 0.5, raster="name", side=256, epsg=25832, packed=packed)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 3 * 2 + 3 * 2 and not any(n.startswith(".") for n in names) and "a%2Fb_0_0.tif" in names
    meta = geotiff.metadata((tmp_path / "out" / "a%2Fb_2_1.tif").read_bytes())
    assert meta == {"width": 44, "height": 88, "origin_x": 1128.0, "origin_y": 1744.0, "pixel": 0.5, "nodata": -9999.0, "epsg": 25832}
    back = rasters.read_rasters(spark, path).select(rasters.file_name(F.col("path")).alias("name"), F.floor((2000 - F.col("y")) / 0.5).alias("row"), F.floor((F.col("x") - 1000) / 0.5).alias("col"), "value")
    want = cells.select(F.coalesce("name", F.lit("null")).alias("name"), "row", "col", F.when((F.col("row") == 5) & (F.col("col") == 6), 1e6).otherwise(F.col("value")).cast("float").alias("value"))
    in_files = back.filter("value is not null")
    assert in_files.exceptAll(want.select(in_files.columns)).count() == 0 and want.filter("value is not null").count() == in_files.count()


def test_overwrite_append_mask_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    cells = spark.range(300).selectExpr("id div 20 AS row", "id % 20 AS col")
    mask = spark.createDataFrame([(0, 0), (3, 4), (3, 4)], "row long, col long")
    rasters.write_mask(mask, cells, path, 0.0, 100.0, 1.0, raster=None)
    got = seen(rasters.read_rasters(spark, path))
    assert len(got) == 300 and {k[1:] for k, v in got.items() if v == 1} == {(0, 0), (3, 4)} and sum(got.values()) == 2
    flat = cells.withColumn("value", F.lit(3.5)).withColumn("name", F.lit("n"))
    rasters.write_rasters(flat, path, 0.0, 100.0, 1.0, raster="name")
    assert len(list((tmp_path / "out").iterdir())) == 2
    rasters.write_rasters(flat, path, 0.0, 100.0, 1.0, raster="name", mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["n_0_0.tif"]
    rasters.write_rasters(flat.limit(0), str(tmp_path / "none"), 0.0, 0.0, 1.0)
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
    with pytest.raises(ValueError):
        rasters.write_rasters(flat, path, 0.0, 0.0, 1.0, side=100)


def test_a_long_raster_that_is_one_file_is_no_square_in_memory(tmp_path):
    import tracemalloc

    n = 8000
    writer = rasters.GeoTiffWriter({"path": str(tmp_path), "side": str(8192), "height": str(n), "width": "3", "file": "long.tif"}, False)
    row = np.arange(n, dtype=np.int64)
    columns = [pa.array(["raster"] * n), *(pa.array(np.full(n, v)) for v in (0.0, 50.0, 2.0)), *[pa.array(np.zeros(n, np.int32))] * 2, pa.array(row), pa.array(row % 3), pa.array((row % 7).astype(np.float32))]
    tracemalloc.start()
    done = writer.write([pa.RecordBatch.from_arrays(columns, rasters.WRITTEN)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    writer.commit([done])
    _, grid = geotiff.decode((tmp_path / "long.tif").read_bytes())
    assert grid.shape == (n, 3) and all(grid[r, r % 3] == r % 7 for r in range(n)) and np.isnan(grid).sum() == 2 * n
    assert peak < 64 << 20


def test_a_lost_task_leaves_nothing(tmp_path):
    writer = rasters.GeoTiffWriter({"path": str(tmp_path)}, False)
    files.write(files.hidden(str(tmp_path), writer.job), [b"half a file"])
    files.write(files.hidden(str(tmp_path), "other"), [b"of another job"])
    writer.abort([])
    assert len(list(tmp_path.iterdir())) == 1
