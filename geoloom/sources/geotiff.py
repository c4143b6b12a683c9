"""GeoTIFF rasters: headers, blocks (strips or tiles) and their decoding, from bytes or from parts of a file.

`rasters` reads and writes them as a data source. read_cells decodes whole files where Spark read
their bytes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.sources.files import Held

# TIFF tags, compressions and field types that are understood.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SAMPLES = {(3, 32): "f4", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4"}
PROJECTED_CRS = 3072
#: Cells of a part of a block at most, where a block's parts can be read on their own.
PART_CELLS = 1 << 20


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, the code grows one entry early."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(fresh)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(fresh), 9, None
                continue
            if last is None:
                word = table[code]
            else:
                word = table[code] if code < len(table) else last + last[:1]
                table.append(last + word[:1])
            out += word
            last = word
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpack(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == LZW:
        return lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"TIFF compression {compression} is not supported")


def tags(source) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory's tags. source: bytes, or a file that is read in parts."""
    source = Held(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
    head = source.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", head[4:8])[0]
    count, = struct.unpack(order + "H", source.read(at, 2))
    directory, found = source.read(at + 2, 12 * count), {}
    for k in range(count):
        tag, kind, n = struct.unpack(order + "HHI", directory[12 * k : 12 * k + 8])
        letter = FIELD.get(kind)
        if letter is None:
            continue
        size, inline = struct.calcsize(letter) * n, directory[12 * k + 8 : 12 * k + 12]
        raw = inline[:size] if size <= 4 else source.read(struct.unpack(order + "I", inline)[0], size)
        found[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if letter == "s" else struct.unpack(f"{order}{n}{letter}", raw)
    return order, found


def _described(t: dict[int, tuple]) -> dict:
    sx, sy, _ = t[SCALE]
    if abs(sx - sy) > 1e-9 * abs(sx):
        raise ValueError("pixels are not square")
    col, row, _, x, y, _ = t[TIEPOINT][:6]
    keys = t.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == PROJECTED_CRS and keys[i + 1] == 0), None)
    return {"width": int(t[WIDTH][0]), "height": int(t[HEIGHT][0]), "origin_x": x - col * sx, "origin_y": y + row * sy, "pixel": sx,
            "nodata": float(t[NO_DATA][0]) if t.get(NO_DATA, ("",))[0].strip() else -9999.0, "epsg": epsg}


def metadata(source) -> dict:
    """Size, georeference, NoData and EPSG (where the GeoKey is inline) of a raster."""
    return _described(tags(source)[1])


@dataclass(frozen=True)
class Block:
    """Where a strip, a tile or a part of one lies in the file, its first cell, its size as stored, and the rows and columns that belong to the raster."""

    at: int
    size: int
    row: int
    col: int
    shape: tuple[int, int]
    rows: int
    cols: int


@dataclass(frozen=True)
class Layout:
    """What is needed to decode a raster's blocks."""

    meta: dict
    kind: str
    compression: int
    predictor: int

    def decode(self, data: bytes, block: Block) -> np.ndarray:
        """The block's cells as float32, NoData as NaN."""
        kind = np.dtype(self.kind)
        raw = np.frombuffer(_unpack(data, self.compression), kind, block.shape[0] * block.shape[1]).reshape(block.shape)
        if self.predictor == 2:
            lane = np.dtype(f"u{kind.itemsize}").newbyteorder(self.kind[0])
            raw = np.cumsum(raw.view(lane).astype(lane.newbyteorder("=")), axis=1, dtype=f"u{kind.itemsize}").view(kind.newbyteorder("="))
        cells = raw[: block.rows, : block.cols].astype(np.float32)
        cells[cells == np.float32(self.meta["nodata"])] = np.nan
        return cells


def layout(source) -> tuple[Layout, list[Block]]:
    """How a raster is stored, and its blocks in order. Strips that are neither packed nor chained by a predictor are cut into parts."""
    order, t = tags(source)
    meta = _described(t)
    w, h = meta["width"], meta["height"]
    code = SAMPLES.get((t.get(SAMPLE_FORMAT, (1,))[0], t.get(BITS, (8,))[0]))
    if code is None:
        raise ValueError("this sample format is not supported")
    found = Layout(meta, order + code, t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0])
    if found.predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {found.predictor} is not supported")
    blocks = []
    if TILE_AT in t:
        tw, th = t[TILE_WIDTH][0], t[TILE_HEIGHT][0]
        across = -(-w // tw)
        for k, (at, size) in enumerate(zip(t[TILE_AT], t[TILE_BYTES])):
            r, c = k // across * th, k % across * tw
            blocks.append(Block(at, size, r, c, (th, tw), min(th, h - r), min(tw, w - c)))
    else:
        rows = min(t.get(ROWS_PER_STRIP, (h,))[0], h)
        part = max(1, PART_CELLS // w) if found.compression == PLAIN else rows
        for k, (at, size) in enumerate(zip(t[STRIP_AT], t[STRIP_BYTES])):
            n, wide = min(rows, h - k * rows), w * np.dtype(code).itemsize
            for r in range(0, n, part):
                m = min(part, n - r)
                blocks.append(Block(at + r * wide, size if part == rows else min(size - r * wide, m * wide), k * rows + r, 0, (m, w), m, w))
    return found, blocks


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Metadata and the height x width samples as float32, NoData as NaN."""
    stored, blocks = layout(data)
    grid = np.empty((stored.meta["height"], stored.meta["width"]), np.float32)
    for b in blocks:
        grid[b.row : b.row + b.rows, b.col : b.col + b.cols] = stored.decode(data[b.at : b.at + b.size], b)
    return stored.meta, grid


CELLS = "path string, row long, col long, value float"
META = "path string, width int, height int, origin_x double, origin_y double, pixel double, nodata double, epsg int"


def _cells(batches):
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content")):
            _, grid = decode(data.as_py())
            step = max(1, (1 << 18) // grid.shape[1])
            for r in range(0, grid.shape[0], step):
                part = grid[r : r + step]
                rows, cols = np.indices(part.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * part.size), pa.array(rows.ravel() + r), pa.array(cols.ravel()), pa.array(part.ravel(), from_pandas=True)], ["path", "row", "col", "value"])


def _metas(batches):
    for batch in batches:
        rows = [{"path": p.as_py(), **metadata(d.as_py())} for p, d in zip(batch.column("path"), batch.column("content"))]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
        names = [f.split()[0] for f in META.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return found.load(path).filter("lower(path) rlike '[.]tiff?$'").select("path", "content")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of all rasters below a folder; NoData is null."""
    return _files(spark, path).mapInArrow(_cells, CELLS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_metas, META)


def encode(grid: np.ndarray, origin_x: float, origin_y: float, pixel: float, nodata: float = -9999.0) -> bytes:
    """A raster as one uncompressed float32 strip; NaN becomes NoData."""
    h, w = grid.shape
    text = f"{nodata:g}".encode() + b"\0"
    entries = 13
    scale = 8 + 2 + entries * 12 + 4
    tie, gap = scale + 24, scale + 72
    start = gap + len(text) + len(text) % 2
    fields = [(WIDTH, 3, 1, w), (HEIGHT, 3, 1, h), (BITS, 3, 1, 32), (COMPRESSION, 3, 1, PLAIN), (262, 3, 1, 1), (STRIP_AT, 4, 1, start), (277, 3, 1, 1), (ROWS_PER_STRIP, 3, 1, h),
              (STRIP_BYTES, 4, 1, w * h * 4), (SAMPLE_FORMAT, 3, 1, 3), (SCALE, 12, 3, scale), (TIEPOINT, 12, 6, tie), (NO_DATA, 2, len(text), gap)]
    head = b"II" + struct.pack("<HIH", 42, 8, entries) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    places = struct.pack("<3d", pixel, pixel, 0.0) + struct.pack("<6d", 0, 0, 0, origin_x, origin_y, 0)
    body = np.where(np.isnan(grid), np.float32(nodata), grid).astype("<f4").tobytes()
    return head + places + text.ljust(start - gap, b"\0") + body


def encode_tiled(grid: np.ndarray, origin_x: float, origin_y: float, pixel: float, nodata: float = -9999.0, epsg: int | None = None, side: int = 256, packed: bool = True) -> list[bytes]:
    """The parts of a file of float32 tiles, deflated if packed; NaN becomes NoData. The directory stands behind the tiles."""
    h, w = grid.shape
    filled, body, places, sizes, at = np.where(np.isnan(grid), np.float32(nodata), grid).astype("<f4"), [], [], [], 8
    for r in range(0, h, side):
        for c in range(0, w, side):
            tile = np.full((side, side), np.float32(nodata), "<f4")
            part = filled[r : r + side, c : c + side]
            tile[: part.shape[0], : part.shape[1]] = part
            data = zlib.compress(tile.tobytes(), 6) if packed else tile.tobytes()
            data += b"\0" * (len(data) % 2)
            body.append(data)
            places.append(at)
            sizes.append(len(data))
            at += len(data)
    keys = [1, 1, 0, 1, PROJECTED_CRS, 0, 1, epsg] if epsg else []
    values = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [32]), (COMPRESSION, 3, [DEFLATE if packed else PLAIN]), (262, 3, [1]), (277, 3, [1]), (TILE_WIDTH, 3, [side]), (TILE_HEIGHT, 3, [side]),
              (TILE_AT, 4, places), (TILE_BYTES, 4, sizes), (SAMPLE_FORMAT, 3, [3]), (SCALE, 12, [pixel, pixel, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, origin_x, origin_y, 0.0]),
              *([(GEO_KEYS, 3, keys)] if keys else []), (NO_DATA, 2, f"{nodata:g}".encode() + b"\0")]
    behind, directory = b"", struct.pack("<H", len(values))
    begin = at + 2 + 12 * len(values) + 4
    for tag, kind, v in values:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{FIELD[kind]}", *v)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", begin + len(behind))
        behind += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        directory += struct.pack("<HHI", tag, kind, len(v)) + inline
    return [b"II" + struct.pack("<HI", 42, at), *body, directory + struct.pack("<I", 0) + behind]
