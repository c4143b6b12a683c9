"""PNG pictures: decoding in numpy, as rows of pixels, and encoding.

Understood are grey, RGB and palette pictures with or without alpha of 8 bits, and grey and RGB ones
of 16 bits, not interlaced. Every chunk's check sum is compared. A picture is one stream of bytes, so
it is decoded in one task; pictures are dealt by file.

Cases: a file that is no PNG, is cut off or has a wrong check sum ends the read with an error that
names it; a picture without alpha is opaque; grey values count for all three colours; an empty
folder has no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The first bytes of a PNG, and samples per pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB, PALETTE, GREY_ALPHA, RGB_ALPHA = 0, 2, 3, 4, 6
SAMPLES = {GREY: 1, RGB: 3, PALETTE: 1, GREY_ALPHA: 2, RGB_ALPHA: 4}
PIXELS = "path string, row long, col long, r double, g double, b double, a double"


def chunks(data: bytes):
    """(kind, body) of a PNG's chunks."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        size, = struct.unpack(">I", data[at : at + 4])
        kind, body, check = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            raise ValueError("a PNG is cut off")
        if zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise ValueError(f"the check sum of the chunk {kind.decode('latin-1')} is wrong")
        yield kind, body
        at += 12 + size


def _nearest(a: int, b: int, c: int) -> int:
    """Of left, above and above left the one that is nearest to left + above - above left."""
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """The bytes of the rows (rows x stride) behind the five filters; step: bytes of a pixel."""
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out, above = np.zeros((rows, stride), np.uint8), np.zeros(stride, np.uint8)
    for k in range(rows):
        kind, line = int(lines[k, 0]), lines[k, 1:]
        if kind == 0:
            out[k] = line
        elif kind == 1:
            out[k] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[k] = line + above
        elif kind in (3, 4):
            own, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(stride):
                left, corner = (own[i - step], up[i - step]) if i >= step else (0, 0)
                own[i] = (own[i] + ((left + up[i]) >> 1 if kind == 3 else _nearest(left, up[i], corner))) & 255
            out[k] = np.frombuffer(bytes(own), np.uint8)
        else:
            raise ValueError(f"there is no PNG filter {kind}")
        above = out[k]
    return out


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 values from 0 to 1: red, green, blue and alpha."""
    head, body, palette, clear = None, [], None, None
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    else:
        raise ValueError("a PNG is cut off")
    width, height, bits, colour, _, _, laced = head
    if colour not in SAMPLES or bits not in (8, 16) or (bits == 16 and colour == PALETTE) or laced:
        raise ValueError(f"PNG pictures of colour type {colour}, {bits} bits{' and interlaced' if laced else ''} are not supported")
    n, size = SAMPLES[colour], bits // 8
    try:
        raw = zlib.decompress(b"".join(body))
        lines = unfiltered(raw, height, width * n * size, n * size)
    except zlib.error as e:
        raise ValueError(f"a PNG's pixels can't be unpacked: {e}") from e
    values = (lines.reshape(height, width, n) if size == 1 else lines.view(">u2").reshape(height, width, n)).astype(np.uint16)
    most = float((1 << bits) - 1)
    alpha = np.ones((height, width, 1))
    if colour == PALETTE:
        see = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            see[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[values[..., 0]], see[values[..., 0]][..., None]], axis=2) / 255.0
    if colour in (GREY_ALPHA, RGB_ALPHA):
        alpha, values = values[..., -1:] / most, values[..., :-1]
    elif clear is not None:
        key = np.frombuffer(clear, ">u2").astype(np.uint16)
        alpha = (~(values == key).all(axis=2, keepdims=True)).astype(float)
    colours = np.repeat(values, 3, axis=2) if values.shape[2] == 1 else values
    return np.concatenate([colours / most, alpha], axis=2)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of height x width (grey) or height x width x 3 or 4 values of 8 or 16 bits; rows are stored as differences from the row above."""
    flat = pixels[..., None] if pixels.ndim == 2 else pixels
    height, width, n = flat.shape
    colour = {1: GREY, 2: GREY_ALPHA, 3: RGB, 4: RGB_ALPHA}[n]
    lines = np.ascontiguousarray(flat.astype(flat.dtype.newbyteorder(">"))).view(np.uint8).reshape(height, -1)
    above = np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
    body = np.hstack([np.full((height, 1), 2, np.uint8), lines - above]).tobytes()
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, 8 * flat.dtype.itemsize, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _pixels(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                picture = decode(data.as_py())
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e
            step = max(1, (1 << 17) // picture.shape[1])
            for r in range(0, picture.shape[0], step):
                part = picture[r : r + step]
                rows, cols = (i.ravel() for i in np.indices(part.shape[:2], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(rows)), pa.array(rows + r), pa.array(cols), *(pa.array(part[..., k].ravel()) for k in range(4))], ["path", "row", "col", "r", "g", "b", "a"])


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col and the colours (0 to 1) of the pixels of all PNG files at or below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter("lower(path) LIKE '%.png'").select("path", "content").mapInArrow(_pixels, PIXELS)
