"""Other sources: XYZ text (plain or zipped), zip directories, flight tables, KML, metalinks, catalogue pages, tile indexes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A finite number, also with a decimal comma (one comma and no point); else null."""
    plain = F.when(F.instr(text, ".") == 0, F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return F.when(text.rlike(NUMBER) & plain.rlike(r"^[^,]*$"), F.trim(plain).try_cast("double"))


def parse_xyz(lines: DataFrame, column: str = "value") -> DataFrame:
    """x, y, value of the lines that hold three numbers; other lines are skipped."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return lines.select(at(0).alias("x"), at(1).alias("y"), at(2).alias("value")).dropna()


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    return parse_xyz(spark.read.text(path))


def _zipped_lines(suffix: str):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as archive:
                    names = [i.filename for i in archive.infolist() if i.file_size]
                    pick = next((n for n in names if n.lower().endswith(suffix)), names[0] if names else None)
                    if pick is None:
                        continue
                    with archive.open(pick) as f:
                        lines = io.TextIOWrapper(f, "utf-8", errors="replace")
                        while block := lines.readlines(1 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(block)), pa.array([x.rstrip("\r\n") for x in block])], ["path", "value"])

    return run


def read_zipped_xyz(spark: SparkSession, path: str, suffix: str = ".xyz") -> DataFrame:
    """XYZ rows of zip archives: of each the first entry with the suffix, else the first that is not empty."""
    return parse_xyz(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_zipped_lines(suffix), "path string, value string"))


def zip_directory(tail: bytes, offset: int = 0) -> list[tuple[str, int, int, int, int]]:
    """(name, packed size, size, method, header offset) of the entries in an archive's last bytes, which begin at offset; zip64 included."""
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no zip directory")
    count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    wide = tail.rfind(b"PK\x06\x06", 0, end)
    if 0xFFFFFFFF in (at, size) or count == 0xFFFF:
        count, size, at = struct.unpack("<QQQ", tail[wide + 32 : wide + 56])
    at, found = at - offset, []
    for _ in range(count):
        method, = struct.unpack("<H", tail[at + 10 : at + 12])
        packed, plain, n, extra, note = struct.unpack("<IIHHH", tail[at + 20 : at + 34])
        header, = struct.unpack("<I", tail[at + 42 : at + 46])
        name, more = tail[at + 46 : at + 46 + n].decode("utf-8", "replace"), tail[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            kind, length = struct.unpack("<HH", more[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                plain, packed, header = (values.pop(0) if v == 0xFFFFFFFF and values else v for v in (plain, packed, header))
            more = more[4 + length :]
        found.append((name, packed, plain, method, header))
        at += 46 + n + extra + note
    return found


def zip_entry(data: bytes, header: int, packed: int, method: int) -> bytes:
    n, extra = struct.unpack("<HH", data[header + 26 : header + 30])
    body = data[header + 30 + n + extra : header + 30 + n + extra + packed]
    if method == 0:
        return body
    if method == 8:
        return zlib.decompress(body, -15)
    raise ValueError(f"zip method {method} is not supported")


#: Last bytes of an archive in which its end record is looked for: the record, its wide form and the longest comment.
ZIP_TAIL = 22 + 56 + 20 + 0xFFFF


def directory_at(tail: bytes, begin: int) -> int:
    """Where the directory begins in an archive whose last bytes, from `begin` on, are `tail`."""
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no zip directory")
    at, = struct.unpack("<I", tail[end + 16 : end + 20])
    if at == 0xFFFFFFFF:
        wide = tail.rfind(b"PK\x06\x06", 0, end)
        at, = struct.unpack("<Q", tail[wide + 48 : wide + 56])
    return at


def read_directory(path: str, length: int) -> list[tuple[str, int, int, int, int]]:
    """Entries of an archive of which only the end is read, and then the directory, through the file system of the path."""
    system, place = (fs.LocalFileSystem(), unquote(path[5:])) if path.startswith("file:/") else fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        begin = max(0, length - ZIP_TAIL)
        f.seek(begin)
        at = directory_at(f.read(), begin)
        f.seek(at)
        return zip_directory(f.read(), at)


def _directories(batches):
    for batch in batches:
        whole = batch.column("content") if "content" in batch.schema.names else None
        rows = []
        for i, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())):
            found = zip_directory(whole[i].as_py()) if whole is not None else read_directory(path, length)
            rows += [(path, *e) for e in found]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "name", "packed", "size", "method", "header"])


def read_zip_directories(spark: SparkSession, path: str, whole_bytes: int = 64 << 20) -> DataFrame:
    """Entries of all archives. Those over whole_bytes are not read whole; their store has to be one that pyarrow reaches, too."""
    files = spark.read.format("binaryFile").load(path)
    shape = "path string, name string, packed long, size long, method int, header long"
    small = files.filter(F.col("length") <= whole_bytes).select("path", "length", "content").mapInArrow(_directories, shape)
    return small.unionByName(files.filter(F.col("length") > whole_bytes).select("path", "length").mapInArrow(_directories, shape))


def read_flight_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table of numbers with a header; `;` is tried before tab and comma, a decimal comma is understood unless it separates."""
    head = spark.read.text(path).first()[0]
    separator = next((s for s in (";", "\t", ",") if s in head), ",")
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    return raw.select(*(number(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns)).dropna("all")


# Names that mark a column's role, in the order in which they are tried.
ROLES = {
    "time": ["t", "time", "zeit", "seconds", "sec", "timestamp"], "lat": ["lat", "latitude", "breite"], "lon": ["lon", "lng", "long", "longitude", "laenge", "länge"],
    "x": ["x", "east", "easting", "rechtswert"], "y": ["y", "north", "northing", "hochwert"], "z": ["z", "alt", "altitude", "height", "hoehe", "höhe", "elevation"],
    "yaw": ["yaw", "heading", "azimuth", "kurs"], "pitch": ["pitch", "nick"], "roll": ["roll", "bank"], "qx": ["qx"], "qy": ["qy"], "qz": ["qz"], "qw": ["qw"],
}


def suggest_roles(columns: list[str]) -> dict[str, str]:
    """Role to column, by name; each column is used once."""
    found: dict[str, str] = {}
    for role, names in ROLES.items():
        for c in columns:
            if role not in found and c not in found.values() and c.strip().lower() in names:
                found[role] = c
    return found


def with_roles(df: DataFrame, roles: dict[str, str], time_divisor: float = 1.0, angle_factor: float = 1.0) -> DataFrame:
    """The mapped columns under their roles; other columns in the map `extra`."""
    scale = lambda r: 1.0 / time_divisor if r == "time" else angle_factor if r in ("yaw", "pitch", "roll") else 1.0
    rest = [c for c in df.columns if c not in roles.values()]
    extra = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`")))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,double>")
    return df.select(*((F.col(f"`{c}`") * scale(r)).alias("t" if r == "time" else r) for r, c in roles.items()), extra.alias("extra"))


METALINK = "STRUCT<file: ARRAY<STRUCT<_name: STRING, url: ARRAY<STRING>>>>"


def metalink_jobs(texts: DataFrame, column: str = "value") -> DataFrame:
    """file and its mirrors in order; files without an address are left out."""
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r'\sxmlns="[^"]*"', ""), r"<url [^>]*>", "<url>")
    files = texts.select(F.explode(F.from_xml(plain, METALINK)["file"]).alias("f"))
    return files.select(F.col("f._name").alias("file"), F.transform("f.url", F.trim).alias("mirrors")).filter(F.size("mirrors") > 0)


STAC = "STRUCT<features: ARRAY<STRUCT<id: STRING, properties: STRUCT<datetime: STRING>, assets: MAP<STRING, STRUCT<href: STRING>>>>, links: ARRAY<STRUCT<rel: STRING, href: STRING>>>"


def stac_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """id, taken (UTC) and assets of every feature on the pages."""
    page = pages.select(F.from_json(column, STAC).alias("p"))
    return page.select(F.inline("p.features")).select("id", F.try_to_timestamp(F.col("properties.datetime")).alias("taken"), F.transform_values("assets", lambda _, a: a["href"]).alias("assets"))


def stac_next(pages: DataFrame, column: str = "value") -> DataFrame:
    """The addresses that the pages name as their next page."""
    page = pages.select(F.from_json(column, STAC)["links"].alias("links"))
    return page.select(F.inline("links")).filter("rel = 'next'").select("href")


def asset_jobs(items: DataFrame, key: str) -> DataFrame:
    """id, file and url of the items that have the asset, whatever the case of its key; the first in the order of keys if several do."""
    fit = F.array_sort(F.filter(F.map_entries("assets"), lambda e: F.lower(e["key"]) == key.lower()))
    url = F.get(fit, F.lit(0))["value"]
    return items.select("id", url.alias("url")).filter("url is not null").select("id", F.element_at(F.split("url", "/"), -1).alias("file"), "url")


def newest_per_tile(items: DataFrame, keys: list[str], when: str = "taken", tie: str = "id") -> DataFrame:
    """The latest item of each tile; without a date it counts as oldest, and of equal dates the smallest id stays."""
    order = F.struct(F.col(when).isNotNull().alias("dated"), F.col(when))
    best = items.groupBy(*keys).agg(F.max(order).alias("__best"))
    same = items.join(best, keys).filter(F.struct(F.col(when).isNotNull().alias("dated"), F.col(when)).eqNullSafe(F.col("__best"))).drop("__best")
    return same.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in items.columns if c not in keys]), F.col(tie)).alias("__i")).select(*keys, "__i.*")


def url_index(texts: DataFrame, pattern: str, column: str = "value", order: str | None = None) -> DataFrame:
    """east_km, north_km and url from pages, by a pattern with the groups url, east, north; the last one of a tile counts.

    order is the column that pages are ordered by, the last page counting most; without it pages are
    ordered by their texts.
    """
    page = F.col(order) if order else F.xxhash64(column)
    pos = texts.select(page.alias("page"), F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("i", "hit"))
    get = lambda g: F.regexp_extract("hit", pattern, g)
    rows = pos.select("page", "i", get(1).alias("url"), get(2).cast("int").alias("east_km"), get(3).cast("int").alias("north_km"))
    return rows.groupBy("east_km", "north_km").agg(F.max_by("url", F.struct("page", "i", "url")).alias("url"))
