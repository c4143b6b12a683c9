"""Tracks from delimited text and JSON: tables of numbers, what their columns mean, and samples.

A table of numbers has a row per record: track (the file), i (its place in the file, from 0) and
cells, the names and values of its numbers in the order of the file. Records without a number are
left out and not counted. Names are compared without case; of equal names the last one counts.

Cases: an empty file or one with a header alone has no records; JSON is an array of objects, or an
object of which the first array counts, and anything else has no records; values that are no finite
numbers are missing; a decimal comma is understood in text whose delimiter is another one; a record
without a position gives no sample; without a time the place times the interval is the time; a
missing height or angle is 0; of four quaternion columns none counts if one is missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators import detection, trajectory
from geoloom.sources.formats import number

# The roles, and the names that stand for them.
ROLE_NAMES = {
    "time": ["t", "time", "timestamp", "zeit", "sec", "seconds"],
    "latitude": ["lat", "latitude", "breite"],
    "longitude": ["lon", "lng", "long", "longitude", "laenge"],
    "x": ["x", "e", "east", "easting", "utm_x", "rechtswert"],
    "y": ["y", "n", "north", "northing", "utm_y", "hochwert"],
    "z": ["z", "alt", "altitude", "height", "hoehe", "ele", "elevation", "agl", "msl"],
    "yaw": ["yaw", "heading", "hdg", "psi", "course"],
    "pitch": ["pitch", "theta", "nick"],
    "roll": ["roll", "phi", "bank"],
    "quatx": ["qx", "quatx", "quat_x", "q1"],
    "quaty": ["qy", "quaty", "quat_y", "q2"],
    "quatz": ["qz", "quatz", "quat_z", "q3"],
    "quatw": ["qw", "quatw", "quat_w", "q0"],
}
# Roles without names of their own, delimiters in the order in which they are tried, and the confidence that tells a position by its values.
OTHER_ROLES, DELIMITERS, SURE = ["extra", "ignore"], [";", "\t", ","], 0.8
QUATERNION = ["quatx", "quaty", "quatz", "quatw"]
#: The system of samples.
EPSG = 25832


@dataclass
class Mapping:
    """Which column plays which role, the system of positions, and units."""

    fields: dict[str, str] = field(default_factory=dict)
    epsg: int = EPSG
    time_divisor: float = 1.0
    angle_to_degrees: float = 1.0
    interval: float = 1.0

    def column(self, role: str) -> str | None:
        return next((c for c, r in self.fields.items() if r.lower() == role), None)

    def faults(self, columns: list[str] | None = None) -> list[str]:
        """All that is wrong with the mapping, for a table with these columns."""
        found = [f"column {c!r} has the unknown role {r!r}" for c, r in self.fields.items() if r.lower() not in (*ROLE_NAMES, *OTHER_ROLES)]
        if columns is not None:
            known = {c.strip().lower() for c in columns}
            found += [f"there is no column {c!r}" for c, r in self.fields.items() if c.strip().lower() not in known and r.lower() != "ignore"]
        plane, angles = (all(self.column(r) is not None for r in pair) for pair in (("x", "y"), ("latitude", "longitude")))
        if not plane and not angles:
            found.append("a position needs x and y, or latitude and longitude")
        if plane and self.epsg not in geodesy.NAMES:
            found.append(f"EPSG:{self.epsg} is not registered")
        found += [f"{name} must not be 0" for name, v in (("the time divisor", self.time_divisor), ("the factor of angles", self.angle_to_degrees)) if v == 0]
        if self.interval <= 0:
            found.append("the interval must be positive")
        return found

    def check(self, columns: list[str] | None = None) -> None:
        if found := self.faults(columns):
            raise ValueError("; ".join(found))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (track, block, at, cells) with i: the place in the track, counted by blocks."""
    inside = Window.partitionBy("track", "block").orderBy("at")
    before = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("track", "block").agg(F.count(F.lit(1)).alias("n")).select("track", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = rows.withColumn("i", F.row_number().over(inside) - 1).join(sizes, ["track", "block"])
    return placed.select("track", (F.col("i") + F.col("begin")).alias("i"), "cells")


def _cells(names: Column, texts: Column, value) -> Column:
    pairs = F.arrays_zip(names.alias("name"), texts.alias("text"))
    read = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), value(p["text"]).alias("v")))
    return F.filter(read, lambda p: p["v"].isNotNull() & p["name"].isNotNull())


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of numbers from text with a header in each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("track"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.filter(F.trim("value") != "")
    first = lines.groupBy("track").agg(F.min(F.struct("block", "at", "value")).alias("h"))
    # One row per file; what separates is looked for in the header.
    mark = F.coalesce(*(F.when(F.contains("h.value", F.lit(d)), F.lit(d)) for d in DELIMITERS), F.lit(DELIMITERS[-1]))
    tidy = lambda c: F.trim(F.trim(c), F.lit('"'))
    heads = first.select("track", F.col("h.block").alias("head_block"), F.col("h.at").alias("head_at"), mark.alias("mark"), F.transform(F.split("h.value", mark), tidy).alias("names"))
    rows = lines.join(heads, "track").filter((F.col("block") != F.col("head_block")) | (F.col("at") != F.col("head_at")))
    cells = _cells(F.col("names"), F.transform(F.split("value", F.col("mark")), tidy), number)
    return _numbered(rows.select("track", "block", "at", cells.alias("cells")).filter(F.size("cells") > 0))


#: Numbers as JSON has them, also between quotes.
PLAIN = r"^\s*[+-]?(\d+([.]\d*)?|[.]\d+)([eE][+-]?\d+)?\s*$"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A table of numbers from documents that are, or hold, an array of objects. A document is read as one text."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    members = F.map_values(F.from_json("value", "map<string,string>"))
    array = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.get(F.filter(members, lambda v: F.startswith(F.trim(v), F.lit("["))), F.lit(0)))
    records = F.filter(F.from_json(array, "array<string>"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    plain = lambda t: F.when(t.rlike(PLAIN), F.trim(t).try_cast("double"))
    rows = texts.select("track", F.posexplode(records).alias("at", "record")).withColumn("m", F.from_json("record", "map<string,string>"))
    rows = rows.select("track", "at", _cells(F.map_keys("m"), F.map_values("m"), plain).alias("cells")).filter(F.size("cells") > 0)
    # Records of a document are numbered in parts.
    return _numbered(rows.select("track", F.floor(F.col("at") / trajectory.PER_STRETCH).alias("block"), "at", "cells"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return (read_json if path.lower().endswith(".json") else read_delimited)(spark, path)


def columns(table: DataFrame) -> list[str]:
    """Names of columns with a number, in the order in which they appear."""
    names = table.select("track", "i", F.posexplode("cells").alias("at", "c")).select("track", "i", "at", F.col("c.name").alias("name"))
    found = names.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("track", "i", "at", "name")).alias("f"))
    return [r["name"] for r in found.orderBy("f.track", "f.i", "f.at").select("f.name").collect()]


def suggest(table: DataFrame, known: list[str] | None = None) -> Mapping:
    """A mapping by names; positions without a telling name by where the first record's neighbouring numbers lie."""
    known = columns(table) if known is None else known
    role = {n: r for r, names in ROLE_NAMES.items() for n in names}
    mapping = Mapping({c: role[c.strip().lower()] for c in known if c.strip().lower() in role})
    if mapping.column("x") is not None or mapping.column("latitude") is not None:
        return mapping
    first = table.filter("i = 0").orderBy("track").select("cells").first()
    left = [(c["name"], c["v"]) for c in (first["cells"] if first else []) if c["name"] not in mapping.fields]
    pairs = [(k, a[1], b[1]) for k, (a, b) in enumerate(zip(left, left[1:]))]
    if not pairs:
        return mapping
    frame = table.sparkSession.createDataFrame(pairs, "k int, a double, b double")
    sure = detection.best_reading(frame, "a", "b").filter(F.col("confidence") >= SURE).orderBy("k").first()
    if sure is not None:
        one, two = (left[sure["k"] + j][0] for j in (0, 1))
        roles = ("x", "y") if sure["epsg"] != 4326 else ("longitude", "latitude") if sure["swapped"] else ("latitude", "longitude")
        mapping.fields |= {one: roles[0], two: roles[1]}
        mapping.epsg = EPSG if sure["epsg"] == 4326 else sure["epsg"]
    return mapping


def samples(table: DataFrame, mapping: Mapping) -> DataFrame:
    """id (the track), i, t, x, y, z, yaw, pitch, roll, q and extra (a map) of each record; x and y in EPSG, angles in degrees."""
    mapping.check()
    of = lambda name: F.try_element_at(F.filter("cells", lambda c: F.lower(F.trim(c["name"])) == name.strip().lower()), F.lit(-1))["v"]
    value = lambda role: F.lit(None).cast("double") if mapping.column(role) is None else of(mapping.column(role))
    plane = mapping.column("x") is not None and mapping.column("y") is not None
    place = ("x", "y") if plane else ("latitude", "longitude")
    angle = lambda role: F.coalesce(value(role) * mapping.angle_to_degrees, F.lit(0.0))
    size = F.sqrt(sum(value(r) ** 2 for r in QUATERNION))
    turn = trajectory.quaternion(*(value(r) / size for r in QUATERNION))
    more = [c for c, r in mapping.fields.items() if r.lower() == "extra"]
    extra = F.map_filter(F.create_map(*(x for c in more for x in (F.lit(c), of(c)))), lambda _, v: v.isNotNull()) if more else F.create_map().cast("map<string,double>")
    rows = table.select(
        F.col("track").alias("id"), "i", F.coalesce(value("time") / mapping.time_divisor, F.col("i") * mapping.interval).alias("t"), value(place[0]).alias("pa"), value(place[1]).alias("pb"),
        F.coalesce(value("z"), F.lit(0.0)).alias("z"), angle("yaw").alias("own_yaw"), angle("pitch").alias("own_pitch"), angle("roll").alias("own_roll"),
        F.when(size > 0, turn).alias("q"), extra.alias("extra")).filter("pa IS NOT NULL AND pb IS NOT NULL")
    if plane and mapping.epsg != EPSG:
        rows = geodesy.with_converted(rows, mapping.epsg, EPSG, "pa", "pb", "x", "y")
    else:
        rows = rows.withColumns({"x": F.col("pa"), "y": F.col("pb")}) if plane else geodesy.with_projected(rows, EPSG, "pa", "pb", "x", "y")
    rows = trajectory.with_euler(rows, yaw="q_yaw", pitch="q_pitch", roll="q_roll")
    turned = F.col("q").isNotNull()
    return rows.select("id", "i", "t", "x", "y", "z", *(F.when(turned, F.col(f"q_{c}")).otherwise(F.col(f"own_{c}")).alias(c) for c in ("yaw", "pitch", "roll")), "q", "extra")


def load(spark: SparkSession, path: str, mapping: Mapping | None = None) -> DataFrame:
    """Samples of a file, or of a folder's files of one kind, by its ending; the mapping is suggested if none is given."""
    table = read_table(spark, path)
    known = columns(table)
    if not known:
        raise ValueError(f"{path}: no records with numbers")
    mapping = mapping or suggest(table, known)
    mapping.check(known)
    return samples(table, mapping)


def write_path(rows: DataFrame, path: str, names: list[str], digits: int) -> None:
    """Delimited text with a header and numbers of a fixed number of decimals: a flight path (x, y with 2) or waypoints (lat, lon with 6)."""
    kinds = dict(rows.dtypes)
    shown = [F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names]
    rows.select(*shown).write.option("header", True).mode("overwrite").csv(path)
