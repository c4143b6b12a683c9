"""Coordinates recovered from arbitrary JSON documents.

Comments and trailing commas are taken out by Catalyst. Python only unfolds the parsed document into
its containers: one row per object or array with the plain values it holds. Everything else is
relational: named pairs, arrays of numbers and written coordinates are picked from those rows, and the
ranked detection decides which reference system a pair is in.

Members that make up a pair are not looked at again. Documents that are no JSON, or are nested deeper than Python's
parser goes, give nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps
from geoloom.operators import detection
from geoloom.sources.formats import number

# Names of fields that hold a part of a coordinate.
LAT = ["lat", "latitude", "breite", "phi"]
LON = ["lon", "lng", "long", "longitude", "laenge", "länge", "lambda"]
X = ["x", "e", "east", "easting", "rechtswert", "rw", "ostwert", "utm_x", "utm_e"]
Y = ["y", "n", "north", "northing", "hochwert", "hw", "nordwert", "utm_y", "utm_n"]
Z = ["z", "alt", "altitude", "height", "hoehe", "höhe", "ele", "elevation"]

# Lengths of texts that may be a coordinate, and the confidence of named and of written angles.
TEXT_LENGTHS, NAMED_ANGLES, WRITTEN_ANGLES = (3, 200), 0.95, 0.9
#: Tasks that documents are dealt to, for each core.
PER_CORE = 4


@dataclass(frozen=True)
class Options:
    assume_epsg: int | None = None
    min_confidence: float = 0.6
    min_named: float = 0.5
    region: tuple = detection.GERMANY
    extra: dict = field(default_factory=dict)

    def names(self) -> dict[str, list[str]]:
        base = {"lat": LAT, "lon": LON, "x": X, "y": Y, "z": Z}
        return {k: [*v, *(n.lower() for n in self.extra.get(k, []))] for k, v in base.items()}


# --- angles in degrees, minutes and seconds

#: What an angle is written with: numbers, hemispheres, and the bar that stands for a separator of two angles.
_TOKEN = "[|NSEWnsew]|[+-]?[0-9]+(?:[.,][0-9]+)?"
#: Marks behind a number; a small s is one where a hemisphere, a separator or the end follows.
_MARK = "(?<=[0-9])\\\\s*(?:[°:\\'′\"″]|[dDmM](?![a-zA-Z])|s(?=\\\\s*(?:[NSEWnsew|]|$)))"


def _angle(tokens: str, to: str) -> list[dict[str, str]]:
    """Stages that read tokens as one angle: {to} in degrees (null if it is none) and {to}_side, its hemisphere."""
    part = lambda i: f"coalesce(try_element_at({to}_n, {i}), 0e0)"
    return [
        {f"{to}_n": f"transform(filter({tokens}, x -> x rlike '[0-9]'), x -> try_cast(replace(x, ',', '.') AS DOUBLE))",
         f"{to}_side": f"upper(array_join(filter({tokens}, x -> NOT x rlike '[0-9]'), ''))",
         f"{to}_minus": f"exists({tokens}, x -> x LIKE '-%')"},
        {to: f"CASE WHEN size({to}_n) BETWEEN 1 AND 3 AND length({to}_side) <= 1 THEN (CASE WHEN {to}_minus OR {to}_side IN ('S', 'W') THEN -1e0 ELSE 1e0 END)"
             f" * (abs({part(1)}) + {part(2)} / 60e0 + {part(3)} / 3600e0) END"},
    ]


def with_angles(df: DataFrame, text: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the two angles that the text holds, and null where it holds anything else.

    Two angles stand on either side of a separator, or each has its hemisphere before or behind it, or
    half of the numbers belongs to each. Hemispheres fix the order, else latitude is first.
    """
    letter = lambda i: f"element_at(t_tok, {i}) rlike '[A-Za-z]'"
    stages = [
        {"t_flat": f"regexp_replace(regexp_replace({text}, '\\\\s*[;/]\\\\s*|,\\\\s+', ' | '), '{_MARK}', ' ')"},
        {"t_tok": f"regexp_extract_all(t_flat, '({_TOKEN})', 1)", "t_other": f"regexp_replace(t_flat, '{_TOKEN}|\\\\s', '')"},
        {"t_bars": "filter(sequence(1, greatest(size(t_tok), 1)), i -> try_element_at(t_tok, i) = '|')",
         "t_sides": "filter(sequence(1, greatest(size(t_tok), 1)), i -> try_element_at(t_tok, i) rlike '[A-Za-z]')"},
        {"t_half": "(size(t_tok) - size(t_sides)) div 2"},
        {"t_cut": "CASE WHEN t_other <> '' OR size(t_tok) < 2 OR size(t_bars) > 1 THEN NULL WHEN size(t_bars) = 1 THEN t_bars[0] - 1"
                  f" WHEN size(t_sides) = 2 THEN CASE WHEN {letter(1)} THEN t_sides[1] - 1 ELSE t_sides[0] END"
                  f" WHEN size(t_sides) = 1 AND t_sides[0] > 1 AND t_sides[0] < size(t_tok) THEN t_sides[0]"
                  f" WHEN (size(t_tok) - size(t_sides)) % 2 = 0 THEN t_half + CASE WHEN {letter(1)} THEN 1 ELSE 0 END END"},
        {"t_first": "CASE WHEN t_cut > 0 THEN slice(t_tok, 1, t_cut) END",
         "t_second": "CASE WHEN t_cut > 0 THEN filter(slice(t_tok, t_cut + 1, size(t_tok)), x -> x <> '|') END"},
        *_angle("t_first", "t_a"), *_angle("t_second", "t_b"),
        {"t_swap": "t_a_side IN ('E', 'W') OR t_b_side IN ('N', 'S')"},
        {"t_lat": "CASE WHEN t_swap THEN t_b ELSE t_a END", "t_lon": "CASE WHEN t_swap THEN t_a ELSE t_b END"},
        {lat: "CASE WHEN abs(t_lat) <= 90e0 AND abs(t_lon) <= 180e0 THEN t_lat END", lon: "CASE WHEN abs(t_lat) <= 90e0 AND abs(t_lon) <= 180e0 THEN t_lon END"},
    ]
    return steps.apply(df, stages)


# --- documents to candidates


def tolerant(text: Column) -> Column:
    """Strict JSON: comments become spaces, commas before a closing bracket go; strings are left alone."""
    string = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    plain = F.regexp_replace(text, string + r"|//[^\n]*+|/\*(?s:.*?)\*/", "$1 ")
    return F.regexp_replace(plain, string + r"|,(?=\s*[}\]])", "$1")


CONTAINERS = "path string, shape string, members array<struct<name: string, text: string, num: double>>"
_MEMBERS = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("num", pa.float64())]))


def _containers(document):
    """(path, shape, members) of all objects and arrays; a value that is no number or text is a member without either."""
    todo = [("$", document)]
    if not isinstance(document, (tuple, list)):
        todo = [("$", [document])]
        yield "$", "value", [_member(None, document)]
        return
    while todo:
        path, node = todo.pop()
        named = isinstance(node, tuple)
        inner = node if named else [(None, v) for v in node]
        yield path, "object" if named else "array", [_member(k, v) for k, v in inner]
        todo += [(f"{path}.{k}" if named else f"{path}[{i}]", v) for i, (k, v) in enumerate(inner) if isinstance(v, (tuple, list))]


def _member(name, v):
    plain = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    return {"name": name, "text": v if isinstance(v, str) else None, "num": float(v) if plain else None}


def _unfold(batches):
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("json").to_pylist()):
            try:
                # An object is the tuple of its (name, value) pairs, repeated names included.
                rows += [(i, *c) for c in _containers(json.loads(text or "", object_pairs_hook=tuple))]
            except (ValueError, OverflowError, RecursionError):
                continue
        kinds = [batch.column("id").type, pa.string(), pa.string(), _MEMBERS]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "path", "shape", "members"])


def _written(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", a.cast("string"), b.cast("string"))


def candidates(containers: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """id, path, raw, kind, a, b, z of all that may be a coordinate; kinds: geo, named, loose, bare, dms."""
    value = lambda m: F.struct(m["name"].alias("name"), m["text"].alias("text"), F.coalesce(m["num"], number(m["text"])).alias("v"))
    rows = containers.select("id", "path", "shape", F.transform("members", value).alias("m"))
    # Of members with one role the last one counts.
    last = lambda role: F.try_element_at(F.filter("m", lambda x: x["v"].isNotNull() & F.lower(F.trim(x["name"])).isin(names[role])), F.lit(-1))
    rows = rows.select("*", *(F.when(F.col("shape") == "object", last(role)).alias(role) for role in ("lat", "lon", "x", "y", "z")))
    angles, plane = F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("x").isNotNull() & F.col("y").isNotNull()
    possible = (F.abs(F.col("lat.v")) <= 90) & (F.abs(F.col("lon.v")) <= 180)
    kind = F.when(angles, F.when(possible, "geo").otherwise("loose")).when(plane, "named")
    all_numbers = (F.col("shape") == "array") & F.size("m").isin(2, 3) & ~F.exists("m", lambda x: x["v"].isNull())
    kind = F.coalesce(kind, F.when(all_numbers, "bare"))
    at = lambda i: F.get("m", F.lit(i))["v"]
    used = F.when(angles, F.array("lat.name", "lon.name", "z.name")).when(plane, F.array("x.name", "y.name", "z.name")).otherwise(F.array())
    rows = rows.select(
        "id", "path", "shape", "m", kind.alias("kind"), F.array_compact(used).alias("used"),
        F.when(angles, F.col("lat.v")).when(plane, F.col("x.v")).when(all_numbers, at(0)).alias("a"),
        F.when(angles, F.col("lon.v")).when(plane, F.col("y.v")).when(all_numbers, at(1)).alias("b"),
        F.when(all_numbers, at(2)).otherwise(F.col("z.v")).alias("z"))
    none = F.lit(None).cast("double")
    row = lambda path, raw, kind, a, b, z, text: F.struct(path.alias("path"), raw.alias("raw"), kind.alias("kind"), a.alias("a"), b.alias("b"), z.alias("z"), text.alias("text"))
    pair = row(F.col("path"), _written(F.col("a"), F.col("b")), F.col("kind"), F.col("a"), F.col("b"), F.col("z"), F.lit(None).cast("string"))
    place = lambda x, i: F.when(F.col("shape") == "object", F.concat("path", F.lit("."), x["name"])).when(F.col("shape") == "array", F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col("path"))
    texts = F.transform("m", lambda x, i: row(place(x, i), F.trim(x["text"]), F.lit("text"), none, none, none, F.when(~F.array_contains("used", F.coalesce(x["name"], F.lit(""))), x["text"])))
    texts = F.when(F.col("kind") == "bare", F.slice(texts, 1, 0)).otherwise(F.filter(texts, lambda t: F.length(t["text"]).between(*TEXT_LENGTHS)))
    found = rows.select("id", F.inline(F.concat(F.when(F.col("kind").isNotNull(), F.array(pair)).otherwise(F.slice(F.array(pair), 1, 0)), texts)))
    # Texts: two angles, or two or three numbers.
    asked = F.when(F.col("text").rlike("[°'\"′″NSEWnsew]"), F.col("text"))
    found = with_angles(found.withColumn("asked", asked), "asked", "w_lat", "w_lon")
    parts = F.transform(F.filter(F.split("text", "[,; \t]"), lambda x: x != ""), number)
    # Unpacked by generators, so that neither the filter nor the detection copies the long expressions.
    found = found.select("id", "path", "raw", "kind", "a", "b", "z", "text", F.inline(F.array(F.struct("w_lat", "w_lon", parts.alias("parts")))))
    angle, listed = F.col("w_lat").isNotNull(), F.size("parts").isin(2, 3) & F.get("parts", F.lit(0)).isNotNull() & F.get("parts", F.lit(1)).isNotNull()
    pick = lambda angle_, part, own: F.when(angle, angle_).when(F.col("text").isNotNull(), part).otherwise(own)
    kept = found.filter(F.col("text").isNull() | angle | listed)
    return kept.select("id", F.inline(F.array(F.struct(
        "path", "raw", pick(F.lit("dms"), F.lit("bare"), F.col("kind")).alias("kind"), pick(F.col("w_lat"), F.get("parts", F.lit(0)), F.col("a")).alias("a"),
        pick(F.col("w_lon"), F.get("parts", F.lit(1)), F.col("b")).alias("b"), pick(none, F.get("parts", F.lit(2)), F.col("z")).alias("z")))))


def find_coordinates(docs: DataFrame, id_col: str = "id", json_col: str = "json", options: Options = Options()) -> DataFrame:
    """id, path, raw, kind, z, epsg, lat, lon and confidence of each find."""
    kind = docs.schema[id_col].dataType.simpleString()
    # Documents are little to read and much to work on: they are dealt to all cores, however few files they come from.
    spread = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("json")).repartition(PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    unfolded = spread.select("id", tolerant(F.col("json")).alias("json")).mapInArrow(_unfold, f"id {kind}, {CONTAINERS}")
    ranked = detection.best_reading(candidates(unfolded, options.names()), "a", "b", options.region)
    epsg, lat, lon, conf = (F.col(c) for c in ("epsg", "lat", "lon", "confidence"))
    if options.assume_epsg:
        ranked = steps.apply(ranked, [*geodesy.to_geo(options.assume_epsg, "a", "b", "t_qlat", "t_qlon", "p"),
                                      {"p_fit": detection.region_fit("t_qlat", "t_qlon", options.region), "p_lat": "t_qlat", "p_lon": "t_qlon"}])
        # Unpacked by a generator for the same reason as the best reading.
        ranked = ranked.select(*(c for c in ranked.columns if c[:2] != "p_"), F.inline(F.array(F.struct("p_fit", "p_lat", "p_lon"))))
        pinned = F.col("p_fit") > 0
        epsg, lat, lon = F.when(pinned, options.assume_epsg).otherwise(epsg), F.when(pinned, F.col("p_lat")).otherwise(lat), F.when(pinned, F.col("p_lon")).otherwise(lon)
        conf = F.when(pinned, 0.5 + 0.45 * F.col("p_fit")).otherwise(conf)
    sure = F.col("kind").isin("geo", "dms")
    found = ranked.select(
        "id", "path", "raw", "kind", "z", F.when(sure, 4326).otherwise(epsg).alias("epsg"), F.when(sure, F.col("a")).otherwise(lat).alias("lat"),
        F.when(sure, F.col("b")).otherwise(lon).alias("lon"), F.when(F.col("kind") == "geo", NAMED_ANGLES).when(F.col("kind") == "dms", WRITTEN_ANGLES).otherwise(conf).alias("confidence"))
    least = F.when(F.col("kind") == "bare", options.min_confidence).when(F.col("kind") == "named", options.min_named).otherwise(0.0)
    return found.filter(F.col("confidence").isNotNull() & (F.col("confidence") >= least)).withColumnRenamed("id", id_col)
