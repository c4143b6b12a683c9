"""Ordered rules for objects, duplicate meshes, triangles in an area."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(match: dict, name: Column, material: Column | None = None, props: Column | None = None) -> Column:
    """All parts of a match: name_regex, material_regex, prop with exists, equals, in or regex."""
    parts = []
    for key, value in match.items():
        if key == "name_regex":
            parts.append(name.rlike(value))
        elif key == "material_regex":
            parts.append(F.coalesce(material, F.lit("")).rlike(value))
        elif key == "prop":
            at = F.try_element_at(props, F.lit(value["name"]))
            if value.get("exists"):
                parts.append(F.map_contains_key(props, value["name"]))
            if "equals" in value:
                parts.append(F.coalesce(at == value["equals"], F.lit(False)))
            if "in" in value:
                parts.append(F.coalesce(at.isin(value["in"]), F.lit(False)))
            if "regex" in value:
                parts.append(F.coalesce(at.rlike(value["regex"]), F.lit(False)))
        else:
            raise ValueError(f"a rule cannot match on {key!r}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def first_match(rules: list[tuple[str, dict]], name: Column, material: Column | None = None, props: Column | None = None) -> Column:
    """Target of the first rule that holds, else null: one CASE, evaluated row by row."""
    out = F.lit(None).cast("string")
    for target, match in reversed(rules):
        out = F.when(condition(match, name, material, props), F.lit(target)).otherwise(out)
    return out


def load_rules(spec: dict) -> list[tuple[str, dict]]:
    if spec.get("version") != 1:
        raise ValueError("rules must have version 1")
    return [(r["collection"], r["match"]) for r in spec.get("organize", [])]


def mesh_signature(vertices: Column, edges: Column, polygons: Column, first: tuple[Column, Column, Column]) -> Column:
    """16 hex digits over the counts and the first corner with six decimals."""
    corner = F.concat_ws(",", *(F.format_string("%.6f", c) for c in first))
    return F.substring(F.sha1(F.concat_ws("|", vertices, edges, polygons, corner).cast("binary")), 1, 16)


def collapse_meshes(meshes: DataFrame, key: str = "mesh") -> DataFrame:
    """meshes with `canonical`, the smallest key of the same signature, and `copies`."""
    same = meshes.groupBy("signature").agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return meshes.join(same, "signature")


def missing_names(objects: DataFrame, library: DataFrame, key: str = "material") -> DataFrame:
    return objects.select(key).distinct().join(library.select(key), key, "left_anti")


def _triangles(batches):
    for batch in batches:
        for node, data in zip(batch.column("node"), batch.column("data")):
            raw = data.as_py()
            n = int(np.frombuffer(raw, "<u4", 1)[0]) // 3
            corners = np.frombuffer(raw, "<f4", 9 * n, 8).reshape(n, 9)
            columns = [pa.array([node.as_py()] * n, batch.column("node").type), pa.array(np.arange(n)), *(pa.array(corners[:, k].astype(np.float64)) for k in range(9))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "i", *(f"{c}{v}" for v in range(3) for c in "xyz")])


def decode_triangles(nodes: DataFrame) -> DataFrame:
    """Triangles of binary meshes (node, data): two 32-bit counts, then three floats a corner."""
    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "data").mapInArrow(_triangles, f"node {kind}, i long, " + ", ".join(f"{c}{v} double" for v in range(3) for c in "xyz"))


def in_area(triangles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Triangles whose centroid lies in the box."""
    x, y = ((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3.0 for c in "xy")
    return triangles.filter(x.between(box[0], box[2]) & y.between(box[1], box[3]))
