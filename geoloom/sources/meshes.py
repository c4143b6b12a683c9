"""Textured meshes: binary nodes with texture coordinates, and OBJ, MTL and binary glTF files per node.

A node's binary mesh has two 32-bit counts, then the positions of all corners (three floats each),
then their texture coordinates (two floats each); three corners after another are a triangle. Corners
are rows. Triangles are kept by their centroid, and the corners that are left are numbered node by
node, within a node and over all nodes in the nodes' order. Each node is written by one task, from its
own corners; no mesh of several nodes is in one place.

Cases: a node without corners, or of which no triangle is kept, has no file; a mesh without texture
coordinates has null u and v, and its files none; a mesh that is cut off ends the read with an error
that names the node; a file of the same node that is there already is replaced.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.sources import files

CORNERS = "i long, x double, y double, z double, u double, v double"
# Fixed values of binary glTF: magic, version, chunk kinds, component types, what a buffer is for, primitives of triangles.
MAGIC, VERSION, JSON_CHUNK, BINARY_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
FLOAT, UNSIGNED, VERTICES, INDEXES, TRIANGLES = 5126, 5125, 34962, 34963, 4


def decode_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions (n x 3) and texture coordinates (n x 2, or none) of a binary mesh."""
    n, = struct.unpack("<I", data[:4])
    if n % 3 or len(data) < 8 + 12 * n:
        raise ValueError("a mesh is cut off")
    positions = np.frombuffer(data, "<f4", 3 * n, 8).reshape(n, 3)
    behind = len(data) - 8 - 12 * n
    return positions, np.frombuffer(data, "<f4", 2 * n, 8 + 12 * n).reshape(n, 2) if behind >= 8 * n > 0 else None


def _corners(batches):
    for batch in batches:
        for k, (node, data) in enumerate(zip(batch.column("node").to_pylist(), batch.column("data"))):
            try:
                positions, uv = decode_mesh(data.as_py())
            except (ValueError, struct.error) as e:
                raise ValueError(f"node {node}: {e}") from e
            n, place = len(positions), np.array([batch.column(c)[k].as_py() for c in ("cx", "cy", "cz")])
            at = positions.astype(np.float64) + place
            texture = [pa.nulls(n, pa.float64())] * 2 if uv is None else [pa.array(uv[:, j].astype(np.float64)) for j in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([node] * n, batch.column("node").type), pa.array(np.arange(n)), *(pa.array(at[:, j]) for j in range(3)), *texture], ["node", "i", "x", "y", "z", "u", "v"])


def corners(nodes: DataFrame) -> DataFrame:
    """node, i, x, y, z, u and v of the corners of binary meshes (node, data); cx, cy and cz, where there are such, are the nodes' centres."""
    kind = nodes.schema["node"].dataType.simpleString()
    centre = [F.col(c).cast("double").alias(c) if c in nodes.columns else F.lit(0.0).alias(c) for c in ("cx", "cy", "cz")]
    return nodes.select("node", "data", *centre).mapInArrow(_corners, f"node {kind}, {CORNERS}")


def in_area(found: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Corners of the triangles whose centroid lies in the box."""
    rows = found.withColumn("__t", F.floor(F.col("i") / 3))
    same = Window.partitionBy("node", "__t")
    # Three rows each.
    x, y = (F.sum(c).over(same) / 3.0 for c in "xy")
    kept = x.between(box[0], box[2]) & y.between(box[1], box[3])
    return rows.withColumn("__kept", kept).filter("__kept").drop("__t", "__kept")


def numbered(found: DataFrame) -> DataFrame:
    """Corners with k, their number in the node, and vertex, their number over all nodes; both from 0.

    Only one row per node is put in one order.
    """
    own = found.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("i")) - 1)
    before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    begin = found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("node", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return own.join(begin, "node").withColumn("vertex", F.col("begin") + F.col("k")).drop("begin")


def obj_text(name: str, points: np.ndarray, uv: np.ndarray | None, base: int = 0) -> str:
    """A Wavefront mesh whose first vertex has the number base + 1; texture coordinates count from the bottom."""
    lines = [f"o node_{name}", *(f"v {x:.4f} {y:.4f} {z:.4f}" for x, y, z in points)]
    if uv is not None:
        lines += [f"vt {u:.6f} {1 - v:.6f}" for u, v in uv]
    lines.append(f"usemtl m{name}")
    mark = (lambda k: f"{k}/{k}") if uv is not None else str
    lines += ["f " + " ".join(mark(base + j + 1) for j in range(k, k + 3)) for k in range(0, len(points), 3)]
    return "\n".join(lines) + "\n"


def mtl_text(name: str) -> str:
    return "\n".join([f"newmtl m{name}", "Ka 1 1 1", "Kd 1 1 1", "d 1", "illum 1", f"map_Kd tex/node_{name}.jpg", ""]) + "\n"


def encode_glb(points: np.ndarray, uv: np.ndarray | None = None) -> bytes:
    """A binary glTF mesh of triangles; corners that are alike become one vertex. Buffers begin at multiples of four bytes."""
    rows = points.astype("<f4") if uv is None else np.hstack([points, uv]).astype("<f4")
    alone, index = np.unique(rows, axis=0, return_inverse=True)
    place = np.ascontiguousarray(alone[:, :3])
    parts = [(place.tobytes(), VERTICES, FLOAT, len(alone), "VEC3", {"min": place.min(axis=0).tolist(), "max": place.max(axis=0).tolist()})]
    if uv is not None:
        parts.append((np.ascontiguousarray(alone[:, 3:]).tobytes(), VERTICES, FLOAT, len(alone), "VEC2", {}))
    parts.append((index.ravel().astype("<u4").tobytes(), INDEXES, UNSIGNED, index.size, "SCALAR", {"min": [0], "max": [len(alone) - 1]}))
    body, views, accessors = b"", [], []
    for k, (data, target, kind, count, shape, bounds) in enumerate(parts):
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(data), "target": target})
        accessors.append({"bufferView": k, "componentType": kind, "count": count, "type": shape, **bounds})
        body += data + b"\0" * (-len(data) % 4)
    attributes = {"POSITION": 0, **({"TEXCOORD_0": 1} if uv is not None else {})}
    text = json.dumps({"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
                       "meshes": [{"primitives": [{"attributes": attributes, "indices": len(parts) - 1, "mode": TRIANGLES}]}],
                       "buffers": [{"byteLength": len(body)}], "bufferViews": views, "accessors": accessors}).encode()
    text += b" " * (-len(text) % 4)
    chunk = lambda kind, data: struct.pack("<II", len(data), kind) + data
    inner = chunk(JSON_CHUNK, text) + chunk(BINARY_CHUNK, body)
    return struct.pack("<III", MAGIC, VERSION, 12 + len(inner)) + inner


def decode_glb(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions and texture coordinates of the corners of a mesh, triangle by triangle."""
    magic, version, size = struct.unpack("<III", data[:12])
    if magic != MAGIC or version != VERSION or size != len(data):
        raise ValueError("no binary glTF of version 2, or cut off")
    n, kind = struct.unpack("<II", data[12:20])
    head, at = json.loads(data[20 : 20 + n]), 20 + n
    m, other = struct.unpack("<II", data[at : at + 8])
    if kind != JSON_CHUNK or other != BINARY_CHUNK:
        raise ValueError("the chunks are not in order")
    body = data[at + 8 : at + 8 + m]

    def values(k: int) -> np.ndarray:
        a = head["accessors"][k]
        view = head["bufferViews"][a["bufferView"]]
        width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3}[a["type"]]
        return np.frombuffer(body, {FLOAT: "<f4", UNSIGNED: "<u4"}[a["componentType"]], a["count"] * width, view["byteOffset"]).reshape(-1, width)

    shape = head["meshes"][0]["primitives"][0]
    index = values(shape["indices"]).ravel()
    uv = shape["attributes"].get("TEXCOORD_0")
    return values(shape["attributes"]["POSITION"])[index], None if uv is None else values(uv)[index]


def _written(folder: str, job: str, form: str, anchor: tuple[float, float]):
    def run(batches):
        made, now, held = [], None, []

        def close():
            if now is None:
                return
            rows = np.concatenate(held)
            points, uv = rows[:, :3] - np.array([*anchor, 0.0]), None if np.isnan(rows[:, 3:]).any() else rows[:, 3:]
            texts = {"glb": [("glb", encode_glb(points, uv))], "obj": [("obj", b"mtllib node_" + str(now).encode() + b".mtl\n" + obj_text(str(now), points, uv).encode()), ("mtl", mtl_text(str(now)).encode())]}[form]
            for end, data in texts:
                temp = files.hidden(folder, job)
                made.append((f"node_{now}.{end}", temp, files.write(temp, [data])))

        for batch in batches:
            names = batch.column("node").to_pylist()
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y", "z", "u", "v")]) if names else None
            begin = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[begin]:
                    if names[begin] != now:
                        close()
                        now, held = names[begin], []
                    held.append(rows[begin:k])
                    begin = k
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["name", "temp", "bytes"])

    return run


def write_meshes(found: DataFrame, folder: str, form: str = "glb", anchor: tuple[float, float] = (0.0, 0.0)) -> list[str]:
    """Writes a file per node (`glb`, or `obj` with its `mtl`), with positions around the anchor; returns their names."""
    if form not in ("glb", "obj"):
        raise ValueError("meshes are written as glb or obj")
    job = uuid.uuid4().hex
    try:
        made = found.select("node", "i", "x", "y", "z", "u", "v").repartition("node").sortWithinPartitions("node", "i").mapInArrow(_written(folder, job, form, anchor), "name string, temp string, bytes long").collect()
        files.publish([(r["temp"], f"{folder.rstrip('/')}/{r['name']}") for r in made])
    finally:
        files.discard(folder, job)
    return sorted(r["name"] for r in made)


def _from_glb(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            points, uv = decode_glb(data.as_py())
            n = len(points)
            texture = [pa.nulls(n, pa.float64())] * 2 if uv is None else [pa.array(uv[:, j].astype(np.float64)) for j in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n)), *(pa.array(points[:, j].astype(np.float64)) for j in range(3)), *texture], ["path", "i", "x", "y", "z", "u", "v"])


def read_glb(spark, path: str) -> DataFrame:
    """path, i, x, y, z, u and v of the corners of all binary glTF files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(path)
    return found.select("path", "content").mapInArrow(_from_glb, f"path string, {CORNERS}")
