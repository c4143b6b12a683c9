"""Mesh archives: node tables out of node pages, facts about nodes and entries, and areas of interest."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import geometry

PAGE = ("STRUCT<nodes: ARRAY<STRUCT<index: BIGINT, lodThreshold: DOUBLE, children: ARRAY<BIGINT>, "
        "obb: STRUCT<center: ARRAY<DOUBLE>, halfSize: ARRAY<DOUBLE>, quaternion: ARRAY<DOUBLE>>, "
        "mesh: STRUCT<geometry: STRUCT<resource: BIGINT, vertexCount: BIGINT>, material: STRUCT<resource: BIGINT>>>>>")


def _plain(batches):
    for batch in batches:
        out = []
        for name, data in zip(batch.column("name").to_pylist(), batch.column("content")):
            data = data.as_py()
            try:
                out.append(gzip.decompress(data) if data is not None and name.endswith(".gz") else data)
            except (OSError, EOFError, zlib.error):
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])


def unpacked(entries: DataFrame) -> DataFrame:
    """name and content of entries; those that end in .gz are unpacked, null where that fails."""
    return entries.select("name", "content").mapInArrow(_plain, "name string, content binary")


def node_table(pages: DataFrame, column: str = "value") -> DataFrame:
    """One row per node of the JSON pages; of a node on several pages one with the most vertices stays."""
    n = pages.select(F.from_json(column, PAGE).alias("p")).select(F.inline("p.nodes"))
    at = lambda c, i: F.get(F.col(f"obb.{c}"), F.lit(i))
    rows = n.filter("index is not null").select(
        F.col("index").alias("node"), *(at("center", i).alias(f"c{a}") for i, a in enumerate("xyz")), *(at("halfSize", i).alias(f"h{a}") for i, a in enumerate("xyz")),
        F.coalesce("lodThreshold", F.lit(0.0)).alias("lod"), F.col("mesh").isNotNull().alias("has_mesh"), (F.coalesce(F.size("children"), F.lit(0)) > 0).alias("has_children"),
        F.col("mesh.geometry.resource").alias("geometry"), F.col("mesh.material.resource").alias("material"), F.coalesce("mesh.geometry.vertexCount", F.lit(0)).alias("vertices"))
    rest = [c for c in rows.columns if c != "node"]
    return rows.groupBy("node").agg(F.max(F.struct("vertices", *[c for c in rest if c != "vertices"])).alias("r")).select("node", *(f"r.{c}" for c in rest))


def is_leaf() -> Column:
    return F.col("has_mesh") & ~F.col("has_children")


def half_sizes(nodes: DataFrame, *by: str) -> DataFrame:
    """Least, middle (the upper one of two) and largest half size of nodes with a mesh."""
    # The rank of the upper middle, 1-based, is half the count plus one.
    out = nodes.filter("has_mesh").groupBy(*by)
    stats = [f(c).alias(f"{n}_{c}") for c in ("hx", "hy") for n, f in (("least", F.min), ("most", F.max))]
    upper = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})").alias(f"__{c}") for c in ("hx", "hy")]
    return out.agg(F.count(F.lit(1)).alias("n"), *stats, *upper).withColumns({"middle_hx": -F.col("__hx"), "middle_hy": -F.col("__hy")}).drop("__hx", "__hy")


def directories(entries: DataFrame) -> DataFrame:
    """Entries and packed bytes of each directory or file at the top of an archive."""
    return entries.groupBy(F.split("name", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n"), F.sum("packed").alias("packed"))


def contiguity(entries: DataFrame, prefix: str, slack: float = 1.5) -> DataFrame:
    """Whether the entries below a prefix lie close enough together to be read at once."""
    own = entries.filter(F.col("name").startswith(prefix))
    facts = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"), (F.max(F.col("header") + F.col("packed")) - F.min("header")).alias("span"))
    return facts.withColumn("contiguous", F.col("span") < F.col("packed") * slack)


def first_archive(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Each wanted name (id, name) with the first archive (by rank) that has an entry of that name, and where it lies in it."""
    met = wanted.join(entries, "name")
    rest = [c for c in entries.columns if c not in ("name", "rank")]
    first = met.groupBy("id").agg(F.min_by(F.struct("rank", *rest), "rank").alias("e"))
    return wanted.join(first, "id", "left").select("id", "name", "e.*")


def densest_area(nodes: DataFrame, cell: float, half: float) -> DataFrame:
    """A square around the mean centre of the leaves in the densest cell, with the leaves that meet it and their vertices."""
    leaves = nodes.filter(is_leaf()).withColumns({"cell_x": F.floor(F.col("cx") / cell), "cell_y": F.floor(F.col("cy") / cell)})
    dense = leaves.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.avg("cx").alias("x"), F.avg("cy").alias("y")).orderBy(F.desc("n"), "cell_x", "cell_y").limit(1)
    area = dense.select(F.col("n").alias("in_cell"), (F.col("x") - half).alias("min_x"), (F.col("y") - half).alias("min_y"), (F.col("x") + half).alias("max_x"), (F.col("y") + half).alias("max_y"))
    box = (F.col("cx") - F.col("hx"), F.col("cy") - F.col("hy"), F.col("cx") + F.col("hx"), F.col("cy") + F.col("hy"))
    # One area, so a broadcast of one row.
    met = leaves.join(F.broadcast(area), geometry.boxes_meet(box, (F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))))
    return met.groupBy("in_cell", "min_x", "min_y", "max_x", "max_y").agg(F.count(F.lit(1)).alias("leaves"), F.sum("vertices").alias("vertices"))
