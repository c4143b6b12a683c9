"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint has a bit set where over half of the shingles' XXH64 values have it set. Only distinct
fingerprints are compared. They are cut into two segments of 32 bits; by the generalised pigeonhole
principle two fingerprints within 2 bits agree in the low segment, or differ in one bit at most in
the high one. So the table is looked up with the low segment as it is, and with the Hamming ball of
radius 1 around the high segment, of which only bits that are 0 are tried (the other partner tries
it from its side). Matches are verified by the complete distance.

A segment value with more than DENSE fingerprints would give pairs without bound. Every fingerprint
that meets such a value is linked in another exact way: two fingerprints within 2 bits share a point
within 1 bit of both, so each emits the 65 points around it; at most 65 fingerprints share a point,
and they are linked to the smallest of them. Nothing is capped.

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked like
any other; fewer words than a shingle give one shingle; repeated rows are returned each; a null id
gets the component of its fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, cut, table
from geoloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in one segment value that are compared one by one.
DENSE = 24
#: Shingles hashed at once, which bounds the memory for a long text.
CHUNK = 1 << 17
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, unsigned."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined, total = b" ".join(words), len(words) - size + 1
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[: total - 1])).tolist()
    ends, digest, ones = (stops[size - 1 :] - 1).tolist(), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, total, CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + CHUNK], ends[a : a + CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _printed(batches):
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_printed, f"id {kind}, fp long")


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints `fp` of prints that connect all that are within RADIUS bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    entry = lambda seg, key: F.struct(F.lit(seg).alias("seg"), key.alias("key"))
    filed = prints.select("fp", F.inline(F.array(entry(0, high), entry(1, low))))
    ball = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(F.shiftrightunsigned("fp", 32), i) == 0),
        lambda i: F.struct(F.lit(0).alias("seg"), high.bitwiseOR(_bit(i)).alias("key"), F.lit(False).alias("own")),
    )
    own = F.array(*(F.struct(F.lit(s).alias("seg"), k.alias("key"), F.lit(True).alias("own")) for s, k in ((0, high), (1, low))))
    probes = prints.select("fp", F.inline(F.concat(own, ball)))

    counts = filed.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.filter(F.col("n") > dense).select("seg", "key")
    sparse = filed.join(crowded, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    met = probes.join(sparse, ["seg", "key"]).filter((~F.col("own") | (F.col("fp") < F.col("other"))) & near)

    flagged = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    point = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i)))
    points = flagged.select("fp", F.explode(F.concat(F.array("fp"), point)).alias("point"))
    stars = points.groupBy("point").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("fp"), F.explode("all").alias("other")).filter((F.col("fp") != F.col("other")) & near)
    return met.select("fp", "other").unionByName(stars).toDF("u", "v")


def _bit(i):
    """1 << i for a column i of 0 to 63."""
    return F.element_at(F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64))), i + 1)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per row of docs: id_col, fp and component_id, the smallest id that is reachable over links."""
    prints, _ = cut(fingerprints(bounded(docs), id_col, text_col), "simhash")
    distinct, _ = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash")
    roots = components(links(distinct.select("fp"), dense))
    owner = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = owner.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLE_SQL: dict[str, str] = {}
