"""Shards of nearly equal bytes by a k-d tree over the rows' metadata.

A node of the tree holds rows and a number of shards to make of them. It is split along the
dimension in which its rows spread widest (as a share of the spread in the whole table; equal ones
in the order given) at a weighted quantile: half of the shards, and their share of the bytes, go to
the left, until a node is one shard. So a shard holds rows that are alike in language, source,
length and age, and its bytes differ from the others' by about a row for each level.

The quantile is exact and distributed: rows of a node are counted by bytes into buckets of the
dimension's coordinate, and again inside the bucket that holds the quantile, until few rows are left,
which are ordered. Rows that are equal in the dimension are divided in a fixed pseudo-random order, so
a source or a text with a third of all rows is split as finely as any other. Only counts by node and
bucket, and at most FINISH rows in all of a step, reach the driver. Rows travel as ids, sizes and
coordinates, never with their texts, and are shuffled once, to be given their slots.

Cases: a null text has no bytes and counts as OVERHEAD, its crc32 is that of the empty text; a null in
any dimension is a value of its own; a text's length only changes its row's weight, and one that exceeds a
shard is a shard alone or with few others; rows that share an id, or are alike altogether, are divided
like others; fewer rows than shards leave shards without rows; equal texts may be in several shards,
since no bound on bytes could hold otherwise; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import cut, remove, table

#: Bytes that a row has besides its text's; shards that the query makes.
OVERHEAD, SHARDS = 16, 40
#: Rows that a step brings to the driver at most, to be ordered; buckets of all nodes of a step at most.
FINISH, BUCKETS = 10_000, 200_000
#: Parts of a shard that are numbered on their own, in different tasks.
SLOT_PARTS = 256
#: The bits of a hash that serve as a coordinate, and as the order of rows that are equal in the dimension.
HASH_BITS = 52


def hashed(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 64 - HASH_BITS)


def number(value: Column) -> Column:
    """The coordinate of a whole number; halved, so that differences fit. Null comes first."""
    return F.coalesce(F.shiftright(value.cast("long"), 1), F.lit(-(1 << 62)))


def category(value: Column) -> Column:
    """The coordinate of a value without an order: equal ones stay together. Null is a value of its own."""
    return hashed(value.isNull(), value)


class Cut:
    """The search for a node's quantile: rows left of it have the keys below `low`, and weigh `left`; it lies among those up to `high`."""

    def __init__(self, dim: int, extent: tuple[int, int], goal: float):
        self.dim, self.goal, self.left = dim, goal, 0
        self.part, self.fixed, self.low, self.high = 0, [], *extent
        self.key: list[int] | None = None

    def width(self, buckets: int) -> int:
        return -(-(self.high - self.low + 1) // buckets)

    def narrow(self, weights: dict[int, int], width: int, next_extent: tuple[int, int]) -> None:
        """weights: bytes by bucket. Goes into the bucket that the goal lies in; through with a part of the key, on to the next."""
        found = None
        for k, w in sorted(weights.items()):
            found = k
            if self.left + w >= self.goal:
                break
            self.left += w
        else:
            if found is not None:
                self.left -= weights[found]
        base = self.low
        self.low, self.high = base + found * width, min(self.high, base + (found + 1) * width - 1)
        if self.low == self.high and self.part < 2:
            self.fixed.append(self.low)
            self.part, (self.low, self.high) = self.part + 1, next_extent
        elif self.low == self.high:
            # One row, or rows that nothing tells apart: they go to the side that is then nearer to its share.
            self.key = [*self.fixed, self.low + (2 * (self.goal - self.left) > weights[found])]

    def finish(self, rows: list[tuple]) -> None:
        """rows: (key..., bytes) of all that is left, in order. The first row on the right is the one at which the left side is nearest to the goal."""
        sums = list(accumulate((x[-1] for x in rows), initial=self.left))
        best = min(range(len(sums)), key=lambda k: abs(sums[k] - self.goal))
        self.key = list(rows[best][:3]) if best < len(rows) else [*rows[-1][:2], rows[-1][2] + 1]


#: Of each node in search: its dimension, the part of the key that is searched, the parts that are fixed, the range and the bucket's width.
STEP = "node long, dim int, part int, fixed0 long, fixed1 long, low long, high long, width long"


def _kept(rows: DataFrame, step: DataFrame, dims: int) -> DataFrame:
    """Rows in the ranges that are searched, with at: the part of the key that is."""
    both = rows.join(F.broadcast(step), "node").withColumn("v", _value(F.col("dim"), dims))
    at = F.when(F.col("part") == 0, F.col("v")).when(F.col("part") == 1, F.col("h")).otherwise(F.col("r"))
    same = ((F.col("part") < 1) | (F.col("v") == F.col("fixed0"))) & ((F.col("part") < 2) | (F.col("h") == F.col("fixed1")))
    return both.withColumn("at", at).filter(same & F.col("at").between(F.col("low"), F.col("high")))


def _value(dim: Column, dims: int) -> Column:
    return F.coalesce(*(F.when(dim == k, F.col(f"d{k}")) for k in range(dims)))


def _search(rows: DataFrame, cuts: dict[int, Cut], dims: int, extents: list[tuple[int, int]], finish: int, buckets: int) -> None:
    """Finds the keys of all cuts. rows: node, size, h, r and d0 ..; extents: of h and r."""
    spark = rows.sparkSession
    while open_ := {k: c for k, c in cuts.items() if c.key is None}:
        width = {k: c.width(max(16, buckets // len(open_))) for k, c in open_.items()}
        step = spark.createDataFrame([(k, c.dim, c.part, *[*c.fixed, 0, 0][:2], c.low, c.high, width[k]) for k, c in open_.items()], STEP)
        kept = _kept(rows, step, dims)
        counts = kept.groupBy("node", F.expr("(at - low) div width").alias("bucket")).agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
        weights: dict[int, dict[int, int]] = {k: {} for k in open_}
        sizes: dict[tuple[int, int], int] = {}
        for node, bucket, weight, n in counts.collect():
            weights[node][bucket], sizes[node, bucket] = weight, n
        left = 0
        for k, c in open_.items():
            base, part = c.low, c.part
            c.narrow(weights[k], width[k], extents[min(part, 1)])
            # The last value of a part of the key is in the bucket that was gone into.
            left += sizes[k, ((c.fixed[part] if c.part > part else c.low) - base) // width[k]]
        open_ = {k: c for k, c in open_.items() if c.key is None}
        if open_ and left <= finish:
            step = spark.createDataFrame([(k, c.dim, c.part, *[*c.fixed, 0, 0][:2], c.low, c.high, 1) for k, c in open_.items()], STEP)
            found: dict[int, list[tuple]] = {k: [] for k in open_}
            for node, *key in _kept(rows, step, dims).select("node", "v", "h", "r", "size").collect():
                found[node].append(tuple(key))
            for k, c in open_.items():
                c.finish(sorted(found[k]))


def kd_shards(rows: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None, finish: int = FINISH, buckets: int = BUCKETS) -> DataFrame:
    """rows (id, size, crc and coordinates, whole numbers without nulls) with shard, from 0, and slot, gapless from 0 inside a shard.

    Either the number of shards is given or the bytes that a shard should have.
    """
    if (shards is None) == (target_bytes is None) or min(x for x in (shards, target_bytes) if x is not None) < 1:
        raise ValueError("give either a number of shards or the bytes of one")
    spark, n = rows.sparkSession, len(dims)
    key = ["id", "size", "crc"]
    # The row's number only orders rows that are alike in id, size and crc; written once, it stays.
    own = rows.select(*key, hashed(*(F.col(c) for c in key)).alias("h"), *(F.col(c).alias(f"d{k}") for k, c in enumerate(dims))).withColumn("r", F.monotonically_increasing_id())
    at, path = cut(own.withColumn("node", F.lit(0).cast("long")), "shard-rows")
    spread = [f(x).alias(f"{f.__name__}_{x}") for k in range(n) for x in [f"d{k}"] for f in (F.min, F.max)]
    facts = lambda: {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("weight"), F.max("r").alias("most"), *spread).collect()}
    extent = lambda r, k: (r[f"min_d{k}"], r[f"max_d{k}"])
    found = facts()
    if not found:
        return at.select(*key, F.lit(0).alias("shard"), F.lit(0).alias("slot"))
    table_extent = [extent(found[0], k) for k in range(n)]
    wanted = shards or max(1, -(-found[0]["weight"] // target_bytes))
    extents = [(0, (1 << HASH_BITS) - 1), (0, found[0]["most"])]
    # By node: its first shard and its shards. Nodes are named by their first shard.
    todo = {0: wanted}
    while max(todo.values()) > 1:
        cuts: dict[int, Cut] = {}
        for node, k in todo.items():
            if k > 1 and node in found:
                r = found[node]
                wide = [(extent(r, d)[1] - extent(r, d)[0]) / max(1, table_extent[d][1] - table_extent[d][0]) for d in range(n)]
                dim = wide.index(max(wide))
                cuts[node] = Cut(dim, extent(r, dim), r["weight"] * (k // 2) / k)
        _search(at, cuts, n, extents, finish, buckets)
        split = spark.createDataFrame([(k, c.dim, *c.key, k + todo[k] // 2) for k, c in cuts.items()], "node long, dim int, kv long, kh long, kr long, other long")
        both = at.join(F.broadcast(split), "node", "left").withColumn("v", _value(F.col("dim"), n))
        right = F.struct("v", "h", "r") >= F.struct(F.col("kv").alias("v"), F.col("kh").alias("h"), F.col("kr").alias("r"))
        moved, new = cut(both.withColumn("node", F.when(F.col("other").isNotNull() & right, F.col("other")).otherwise(F.col("node"))).select(*at.columns), "shard-rows")
        remove(spark, path)
        at, path = moved, new
        todo = {x: y for node, k in todo.items() for x, y in ([(node, k // 2), (node + k // 2, k - k // 2)] if k > 1 else [(node, k)])}
        found = facts()
    return _slots(at.withColumnRenamed("node", "shard"), key)


def _slots(at: DataFrame, key: list[str]) -> DataFrame:
    """Slots in the order of the hash. A shard is numbered in SLOT_PARTS parts of that order, each of which begins where the one before ends."""
    at = at.withColumn("part", F.shiftrightunsigned("h", HASH_BITS - SLOT_PARTS.bit_length() + 1))
    inside = Window.partitionBy("shard", "part").orderBy("h", *key, "r")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = at.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    placed = at.withColumn("place", F.row_number().over(inside) - 1).join(begin, ["shard", "part"])
    return placed.select(*key, F.col("shard").cast("int").alias("shard"), (F.col("place") + F.col("begin")).alias("slot"))


def weighed(docs: DataFrame) -> DataFrame:
    """id, size and crc of documents with the coordinates of language, source, length and id."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").alias("id"), (F.octet_length(data).cast("long") + OVERHEAD).alias("size"), F.crc32(data).alias("crc"),
        category(F.col("lang")).alias("by_lang"), category(F.col("source")).alias("by_source"), number(F.col("n_chars")).alias("by_length"), number(F.col("doc_id")).alias("by_id"),
    )


def op12_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kd_shards(weighed(table(spark, sf_dir, "documents")), ["by_lang", "by_source", "by_length", "by_id"], shards=SHARDS)
    return made.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


QUERIES = {"op12_kd_sharding": op12_kd_sharding}
#: Exact weighted quantiles of a tree that is made as it is split; tested against a version that sorts each node's rows.
ORACLE_SQL: dict[str, str] = {}
