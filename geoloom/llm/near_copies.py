"""Near copies by SimHash and multi-index hashing, for texts of which a fifth may differ.

Two texts are near copies if at least SIMILAR of their distinct shingles of SHINGLE words are shared.
Each text gets a fingerprint of several 64-bit words over its distinct shingles. A fingerprint is cut
into segments; every segment has a table, which is looked up with the segment itself and with the
Hamming ball of radius 1 around it (only bits that are 0 are tried, the partner tries the others).
What meets is verified by the complete distance and then by the shingles themselves.

A segment is wide enough for the number of texts (two bits less than log2), so that chance meetings
per text do not grow with the corpus; there are as many segments as it takes to find a pair at the
limit with probability RECALL, and closer pairs nearly always. The fingerprint grows accordingly.

A value that more than DENSE texts meet would give pairs without bound. Its texts are first compared
with one of them; those found similar are one component and need no comparison among each other.
Only where a value still holds several components, blocks of BLOCK texts are compared inside tasks,
which give back links that join components, not pairs. Nothing is capped.

Cases: a null text counts as empty; texts without words are equal; fewer words than a shingle give
one shingle; repeated rows are returned each; a null id gets the component of its text, and null if
no row of it has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, cut, give_back, remove
from geoloom.llm.components import components

SHINGLE, SEED = 5, 42
#: 0.8, as a fraction.
PART, WHOLE = 4, 5
#: Probability with which a pair at the limit meets in some table; tables at least.
RECALL, TABLES = 0.97, 12
#: How many standard deviations beyond the expected distance at the limit are verified by shingles.
MARGIN = 3.0
#: Texts that meet in one value and are compared one by one; texts of a block.
DENSE, BLOCK = 128, 256
#: Keys and ids are broadcast up to this count; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
MEMO_WORDS, CHUNK = 200_000, 1 << 14


class _Words(dict):
    """64 bits for each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return found


def shingles(text: str | None, memo: dict, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted signed 64-bit hashes."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    size = min(size, len(words))
    hashes, total = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), len(words) - size + 1
    mixed = np.full(total, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + total]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def whole(found: np.ndarray) -> int:
    """One signed 64-bit hash of all shingles."""
    key = xxhash.xxh3_64_intdigest(found.tobytes(), SEED)
    return key - (1 << 64) if key >> 63 else key


def wide_print(found: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words; a bit is 1 if it is set for over half of the shingles."""
    ones = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for begin in range(0, len(found), CHUNK):
        h = (found[begin : begin + CHUNK].view(np.uint64)[:, None] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        # Sums of up to 255 rows fit in a byte.
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if full else 0
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<i8")


class Plan:
    """Width and number of segments for so many texts, and the distance up to which pairs are verified."""

    def __init__(self, texts: int):
        self.width = min(40, max(12, math.ceil(math.log2(max(texts, 1))) - 2))
        shared = 2 * PART / (WHOLE + PART)
        self.flip = math.acos(shared) / math.pi
        stay = 1 - self.flip
        meet = stay**self.width + self.width * self.flip * stay ** (self.width - 1)
        self.tables = max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))
        self.words = -(-self.tables * self.width // 64)
        self.limit, self.limit_first = self.within(64 * self.words), self.within(32)

    def within(self, bits: int) -> int:
        return math.floor(bits * self.flip + MARGIN * math.sqrt(bits * self.flip * (1 - self.flip)))

    def keys(self, print_: np.ndarray) -> np.ndarray:
        """The value of each segment, with the segment's number above it."""
        bits = np.unpackbits(print_.view(np.uint8), bitorder="little")[: self.tables * self.width].reshape(self.tables, self.width)
        return (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1) + (np.arange(self.tables) << self.width)

    def ball(self, keys: np.ndarray) -> np.ndarray:
        """All keys with one more bit set."""
        around = keys[:, None] | (1 << np.arange(self.width))
        return around[around != keys[:, None]]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))


def _printed(plan: Plan):
    def run(batches):
        memo = _Words()
        for all_ in batches:
            for begin in range(0, all_.num_rows, 2048):
                batch = all_.slice(begin, 2048)
                nodes, sizes, prints = [], [], []
                for x in batch.column("text"):
                    found = shingles(x.as_py(), memo)
                    nodes.append(whole(found))
                    sizes.append(len(found))
                    prints.append(wide_print(found, plan.words))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists(prints)], ["id", "node", "n", "print"])
        give_back()

    return run


def _probes(plan: Plan):
    """Per node: its keys, and those of the ball around them."""

    def run(batches):
        for all_ in batches:
            for begin in range(0, all_.num_rows, 2048):
                batch = all_.slice(begin, 2048)
                flat = batch.column("print").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = [plan.keys(x) for x in np.ascontiguousarray(flat)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("n"), pa.array(np.ascontiguousarray(flat[:, 0]).view(np.int32)[::2], pa.int32()), _lists(own), _lists([plan.ball(x) for x in own])],
                    ["node", "n", "sign", "own", "ball"])
        give_back()

    return run


def _items(batches):
    memo = _Words()
    for all_ in batches:
        for begin in range(0, all_.num_rows, 2048):
            found = [shingles(x.as_py(), memo) for x in all_.slice(begin, 2048).column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([whole(x) for x in found], pa.int64()), _lists(found)], ["node", "items"])
    give_back()


def _sized(a: str, b: str):
    """Sets of these sizes can be similar."""
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def _close(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Of pairs (u, v) those within the complete distance."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("print").alias(f"print_{c}"))
    far = F.aggregate(F.zip_with("print_u", "print_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return pairs.join(of("u"), "u").join(of("v"), "v").filter(far <= plan.limit).select("u", "v")


def _verified(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Of pairs (u, v) those that share enough shingles. facts: node, print, items."""
    of = lambda c: facts.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("met", F.size(F.array_intersect("items_u", "items_v")))
    return both.filter(F.col("met") * WHOLE >= (F.size("items_u") + F.size("items_v") - F.col("met")) * PART).select("u", "v")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met * WHOLE >= (len(a) + len(b) - met) * PART


def _block_links(limit: int):
    """Links that join the components found in one block, or in a block of the one side and one of the other."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, comps = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        side = np.array(rows.column("rest").to_pylist())
        items = [np.asarray(x, np.int64) for x in rows.column("items").to_pylist()]
        prints = np.array(rows.column("print").to_pylist(), np.int64).view(np.uint64).reshape(len(nodes), -1)
        root = {c: c for c in comps}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i in np.flatnonzero(side).tolist():
            far = np.bitwise_count(prints ^ prints[i]).sum(axis=1)
            for j in np.flatnonzero(far <= limit).tolist():
                a, b = find(comps[i]), find(comps[j])
                if a != b and _similar(items[i], items[j]):
                    root[a] = b
                    out.append((nodes[i], nodes[j]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run


def _between(rows: DataFrame, facts: DataFrame, plan: Plan, block: int) -> DataFrame:
    """Links between the components of each key, by blocks. rows: key, node, comp, of keys with several components."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).select(
        "key", F.col("most.comp").alias("main"), F.ceil(F.col("most.n") / block).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("rests"))
    rows = rows.join(most, "key").withColumn("rest", F.col("comp") != F.col("main"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    rows = rows.withColumn("part", part)
    # Blocks of the rest meet each other and every block of the main component.
    place = lambda a, b, inner: F.struct(a.alias("a"), b.alias("b"), F.lit(inner).alias("inner"))
    own = F.col("part")
    among = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: place(F.least(k, own), F.greatest(k, own), True))
    across = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: place(own, k, False))
    back = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: place(k, own, False))
    rows = rows.select("key", "node", "comp", "rest", F.inline(F.when(F.col("rest"), F.concat(among, across)).otherwise(back)))
    rows = rows.join(facts, "node").select("key", "a", "b", "inner", "node", "comp", "rest", "print", "items")
    return rows.groupBy("key", "a", "b", "inner").applyInArrow(_block_links(plan.limit), "u long, v long")


def _links(nodes: DataFrame, texts: DataFrame, plan: Plan, dense: int, block: int, bound: int) -> DataFrame:
    """Edges (u, v) that connect all verified pairs of nodes (node, n, print, first)."""
    probes, made = cut(nodes.select("node", "n", "print").mapInArrow(_probes(plan), "node long, n int, sign int, own array<long>, ball array<long>"), "probes")
    filed = probes.select(F.explode("own").alias("key"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("sign").alias("other"))
    crowded, _ = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > dense).select("key"), "crowded")
    some = not crowded.isEmpty()
    full = _small(crowded, bound)
    asked = probes.select(F.explode("own").alias("key"), "node", "n", "sign", F.lit(True).alias("same")).unionByName(
        probes.select(F.explode("ball").alias("key"), "node", "n", "sign", F.lit(False).alias("same")))
    sparse = filed.join(full, "key", "left_anti") if some else filed
    # As a long without the sign's extension, which would be counted.
    near = F.bit_count(F.col("sign").bitwiseXOR(F.col("other")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) <= plan.limit_first
    met = asked.join(sparse, "key").filter(near & _sized("n", "m") & (~F.col("same") | (F.col("node") < F.col("v"))))
    # The shingles are fetched for what is within the complete distance only.
    met = met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
    pairs, pairs_path = cut(_close(met, nodes, plan), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    if some:
        group, _ = cut(asked.join(full, "key", "left_semi").select("key", "node").distinct(), "dense")
        pivots = group.groupBy("key").agg(F.min("node").alias("pivot"))
        star = group.join(pivots, "key").filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
        star, _ = cut(_close(star, nodes, plan), "star")
        wanted = wanted.unionByName(group.select("node"))
    ids, _ = cut(nodes.join(wanted.distinct(), "node").select(F.col("first").alias("id")).distinct(), "wanted")
    chosen = texts.join(_small(ids, bound), texts["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    items = chosen.mapInArrow(_items, "node long, items array<long>").dropDuplicates(["node"])
    facts, facts_path = cut(items.join(nodes.select("node", "print"), "node"), "facts")
    remove(nodes.sparkSession, made)
    edges = _verified(pairs, facts)
    if some:
        found, _ = cut(_verified(star, facts).unionByName(edges), "edges")
        roots = components(found)
        group = group.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        split = group.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("key")
        rest, _ = cut(group.join(split, "key"), "rest")
        edges = found if rest.isEmpty() else found.unionByName(_between(rest, facts, plan, block))
    edges, _ = cut(edges, "links")
    for path in (pairs_path, facts_path):
        remove(nodes.sparkSession, path)
    return edges


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE, block: int = BLOCK, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id_col and component_id, the smallest id that is reachable over near copies."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plan = Plan(rows.count())
    prints, _ = cut(rows.mapInArrow(_printed(plan), f"id {kind}, node long, n int, print array<long>"), "prints")
    nodes, _ = cut(prints.groupBy("node").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("print").alias("print")), "nodes")
    roots = components(_links(nodes, rows, plan, dense, block, bound))
    owner = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = owner.select("node", "root").join(least, "root").select("node", "component_id")
    return prints.select("id", "node").join(owner, "node").select(F.col("id").alias(id_col), "component_id")
