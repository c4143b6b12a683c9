"""A Merkle tree over the rows of a table: digests of rows, groups and table, proofs, verification.

Rows become leaves; leaves of one group stand in the order of their ids. Level by level, `fanout`
consecutive nodes (the last run may have fewer) are collected into a sorted child array and hashed
into their parent, until each group has one node, its subroot. The subroots, in the order of their
groups, are the leaves of a second tree of the same kind, whose last node is the root.

Rows are numbered without a group ever being in one task: they are dealt by ranges of (group, id),
numbered inside a range by row_number, and moved by the rows of their group in the ranges before.
Proofs go down the tree, not up: a node's proof is its siblings followed by its parent's proof, so
the join at a level has only that level's nodes, and all joins together about twice the leaves.

Cases: a null or any other field is written as the contract says (`-`, or its UTF-8 byte count and
its value); a null id comes before every other; rows that share an id are ordered by their leaves,
and rows that are alike in all fields are leaves of their own; a null group is a group of its own and comes
first; texts of any length are hashed whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import cut, remove, table

FANOUT = 2
#: The fields of a leaf, in order, and which rows are tampered with.
FIELDS, TAMPERED = ["doc_id", "source", "lang", "n_chars", "text"], 7
#: Levels that are joined in one plan, on the way down.
JOINS = 4
#: Row counts by range and group are broadcast up to this count (some 40 bytes each); beyond it they are joined.
BROADCAST_RANGES = 200_000


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(x) for x in fields)).cast("binary"), 256))


def as_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def parent(children: Column) -> Column:
    """The digest of the children's digests; both are 32 bytes, hashed as hex text."""
    return F.unhex(F.sha2(as_hex(children).cast("binary"), 256))


def joined(nodes: Column) -> Column:
    """An array of binary values as one."""
    return F.unhex(F.array_join(F.transform(nodes, lambda x: F.hex(x)), ""))


def numbered(rows: DataFrame, order: list[str], broadcast_ranges: int = BROADCAST_RANGES) -> tuple[DataFrame, str]:
    """rows with idx, the place in the order inside the group `grp`, and n, the group's rows; and the path of the table behind it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "grp").orderBy(*order)
    placed, path = cut(ranged.withColumn("place", F.row_number().over(inside) - 1), "merkle-places")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("grp"))}).drop("size")
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_ranges else sizes
    out = placed.join(sizes, ["part", "grp"]).withColumn("idx", F.col("place") + F.col("before"))
    return out.drop("part", "place", "before"), path


def levels(most: int, fanout: int) -> int:
    """Levels above the leaves in a tree of `most` leaves."""
    found = 0
    while most > 1:
        most, found = -(-most // fanout), found + 1
    return found


def climb(nodes: DataFrame, fanout: int, depth: int, label: str) -> tuple[list[tuple[DataFrame, str]], tuple[DataFrame, str]]:
    """nodes: grp, idx, n, node and further columns. The runs of every level, and (grp, node, level) of the groups' last nodes; each with its path."""
    carried = [c for c in nodes.columns if c not in ("grp", "idx", "n", "node")]
    runs, tops = [], nodes.filter("n = 1").select("grp", "node", F.lit(0).alias("level"))
    for level in range(depth):
        child = F.struct("idx", "node", *carried)
        made = nodes.filter("n > 1").groupBy("grp", F.expr(f"idx div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.first("n").alias("n"))
        runs.append(cut(made, f"{label}-runs"))
        nodes = runs[-1][0].select("grp", F.col("up").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), parent(joined(F.col("children.node"))).alias("node"))
        tops, carried = tops.unionByName(nodes.filter("n = 1").select("grp", "node", F.lit(level + 1).alias("level"))), []
    return runs, cut(tops, f"{label}-tops")


def descend(nodes: DataFrame, runs: list[tuple[DataFrame, str]], starts: DataFrame) -> tuple[DataFrame, list[str]]:
    """The nodes that climb() was given, with proof and what starts has besides; starts: grp, level and proof of each group's last node. And the paths of tables that the result doesn't read."""
    carried = [c for c in nodes.columns if c not in ("grp", "idx", "n")]
    given = [c for c in starts.columns if c not in ("grp", "level")]
    spent = [path for _, path in runs[1:]]
    begun = lambda level: starts.filter(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), *given)
    held, path = begun(len(runs)), None
    for level in reversed(range(len(runs))):
        rows, own = runs[level][0], carried if level == 0 else []
        both = rows.join(held.withColumnRenamed("idx", "up"), ["grp", "up"]).select("grp", "children", *given, F.posexplode("children").alias("at", "child"))
        side = lambda begin, count: joined(F.slice(F.col("children.node"), begin, count))
        entry = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.greatest(F.size("children") - F.col("at") - 1, F.lit(0))).alias("after"))
        held = both.withColumn("proof", F.concat(F.array(entry), F.col("proof"))).select("grp", F.col("child.idx").alias("idx"), *given, *(F.col(f"child.{c}").alias(c) for c in own))
        held = held.unionByName(begun(level)) if level else held
        if level % JOINS == 1 % JOINS and level:
            spent += [path] if path else []
            held, path = cut(held, "merkle-proofs")
    alone = nodes.filter("n = 1").select("grp", *carried).join(begun(0).drop("idx"), "grp")
    return (held.drop("idx").unionByName(alone) if runs else alone), spent


def prove(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """rows: id, grp (a sortable string, not null), node (the leaf's digest) and further columns, with subroot, root (binary) and proof: an array, from the leaf to the root, of the siblings before and after."""
    if fanout < 2:
        raise ValueError("a parent needs two children")
    spark = rows.sparkSession
    leaves, path = numbered(rows, ["id", "node"])
    most = leaves.agg(F.max("n")).first()[0] or 0
    runs, (tops, tops_path) = climb(leaves, fanout, levels(most, fanout), "merkle")
    # The subroots are numbered as one group.
    upper = tops.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "node", "level")
    upper, upper_path = numbered(upper, ["id"])
    groups = upper.agg(F.max("n")).first()[0] or 0
    upper_runs, (summit, summit_path) = climb(upper, fanout, levels(groups, fanout), "merkle-top")
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    given, _ = descend(upper, upper_runs, summit.select("grp", "level", F.col("node").alias("root"), empty.alias("proof")))
    starts, _ = cut(given.select(F.col("id").alias("grp"), "level", F.col("node").alias("subroot"), "root", "proof"), "merkle-starts")
    for old in (upper_path, summit_path, *(p for _, p in upper_runs), tops_path):
        remove(spark, old)
    out, spent = descend(leaves, runs, starts)
    for old in spent:
        remove(spark, old)
    return out


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, node, lambda own, s: parent(F.concat(s["before"], own, s["after"])))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.lower(F.array_join(F.transform(proof, lambda s: F.concat(F.hex(s["before"]), F.hex(s["after"]))), "")).cast("binary"), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    # Digests are made once: what follows reads this narrow table several times.
    rows, path = cut(docs.select(F.col("doc_id").alias("id"), grp.alias("grp"), leaf(own).alias("node"), F.when(tampered, leaf(changed)).alias("other")), "merkle-leaves")
    proved = prove(rows)
    remove(spark, path)
    found = proved.withColumn("folded", folded(F.coalesce("other", "node"), F.col("proof")))
    return found.select(
        F.col("id").alias("doc_id"), as_hex(F.col("node")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES = {"op13_merkle": op13_merkle}

_LEAF = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_CHANGED = _LEAF.replace("n_chars::", "(n_chars + 1)::")
_CRC = "xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

ORACLE_SQL = {
    "op13_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN {_CRC} % {TAMPERED} = 0 THEN sha256({_CHANGED}) ELSE sha256({_LEAF}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (
  SELECT 0 AS k, lang, i, leaf AS h FROM l
  UNION ALL
  SELECT k + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM t) WHERE n > 1 GROUP BY k, lang, i // 2),
e AS (SELECT lang, max(k) AS k FROM t GROUP BY lang),
s AS (SELECT t.lang, t.h, t.k, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS i FROM t JOIN e ON t.lang IS NOT DISTINCT FROM e.lang AND t.k = e.k),
u AS (
  SELECT 0 AS k, i, h FROM s
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY k, i // 2),
top AS (SELECT max(k) AS k FROM u),
path AS (
  SELECT l.doc_id, l.lang, l.leaf, l.i AS first_i, 0 AS k, s.k AS depth, false AS upper, l.i AS i, s.i AS s_i, s.h AS subroot, l.changed AS f, '' AS proof
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.first_i,
         CASE WHEN NOT p.upper AND p.k >= p.depth THEN 0 ELSE p.k + 1 END, p.depth, p.upper OR p.k >= p.depth,
         CASE WHEN NOT p.upper AND p.k >= p.depth THEN p.s_i ELSE p.i // 2 END, p.s_i, p.subroot,
         CASE WHEN NOT p.upper AND p.k >= p.depth THEN p.f WHEN p.i % 2 = 1 THEN sha256(coalesce(t.h, u.h) || p.f) ELSE sha256(p.f || coalesce(t.h, u.h, '')) END,
         p.proof || coalesce(t.h, u.h, '')
  FROM path p CROSS JOIN top
  LEFT JOIN t ON NOT p.upper AND p.k < p.depth AND t.k = p.k AND t.lang IS NOT DISTINCT FROM p.lang AND t.i = xor(p.i, 1)
  LEFT JOIN u ON p.upper AND u.k = p.k AND u.i = xor(p.i, 1)
  WHERE NOT p.upper OR p.k < top.k)
SELECT p.doc_id, p.leaf, p.subroot, u.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = u.h AS verified
FROM path p CROSS JOIN top JOIN u ON u.k = top.k WHERE p.upper AND p.k = top.k
"""
}
