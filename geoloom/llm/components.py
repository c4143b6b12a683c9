"""Connected components of a graph given as an edge table, by alternating star contractions.

Each round hangs every node's larger neighbours under its smallest neighbour, then does the same
with the smaller ones. Rounds go on until the edges no longer change; they then form stars around
the smallest node of each component. Every round is written to the shared folder, the one before is
removed. The work of a round is in proportion to the edges; joins on a hot centre are left to
adaptive execution, which splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long; root is the smallest node of its component."""
    spark = edges.sparkSession
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut(pairs, "edges")
    facts = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = facts(now)
    while before[0]:
        after_df, after_path = cut(_small_star(_large_star(now)), "edges")
        remove(spark, path)
        now, path, after = after_df, after_path, facts(after_df)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
