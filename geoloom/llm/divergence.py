"""How far the sources of a language differ: chi-square divergences from exact term counts.

Terms are counted by language and source; a language keeps the terms that enough of its documents
have. Between two sources the divergence is a sum over all kept terms of f(p, q), where p and q
depend on the two counts alone. So for each pair the distinct combinations (count, count) are
tallied, and f is evaluated once per combination, times its multiplicity. Only terms that both
sources have are ever paired, by a join on the term whose rows are folded into combinations in the
same task; combinations with a zero follow from each source's own tally less the joint one, and the
zero on both sides from the number of kept terms. All arithmetic is on whole numbers, floors included.

The counts come from whole texts: a task counts what it reads, and hands on its counts whenever it
holds HELD distinct terms. The best terms of a source are found in PARTS parts first, so that no
source's terms are ever ranked in one task.

Cases: a null text, language or source is the empty string; a row is a document, also if rows share
an id or are alike; a text without terms still makes its source a group; a language that keeps no
term has pairs of value 0 and no terms; a source that is alone in its language has no pairs; equal
values are ranked by item; texts of any length are counted whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, cut, give_back, remove, table

#: Documents of a language that a kept term stands in at least; best terms of a source that are returned.
LEAST_DOCS, TOP = 3, 200
#: Distinct terms that a task holds before it hands on their counts.
HELD = 200_000
#: Parts in which a source's terms are ranked before the best of all parts are.
PARTS = 32
#: Sums by language and source are broadcast up to this count (some 60 bytes each); beyond it they are joined.
BROADCAST_GROUPS = 100_000
#: The whole that shares are parts of, and the bytes that end a term. Bytes from 128 on are parts of characters that belong to terms.
WHOLE = 1_000_000_000
_TO_SPACE = bytes(32 if x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256))
_LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)).translate(_TO_SPACE)

COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, with A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _counted(held: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed():
            for (lang, source), (n, docs) in groups.items():
                size = len(n)
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
                made = pa.RecordBatch.from_arrays(columns, schema=schema)
                yield from (made.slice(k, 10_000) for k in range(0, size, 10_000))
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                found = terms((text.as_py() or "").encode("utf-8"))
                if not found:
                    continue
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in groups.values()) >= held:
                yield from handed()
        yield from handed()
        give_back()

    return run


def term_counts(docs: DataFrame, least: int = LEAST_DOCS, held: int = HELD) -> tuple[DataFrame, str]:
    """lang, source, term and n of the kept terms that the source has, with all_n, the term's count in its language, and first: true in one source of each term."""
    rows = bounded(docs).mapInArrow(_counted(held), COUNTED)
    cells = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"all_n": F.sum("n").over(same), "all_docs": F.sum("docs").over(same), "first": F.col("source") == F.min("source").over(same)})
    return cut(cells.filter(F.col("all_docs") >= least).drop("docs", "all_docs"), "term-counts")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + kept)), in decimals since the product may exceed 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = wide(F.greatest(total + kept, F.lit(1)))
    return 1 + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * wide(n + 1), below)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most WHOLE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of all ordered pairs of sources. groups: lang, source, total, distinct and kept."""
    tally = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    one, two = (cells.select("lang", "term", F.col("source").alias(s), F.col("n").alias(n)) for s, n in (("a", "na"), ("b", "nb")))
    joint = one.join(two, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("times"))
    joint, path = cut(joint, "joint-tallies")
    first, second = (groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"t{s}"), F.col("distinct").alias(f"v{s}"), *rest) for s, rest in (("a", ["kept"]), ("b", [])))
    pairs, pairs_path = cut(first.join(second, "lang").filter("a < b"), "source-pairs")
    zero, columns = F.lit(0).cast("long"), ["lang", "a", "b", "na", "nb", "times"]
    parts = [
        joint.select(columns),
        joint.select("lang", "a", "b", "na", zero.alias("nb"), (-F.col("times")).alias("times")),
        joint.select("lang", "a", "b", zero.alias("na"), "nb", (-F.col("times")).alias("times")),
        joint.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), "times"),
        pairs.join(tally.select("lang", F.col("source").alias("a"), F.col("n").alias("na"), "times"), ["lang", "a"]).select("lang", "a", "b", "na", zero.alias("nb"), "times"),
        pairs.join(tally.select("lang", F.col("source").alias("b"), F.col("n").alias("nb"), "times"), ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), "nb", "times"),
        pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (F.col("kept") - F.col("va") - F.col("vb")).alias("times")),
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    combined = combined.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("times").alias("times"))
    known = combined.join(_small(pairs.drop("va", "vb"), BROADCAST_GROUPS), ["lang", "a", "b"])
    known = known.select("lang", "a", "b", "times", share(F.col("na"), F.col("ta"), F.col("kept")).alias("p"), share(F.col("nb"), F.col("tb"), F.col("kept")).alias("q"))
    sums = known.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * distance(F.col("p"), F.col("q"))).alias("ab"), F.sum(F.col("times") * distance(F.col("q"), F.col("p"))).alias("ba"))
    both = F.inline(F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value")) for s, i, v in (("a", "b", "ab"), ("b", "a", "ba")))))
    return sums.select("lang", both)


def ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def best_terms(cells: DataFrame, groups: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """lang, source, item, value and rank of the terms that a source has more of than its language, the best of each source."""
    known = cells.join(_small(groups.select("lang", "source", "total", "kept", "all_total"), BROADCAST_GROUPS), ["lang", "source"])
    known = known.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("all_n"), F.col("all_total"), F.col("kept"))}).filter("p > q")
    values = known.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    inside = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    values = values.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))).withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= top)
    return ranked(values.drop("part", "place")).filter(F.col("rank") <= top)


def divergences(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, held: int = HELD, parts: int = PARTS) -> DataFrame:
    """docs: lang, source and text. lang, source, part (`pair` or `term`), item, value and rank."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    cells, _ = term_counts(docs, least, held)
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("first").cast("long")).alias("own"))
    whole = Window.partitionBy("lang")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", *(none(c).alias(c) for c in ("total", "distinct", "own")))
    groups, _ = cut(groups.withColumns({"kept": F.sum("own").over(whole), "all_total": F.sum("total").over(whole)}).drop("own"), "term-groups")
    pairs = ranked(pair_values(cells, groups)).withColumn("part", F.lit("pair"))
    best = best_terms(cells, groups, top, parts).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}

ORACLE_SQL = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w SEMI JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) y ON x.lang = y.lang AND x.source = y.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM a)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
}
