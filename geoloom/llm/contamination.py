"""Benchmark contamination by an Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of ASCII letters, digits and any non-ASCII characters, after A-Z are lower-cased. A
window is 13 consecutive words of an item (a shorter item is one window). The automaton holds the
windows as strings with a space on either side; a text, normalised alike, is scanned once. Matches
become intervals of words and, through the words' offsets, spans of the original text.

The windows of a benchmark are broadcast up to SHARD_CHARS. A larger benchmark is cut into pieces of
items that share no window, and the pieces are dealt to shards, each below that bound. The texts pass
one shard's automaton after another, written to the shared folder in between, so a worker never holds
two; intervals and items add up.

Cases: a null text has no words; an item with a null id, or without words, never matches; repeated
items count once; an empty benchmark matches nothing; texts of any length are scanned whole; columns
named n_words, n_hit, spans, words_hit or items are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import LOWER, UPPER, bounded, cut, give_back, table

WINDOW = 13
#: Characters of windows in one automaton (a node takes about 60 bytes), and so in one broadcast.
SHARD_CHARS = 3_000_000
#: Words of a piece of an item, and how often shards are made smaller until all keep the bound.
PIECE, TRIES = 400, 24
#: Rows handled between two output batches.
ROWS_OUT = 512

#: Fixed value: the words of benchmark and documents.
WORDS, SQL_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_pair = lambda a, b: T.ArrayType(T.StructType([T.StructField(a, T.IntegerType()), T.StructField(b, T.IntegerType())]))
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _pair("start", "end")),
    T.StructField("words_hit", _pair("first", "last")), T.StructField("items", T.ArrayType(T.StringType())),
])


def lowered(text: str) -> str:
    """A-Z lower-cased; offsets stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def windows(text: str | None) -> list[str]:
    words = WORDS.findall(lowered(text or ""))
    if not words:
        return []
    return [f" {' '.join(words[i : i + WINDOW])} " for i in range(max(1, len(words) - WINDOW + 1))]


def _pieces(batches):
    """Items in pieces of up to PIECE words that begin 12 words before the last one ends, with the characters of their windows."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            words = WORDS.findall(lowered(text))
            for k, begin in enumerate(range(0, max(1, len(words) - WINDOW + 1), PIECE - WINDOW + 1)):
                part = words[begin : begin + PIECE]
                if part:
                    rows.append((item, k, " ".join(part), WINDOW * sum(len(w) + 1 for w in part)))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item", "piece", "text", "size"])


def automaton(items: list[tuple[str, str]]):
    """Of (item id, text) pairs: each window leads to (its words, the items that have it)."""
    holders: dict[str, dict[str, None]] = {}
    for item, text in items:
        for w in windows(text):
            holders.setdefault(w, {})[item] = None
    found = ahocorasick.Automaton()
    for w, ids in holders.items():
        found.add_word(w, (w.count(" ") - 1, tuple(ids)))
    if holders:
        found.make_automaton()
    return found if holders else None


def merged(intervals) -> list[tuple[int, int]]:
    """Union of intervals of words (both ends included)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(found, text: str, before: list[tuple[int, int]], items: set[str]):
    """(n_words, n_hit, spans, words hit, items) of one text; before and items are those of earlier automata."""
    low = lowered(text)
    words = WORDS.findall(low)
    hits = set()
    if found is not None and words:
        stops = None
        for at, (n, ids) in found.iter(f" {' '.join(words)} "):
            if stops is None:
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = int(np.searchsorted(stops, at))
            hits.add((last - n + 1, last))
            items.update(ids)
    hit = merged([*before, *hits])
    spans = []
    if hit:
        offsets = [m.span() for m in WORDS.finditer(low)]
        spans = [(offsets[a][0], offsets[b][1]) for a, b in hit]
    return len(words), sum(b - a + 1 for a, b in hit), spans, hit, items


def _scanner(shared, text_col: str, keep: list[str], later: bool):
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("words_hit", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        found = automaton(shared.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                texts = batch.column(text_col)
                rows = []
                for i in range(batch.num_rows):
                    before = [(x["first"], x["last"]) for x in batch.column("words_hit")[i].as_py()] if later else []
                    items = set(batch.column("items")[i].as_py()) if later else set()
                    n, hit, spans, words, items = scan(found, texts[i].as_py() or "", before, items)
                    rows.append((n, hit, [dict(start=a, end=b) for a, b in spans], [dict(first=a, last=b) for a, b in words], sorted(items)))
                made = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *schema.names])
        give_back()

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None,
    item_col: str = "item_id", item_text_col: str = "text", shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """The columns `keep` of docs (all by default) with n_words, n_hit, spans (of the original text), words_hit and items."""
    spark = docs.sparkSession
    names = ADDED.fieldNames()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).dropna()
    pieces, _ = cut(items.mapInArrow(_pieces, "item string, piece int, text string, size long"), "pieces")
    shards = max(1, -(-pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // shard_chars))
    own_shard = lambda: F.pmod(F.xxhash64("item", "piece"), F.lit(shards))
    for _ in range(TRIES):
        # A shard of one piece cannot be made smaller.
        full = pieces.groupBy(own_shard().alias("k")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter((F.col("size") > shard_chars) & (F.col("n") > 1))
        if full.isEmpty():
            break
        shards *= 2
    rows = bounded(docs).select(*dict.fromkeys([*keep, text_col]))
    for k in range(shards):
        own = [tuple(r) for r in pieces.filter(own_shard() == k).select("item", "text").collect()]
        last = k + 1 == shards
        out = keep if last else [*dict.fromkeys([*keep, text_col])]
        schema = T.StructType([*(docs.schema[c] for c in out), *ADDED.fields])
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(own), text_col, out, k > 0), schema)
        if not last:
            rows, _ = cut(rows, "scanned")
    return rows


def contaminated():
    """The rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


QUERIES = {"op7_decontamination": op7_decontamination}

ORACLE_SQL = {
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SQL_WORDS}') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{SQL_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, least({WINDOW}, len(w)) AS n, array_to_string(w[p : p + least({WINDOW}, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) AS r(p)),
grams AS (SELECT DISTINCT n, g FROM win), sizes AS (SELECT DISTINCT n FROM grams),
seen AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(p)),
hits AS (SELECT doc_id, p, n, g FROM seen SEMI JOIN grams USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(n)) AS r(k) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits JOIN win USING (n, g)) AS h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
}
