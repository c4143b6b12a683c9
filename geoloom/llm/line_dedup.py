"""Line deduplication with a log-template tree.

A line is cut into tokens; tokens with digits become `<*>`. The tree's first level is the number of
tokens, the next ones are the leading tokens. In a leaf, lines that agree in at least SIMILAR of
their positions with a template join it, and the positions that differ become variable. A template
found in several documents is dropped everywhere but in the document with the smallest id, so that a
passage survives once and copies of a document lose what the first copy keeps.

A leaf is the token count and the LEAD leading tokens at every size, so that lines that meet in a
small table meet in a large one. A line that agrees with a template in SIMILAR of its n positions
agrees in all of one of floor((1 - SIMILAR) * n) + 1 bands of the positions behind the leading ones;
templates are looked up by those bands, which loses no match and spares the comparison of all pairs.

Lines are first counted by 128-bit digests and the digest of their leaf, so that texts of lines are
shuffled only of leaves in which several lines of several documents meet, and of those only the
lines that share a band with another one go to their leaf's task, which streams them and holds the
templates. There whole tokens are compared, the leading ones too; digests of tokens decide nothing.
Lines of any length take part; under LONG tokens SIMILAR asks for all positions, so such a line is a
template of its own. A line of variable tokens alone has nothing that a template could share and is
not masked.

Cases: a null text stays null; empty lines stay; a null id never loses lines; a repeated row counts
once (rows with one id are one document); lines repeated inside one document only are left alone;
lines of any length count; an empty table gives an empty result; columns named n_lines or n_dropped
are replaced.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import bounded, cut, give_back, remove, table

LONG = 5
SIMILAR, LEAD = 0.8, 3
#: Dropped lines are broadcast up to this count (24 bytes each, as arrays); beyond it they are joined to the documents' lines.
BROADCAST_LINES = 1_000_000
#: Leaves whose lines are compared are broadcast up to this count (8 bytes each); beyond it they are joined to the lines.
BROADCAST_LEAVES = 1_000_000
ROWS_OUT = 1024

#: Fixed value: what a variable token becomes.
VARIABLE, DIGITS, OTHER_SPACE = b"<*>", b"0123456789", b"\t\x0b\x0c\r"
_variable = re.compile(rb"[^\x20\x09-\x0d]*[0-9][^\x20\x09-\x0d]*")


def _masked(line: bytes) -> bytes:
    found = _variable.sub(VARIABLE, line)
    return found if found.replace(VARIABLE, b"").strip() else line


def masked_lines(text: bytes) -> list[bytes]:
    """The text's lines with variable tokens masked and a single space between tokens."""
    lines = text.split(b"\n")
    if len(text.translate(None, DIGITS)) != len(text):
        lines = [_masked(x) if len(x.translate(None, DIGITS)) != len(x) else x for x in lines]
    if len(text.translate(None, OTHER_SPACE)) != len(text):
        return [b" ".join(x.split()) for x in lines]
    return [b" ".join(x.split()) if b"  " in x else x.strip(b" ") for x in lines]


def line_keys(lines: list[bytes]) -> list[tuple[int, int]]:
    """128-bit keys, as two signed halves."""
    data = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").reshape(-1, 2)
    return list(zip(data[:, 0].tolist(), data[:, 1].tolist()))


def leaf_key(line: bytes, n: int) -> int | None:
    """Of the token count and the leading tokens; none for a line that is a template of its own."""
    if n < LONG:
        return None
    key = xxhash.xxh3_64_intdigest(b"%d " % n + b" ".join(line.split(b" ", LEAD)[:LEAD]))
    return key - (1 << 64) if key >> 63 else key


def _lines(busy=None, texts: bool = False):
    """Rows of the distinct masked lines of each document; with texts, only those in a leaf, their line and its bands' keys instead of the document's id."""

    def run(batches):
        wanted = None if busy is None else busy.value
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                ids, keys, sizes, leaves, found = [], [], [], [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                    lines = dict.fromkeys(masked_lines((text.as_py() or "").encode("utf-8")))
                    lines.pop(b"", None)
                    counts = [x.count(b" ") + 1 for x in lines]
                    own = [leaf_key(x, n) for x, n in zip(lines, counts)]
                    lines = list(lines)
                    if texts:
                        use = [k for k, leaf in enumerate(own) if leaf is not None]
                        if wanted is not None and use:
                            at = np.array([own[k] for k in use])
                            place = np.minimum(np.searchsorted(wanted, at), max(0, len(wanted) - 1))
                            use = [k for k, ok in zip(use, wanted[place] == at) if ok] if len(wanted) else []
                        lines, counts, own = ([x[k] for k in use] for x in (lines, counts, own))
                        found += lines
                    ids += [i] * len(lines)
                    keys += line_keys(lines)
                    sizes += counts
                    leaves += own
                high, low = zip(*keys) if keys else ((), ())
                columns = [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sizes, pa.int32()), pa.array(leaves, pa.int64())]
                columns.append(pa.array(found, pa.binary()) if texts else pa.array(ids, batch.column("id").type))
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "n", "leaf", "line" if texts else "id"])
        give_back()

    return run


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each distinct masked line: its key (high, low), n (tokens), leaf, first and last document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _read(docs, id_col, text_col).mapInArrow(_lines(), f"high long, low long, n int, leaf long, id {kind}")
    return rows.groupBy("high", "low", "n", "leaf").agg(F.min("id").alias("first"), F.max("id").alias("last"))


def bands(n: int) -> list[slice]:
    """Of lines of n tokens with the same leading ones: parts of the positions, of which similar lines share one."""
    wrong = n - math.ceil(SIMILAR * n - 1e-9)
    cuts = [LEAD + (n - LEAD) * k // (wrong + 1) for k in range(wrong + 2)] if n > LEAD else [0, n]
    return [slice(a, b) for a, b in pairwise(cuts)]


class Leaf:
    """Templates of one leaf: lines of one length with the same leading tokens, in the order in which they come."""

    def __init__(self):
        self.tokens: np.ndarray | None = None
        self.fixed: np.ndarray | None = None
        self.keys: list = []
        self.bands: list[slice] | None = None
        self.filed: dict[tuple[int, bytes], list[int]] = {}

    def place(self, key, line: np.ndarray):
        """Key of the template that the line belongs to."""
        used = len(self.keys)
        if self.bands is None:
            self.bands = bands(len(line))
        marks = [(k, line[part].tobytes()) for k, part in enumerate(self.bands)]
        near = sorted(set().union(*(self.filed.get(m, ()) for m in marks)))
        if near:
            same = self.tokens[near] == line
            score = (same & self.fixed[near]).sum(axis=1) / len(line)
            best = int(score.argmax())
            if score[best] >= SIMILAR:
                self.fixed[near[best]] &= same[best]
                return self.keys[near[best]]
        if self.tokens is None or used == len(self.tokens):
            room = max(2, 2 * used)
            tokens, fixed = np.zeros((room, len(line)), line.dtype), np.ones((room, len(line)), bool)
            if used:
                tokens[:used], fixed[:used] = self.tokens, self.fixed
            self.tokens, self.fixed = tokens, fixed
        self.tokens[used] = line
        self.keys.append(key)
        for m in marks:
            self.filed.setdefault(m, []).append(used)
        return key


def _band_keys(batches):
    """Of each line, the keys of its bands."""
    for batch in batches:
        made = []
        for line, n in zip(batch.column("line").to_pylist(), batch.column("n").to_pylist()):
            tokens = line.split(b" ")
            made.append([xxhash.xxh3_64_intdigest(b"%d " % k + b" ".join(tokens[part])) >> 1 for k, part in enumerate(bands(n))])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("high", "low", "leaf")), pa.array(made, pa.list_(pa.int64()))], ["high", "low", "leaf", "bands"])


def _templates(batches):
    """Adds the template's key. A leaf's lines come one after the other; tokens are compared as numbers that stand for them in that leaf."""
    leaf, known, numbers = None, {}, {}
    for batch in batches:
        made = []
        for high, low, n, at, line in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "n", "leaf", "line"))):
            if at != leaf:
                leaf, known, numbers = at, {}, {}
            tokens = line.split(b" ")
            own = (n, *tokens[:LEAD])
            if own not in known:
                known[own] = Leaf()
            made.append(known[own].place((high, low), np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.int32)))
        high, low = zip(*made) if made else ((), ())
        columns = [*(batch.column(c) for c in ("high", "low", "first", "last", "leaf")), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["high", "low", "first", "last", "leaf", "template_high", "template_low"])
    known = numbers = None
    give_back()


def met_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, broadcast_leaves: int = BROADCAST_LEAVES) -> tuple[DataFrame, list[str]]:
    """high, low, n, leaf and text (line) of the lines that share a band with another line of their leaf, and paths of tables that can be removed afterwards."""
    spark = docs.sparkSession
    busy = lines.filter("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.min("first").alias("a"), F.max("last").alias("b"))
    busy, busy_path = cut(busy.filter("lines > 1 and a < b").select("leaf"), "leaves")
    kept = "high long, low long, n int, leaf long, line binary"
    if busy.count() <= broadcast_leaves:
        shared = spark.sparkContext.broadcast(np.sort(np.array(busy.toArrow()["leaf"].to_numpy(), np.int64)))
        rows = _read(docs, id_col, text_col).mapInArrow(_lines(shared, texts=True), kept)
    else:
        rows = _read(docs, id_col, text_col).mapInArrow(_lines(texts=True), kept).join(busy, "leaf", "left_semi").select("high", "low", "n", "leaf", "line")
    texts, texts_path = cut(rows.distinct(), "leaf-lines")
    marked = texts.mapInArrow(_band_keys, "high long, low long, leaf long, bands array<long>").select("high", "low", "leaf", F.explode("bands").alias("band"))
    meet = marked.groupBy("leaf", "band").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("leaf", "band")
    met = marked.join(meet, ["leaf", "band"], "left_semi").select("leaf", "high", "low").distinct()
    return texts.join(met, ["leaf", "high", "low"], "left_semi").select("high", "low", "n", "leaf", "line"), [busy_path, texts_path]


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """high, low and home of each masked line whose template several documents have; home is the smallest of them."""
    kind = docs.schema[id_col].dataType.simpleString()
    lines, lines_path = cut(distinct_lines(docs, id_col, text_col), "lines")
    met, spent = met_lines(docs, lines, id_col, text_col, broadcast_leaves)
    known = met.join(lines.select("high", "low", "leaf", "first", "last"), ["high", "low", "leaf"])
    ordered = known.repartition("leaf").sortWithinPartitions("leaf", "first", "high", "low")
    placed, placed_path = cut(ordered.mapInArrow(_templates, f"high long, low long, first {kind}, last {kind}, leaf long, template_high long, template_low long"), "templates")
    template = ["leaf", "template_high", "template_low"]
    spread = placed.groupBy(*template).agg(F.min("first").alias("home"), F.max("last").alias("end")).filter("home < end")
    by_template = placed.join(spread, template).select("high", "low", "home")
    alone = lines.filter("first < last").join(placed.select("high", "low"), ["high", "low"], "left_anti").select("high", "low", F.col("first").alias("home"))
    found, _ = cut(by_template.unionByName(alone), "recurring")
    for path in (lines_path, placed_path, *spent):
        remove(docs.sparkSession, path)
    return found


class Homes:
    """Recurring lines by key, as sorted arrays: the home of each, or what is given instead."""

    def __init__(self, high: np.ndarray, low: np.ndarray, homes: pa.Array):
        order = np.lexsort((low, high))
        self.high, self.low, self.homes = high[order], low[order], homes.take(pa.array(order))

    def of(self, keys: list[tuple[int, int]], default) -> list:
        high = np.array([k for k, _ in keys], np.int64)
        begin, end = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        return [next((self.homes[j].as_py() for j in range(a, b) if self.low[j] == k[1]), default) for k, a, b in zip(keys, begin.tolist(), end.tolist())]


def _dropper(shared, text_col: str, id_col: str, keep: list[str]):
    def run(batches):
        homes = None if shared is None else shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                texts, counts, gone = [], [], []
                for i, (own, text) in enumerate(zip(batch.column(id_col).to_pylist(), batch.column(text_col))):
                    text = text.as_py()
                    data = (text or "").encode("utf-8")
                    masked = masked_lines(data)
                    keys = line_keys(masked)
                    if homes is None:
                        drop = {(x["high"], x["low"]) for x in batch.column("__drop")[i].as_py() or ()}
                        gone_ = [k in drop for k in keys]
                    else:
                        gone_ = [x != own for x in homes.of(keys, own)]
                    off = [] if own is None else [j for j, x in enumerate(gone_) if x and masked[j]]
                    if off:
                        off_ = set(off)
                        text = b"\n".join(x for j, x in enumerate(data.split(b"\n")) if j not in off_).decode("utf-8")
                    texts.append(text)
                    counts.append(0 if text is None else len(keys))
                    gone.append(len(off))
                columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*keep, "n_lines", "n_dropped"])
        give_back()

    return run


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """docs without the lines whose templates recur across documents; n_lines and n_dropped are added."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "__drop")]
    docs = bounded(docs).select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    found = recurring_lines(docs, id_col, text_col, broadcast_leaves)
    if found.count() <= broadcast_lines:
        got = found.toArrow().combine_chunks()
        homes = Homes(got["high"].to_numpy(), got["low"].to_numpy(), got["home"].combine_chunks())
        return docs.mapInArrow(_dropper(spark.sparkContext.broadcast(homes), text_col, id_col, keep), schema)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _read(docs, id_col, text_col).mapInArrow(_lines(), f"high long, low long, n int, leaf long, id {kind}")
    hits = rows.join(found, ["high", "low"]).filter("id <> home").groupBy(F.col("id").alias(id_col)).agg(F.collect_set(F.struct("high", "low")).alias("__drop"))
    return docs.join(hits, id_col, "left").select(*(F.col(f"`{c}`") for c in keep), "__drop").mapInArrow(_dropper(None, text_col, id_col, keep), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE_SQL: dict[str, str] = {}
