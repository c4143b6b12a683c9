"""Toxicity by compression distance.

Two zstandard dictionaries are made from a bounded sample of labelled texts: the ordinary one holds
the most frequent words of both classes, the toxic one the segments (words and word beginnings) that
follow more distinct words in toxic texts than the ordinary rate explains. Counting distinct
preceding words, not occurrences, keeps copies of one text from looking like a pattern. A window is
one word between two fixed strings that both dictionaries end with (so zstd neither stores it raw nor
stops matching before its end); its distance is its compressed length with the ordinary dictionary
less that with the toxic one. A text's distance is the largest over the windows of the whole text;
thresholds on it are calibrated as the share of toxic texts at each distance, made monotone. The
distances that they are calibrated on come from dictionaries made without the texts measured: the
sample is dealt to FOLDS parts, and each is measured with the dictionaries of the others. Whole texts
of the sample are counted and measured by Spark's tasks: each pair of words has the set of parts it
stands in, which yields the counts of all parts and of all but one at once. Only words and segments
that make a dictionary, and the number of texts at each distance, reach the driver.

Cases: a null or empty text has no windows and gets the lowest distance; a null id counts as the text
`null` in the split and is scored; texts and words of any length are scored whole; repeated rows are
scored alike; without labels every score is 0; labels that occur several times count once each;
other columns are kept out of the way (score and predicted are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import bounded, cut, give_back, remove, table

#: Bounds of the sample that is fitted on: rows of either class, with their whole texts.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
#: Parts of the sample for the calibration.
FOLDS = 4
#: Words in the ordinary dictionary; bytes of the segments tried.
ORDINARY_WORDS, SEGMENT_MIN, SEGMENT_MAX = 8000, 4, 10
#: A toxic segment needs this log-likelihood gain, and this many times the ordinary rate.
GAIN, RATIO = 20.0, 4.0
LEVEL, THRESHOLD = 6, 0.3
#: Distances from 0 to TOP have a calibrated score each.
TOP = 6
MEMO_WORDS, ROWS_OUT = 200_000, 1024
#: Distinct pairs of words that a task holds before it hands them on.
HELD_PAIRS = 200_000

#: What stands around a word in a window, and what is stripped from words.
BEFORE, AFTER, MARKS = b"<0123456789ABCDEFGH>", b"<IJKLMNOPQRSTUVWXYZ>", b".,!?;:|*&%$#()\""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _pairs(batches):
    """Of each class the pairs of a word and the one before it, with the parts of the sample they stand in, as bits."""
    found: dict[tuple[int, bytes, bytes], int] = {}

    def handed():
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.int32()), *(pa.array([k[j] for k in keys], pa.binary()) for j in (1, 2)), pa.array(found.values(), pa.int32())]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["y", "word", "last", "parts"])

    for batch in batches:
        for text, y, fold in zip(batch.column("text"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
            last = b""
            for raw in words_of(text.as_py()):
                word = raw.strip(MARKS)
                if word:
                    found[y, word, last] = found.get((y, word, last), 0) | 1 << fold
                last = word
            if len(found) >= HELD_PAIRS:
                yield handed()
    yield handed()


#: Which parts count: all but one, and all.
VIEWS = [~(1 << k) & ((1 << FOLDS) - 1) for k in range(FOLDS)] + [(1 << FOLDS) - 1]


def _counted(sample: DataFrame) -> DataFrame:
    """y, word and n0, n1, ...: distinct words before it, in each view of the sample."""
    pairs = sample.select("text", "y", "fold").mapInArrow(_pairs, "y int, word binary, last binary, parts int").groupBy("y", "word", "last").agg(F.bit_or("parts").alias("parts"))
    return pairs.groupBy("y", "word").agg(*(F.sum((F.col("parts").bitwiseAND(F.lit(v)) != 0).cast("long")).alias(f"n{k}") for k, v in enumerate(VIEWS)))


def _segments(words: DataFrame) -> DataFrame:
    """segment, and of each view the counts in toxic (t) and in ordinary (o) texts; segments are words and their beginnings."""
    blank, size = F.lit(b" "), F.octet_length("word")
    begins = F.transform(F.sequence(F.lit(SEGMENT_MIN), F.least(size, F.lit(SEGMENT_MAX))), lambda k: F.concat(blank, F.substring(F.col("word"), F.lit(1), k)))
    whole = F.array(F.concat(blank, F.col("word"), blank))
    cut_ = words.filter(size >= SEGMENT_MIN - 1).select("*", F.explode(F.when(size >= SEGMENT_MIN, F.concat(whole, begins)).otherwise(whole)).alias("segment"))
    of = lambda y, name: [F.coalesce(F.sum(F.when(F.col("y") == y, F.col(f"n{k}"))), F.lit(0)).alias(f"{name}{k}") for k in range(len(VIEWS))]
    return cut_.groupBy("segment").agg(*of(1, "t"), *of(0, "o"))


def strongest(gains: dict[bytes, float]) -> list[bytes]:
    """Segments, the strongest first; none is the beginning of another."""
    kept: list[bytes] = []
    for s in sorted(gains, key=lambda s: (-gains[s], s)):
        if not any(k.startswith(s) or s.startswith(k) for k in kept):
            kept.append(s)
    return kept


def dictionaries(words: DataFrame) -> list[tuple[bytes, bytes]]:
    """Of each view the contents of the ordinary and of the toxic dictionary; what matters most stands last. words: as _counted() makes them."""
    views = range(len(VIEWS))
    sums = words.groupBy("y").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in views)).collect()
    total = {r["y"]: [r[f"n{k}"] for k in views] for r in sums}
    scale = [(total.get(1, [0] * len(VIEWS))[k] + 1) / (total.get(0, [0] * len(VIEWS))[k] + 1) for k in views]
    expected = [(F.col(f"o{k}") + 0.5) * scale[k] for k in views]
    n = [F.col(f"t{k}").cast("double") for k in views]
    gain = [F.when((n[k] >= 3) & (n[k] > RATIO * expected[k]), n[k] * F.log(n[k] / expected[k]) - (n[k] - expected[k])) for k in views]
    strong = _segments(words).select("segment", *(F.when(gain[k] >= GAIN, gain[k]).alias(f"g{k}") for k in views)).dropna("all", subset=[f"g{k}" for k in views])
    # Few: each has to stand behind more distinct words than chance explains.
    found = strong.collect()
    both = words.groupBy("word").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in views))
    out = []
    for k in views:
        segments = strongest({bytes(r["segment"]): r[f"g{k}"] for r in found if r[f"g{k}"] is not None})
        starts = tuple(segments)
        common = [bytes(r["word"]) for r in both.filter(F.col(f"n{k}") > 0).orderBy(F.desc(f"n{k}"), "word").limit(ORDINARY_WORDS).select("word").collect()]
        kept = [w for w in reversed(common) if not starts or not (b" " + w + b" ").startswith(starts)]
        out.append((b" " + b" ".join(kept) + b" ", b" ".join(s.strip() for s in [b"", *reversed(segments)]) + b" "))
    return out


class Distance:
    """Compressed lengths of windows under both dictionaries, remembered by word."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [self._compressor(x) for x in (ordinary, toxic)]
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        content = zstandard.ZstdCompressionDict(content + BEFORE + AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        bare = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=bare)

    def of_words(self, words: list[bytes]) -> list[int]:
        a, b = (c.compress for c in self.pair)
        shown = [BEFORE + b" " + w.strip(MARKS) + b" " + AFTER for w in words]
        return [len(a(x)) - len(b(x)) for x in shown]

    def of_text(self, text: str | None) -> int:
        """The largest distance of a window, between 0 and TOP."""
        words, memo = set(words_of(text)), self.memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(words)
        found = dict(zip(new, self.of_words(new)))
        best = max([*(found.values()), *(memo[w] for w in words if w in memo)], default=0)
        memo.update(found if len(found) <= MEMO_WORDS else {})
        return min(TOP, max(0, best))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[bytes, bytes, list[float]]:
    """Both dictionaries and the score of each distance, from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("id"))).distinct()
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_ORDINARY))
    # Rows that share an id count once, with the smallest of their texts.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows, rows_path = cut(bounded(rows).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")), "labelled")
    words, words_path = cut(_counted(rows), "label-words")
    made = dictionaries(words)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(made[:FOLDS])
    counts = np.zeros((2, TOP + 1))
    for r in rows.select("text", "y", "fold").mapInArrow(_measured(shared), "y int, distance int").groupBy("y", "distance").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["y"], r["distance"]] = r["n"]
    for path in (rows_path, words_path):
        remove(spark, path)
    sizes = np.maximum(counts.sum(axis=1), 1)
    counts *= (np.array([totals.get(y, 0) for y in (0, 1)]) / sizes)[:, None]
    shares = counts[1] / np.maximum(counts.sum(axis=0) + 1.0, 1e-9)
    return (*made[FOLDS], np.maximum.accumulate(shares).tolist())


def _measured(shared):
    """Distances of the sample's texts, each with the dictionaries made without its part."""

    def run(batches):
        own: dict[int, Distance] = {}
        for batch in batches:
            made = []
            for text, fold in zip(batch.column("text"), batch.column("fold").to_pylist()):
                if fold not in own:
                    own[fold] = Distance(*shared.value[fold])
                made.append(own[fold].of_text(text.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(made, pa.int32())], ["y", "distance"])
        own.clear()
        give_back()

    return run


def _scored(fitted, text_col: str, keep: list[str]):
    def run(batches):
        ordinary, toxic, scores = fitted.value
        own = Distance(ordinary, toxic)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                made = [scores[own.of_text(x.as_py())] for x in batch.column(text_col)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.float64())], [*keep, "score"])
        own.memo.clear()
        give_back()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with score and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    # Bounded by ORDINARY_WORDS and by the sample.
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    scored = bounded(docs).select(*dict.fromkeys([*keep, text_col])).mapInArrow(_scored(fitted, text_col, keep), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
