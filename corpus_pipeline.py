"""From raw documents to token ids: five operators in a row, each stage written as Parquet and read again.

Every stage works on all that its predecessor kept; all but the last return the columns of documents.

Cases that hold for every stage: a null or empty text is an empty text, and stays null or empty where
the row stays; texts of any length are handled whole; rows that are alike are decided alike, one by
one, unless a stage says otherwise; an empty table gives an empty one; further columns are carried
along, also those whose names an operator uses for its own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, contamination, line_dedup, near_copies, toxicity
from geoloom.llm.common import cut, table


def _decided(docs: DataFrame, names: list[str], decide) -> DataFrame:
    """decide(docs) with the columns of docs; those of them that have a name of the operator's results are set aside meanwhile."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = decide(docs.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted toxic. A text without words stays unless the labels say that most such texts are toxic; a null id is no obstacle."""
    labels = table(spark, sf_dir, "labels")
    return _decided(docs, ["score", "predicted"], lambda d: toxicity.score_toxicity(d, labels).filter("predicted = 0"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; a document goes only if that leaves nothing but white space. n_chars, where there is one, follows the text.

    A line stays in the document with the smallest id that has it; rows with one id are one document. A null id loses no lines.
    """
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")

    def decide(d):
        rows = line_dedup.drop_lines(d).filter(~F.coalesce(empty, F.lit(False)))
        return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in d.columns else rows

    return _decided(docs, ["n_lines", "n_dropped"], decide)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word Jaccard >= 0.8.

    Texts without words are alike, so one of them stays. Rows without an id stay; rows that share an id stay or go together.
    """
    found = near_copies.similar_components(docs.filter("doc_id is not null"))
    gone, _ = cut(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= near_copies.BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words stands in the benchmark; texts without words stay."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _decided(docs, contamination.ADDED.fieldNames(), lambda d: contamination.find_contamination(d, benchmark).filter(~contamination.contaminated()))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text decoded from them: one row per row, with doc_id, lang and source; no tokens for a null or empty text."""
    coded = bpe.encode_decode(docs, bpe.default_path(), keep=["doc_id", "lang", "source"])
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: The stages train a model, parse templates and fingerprint texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
