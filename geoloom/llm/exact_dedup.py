"""Exact deduplication with built-in functions only.

Texts are grouped by the 128-bit MD5 of the normalised text (white space deleted). The
aggregation also keeps the smallest and the largest normalised text of each group, compared
byte by byte: equal bounds prove that the whole group holds one text. A group whose bounds
differ is a hash collision; its rows are grouped again by the text itself.

Cases: a null text counts as empty; empty texts form one group; of repeated rows with one id
each is returned, with the same decision (`kept` compares ids, so rows that repeat the kept id are
all kept); a null id sorts after every other, and a group of nothing but null ids keeps them;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import cut, table

#: The characters deleted before texts are compared.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=md5_key) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    key maps the normalised text to the hash that is grouped by; tests pass weak ones to force collisions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.translate(text, WHITE_SPACE, "").alias("norm"), (-F.char_length(text)).alias("neg_len")
    ).withColumn("h", key(F.col("norm")))
    light = F.min(F.struct(F.col("neg_len"), F.col("id").isNull().alias("no_id"), F.col("id"))).alias("best")
    groups = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("group_size"), light, F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        .select("h", "group_size", F.col("best.id").alias("keep_id"), (F.col("lo") != F.col("hi")).alias("collided"),
                F.sha2(F.col("lo").cast("binary"), 256).alias("text_sha256"))
    )
    # Used twice and made from whole texts: written once.
    groups, _ = cut(groups, "exact")
    # The join has only the hash and the id on the large side; adaptive execution splits a hot hash.
    found = rows.select("id", "h").join(groups, "h").filter(~F.col("collided")).select("id", "keep_id", "group_size", "text_sha256")
    if not groups.filter("collided").isEmpty():
        clash = rows.join(groups.filter("collided").select("h"), "h", "left_semi")
        by_text = clash.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), light)
        found = found.unionByName(
            clash.select("id", "h", "norm").join(by_text, ["h", "norm"]).select(
                "id", F.col("best.id").alias("keep_id"), "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
            )
        )
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
}
