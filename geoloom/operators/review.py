"""Checks of what a pipeline produced: pictures that show something, reviews that are still valid, settings that took hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least spread of a channel and number of greys of a real picture; least distance of sky and ground; texture tiles across; metres of one.
SPREAD, GREYS, HORIZON, TILES_ACROSS, TILE_M = 10, 50, 30.0, 10, 1000


def readback(pixels: DataFrame) -> DataFrame:
    """Per image of (image, row, col, r, g, b with 0 to 255): the largest spread of a channel, the number of greys, and whether it is no blank."""
    grey = F.floor((F.col("r") + F.col("g") + F.col("b")) / 3.0)
    found = pixels.groupBy("image").agg(F.greatest(*(F.stddev_pop(c) for c in "rgb")).alias("spread"), F.countDistinct(grey).alias("greys"))
    return found.withColumn("is_real", (F.col("spread") > SPREAD) & (F.col("greys") > GREYS))


def horizon(pixels: DataFrame, threshold: float = HORIZON) -> DataFrame:
    """Per image: the distance between the mean colours of its upper and lower half, and whether a horizon shows.
    An image of one row has no upper half: null and false."""
    size = pixels.groupBy("image").agg(F.floor((F.max("row") + 1) / 2).alias("__half"))
    upper = F.col("row") < F.col("__half")
    halves = [F.avg(F.when(upper, F.col(c))) - F.avg(F.when(~upper, F.col(c))) for c in "rgb"]
    found = pixels.join(size, "image").groupBy("image").agg(F.sqrt(sum(d * d for d in halves)).alias("difference"))
    return found.withColumn("visible", F.coalesce(F.col("difference") >= threshold, F.lit(False)))


def review_gate(current: DataFrame, stored: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """What keeps a review from passing. current, stored: (slot, hash), one row a slot; questions: (slot, question,
    severity); answers: (slot, question, answer). A slot is stale where its stored hash is missing or another; a
    blocker fails unless its answer begins with pass; a missing answer reads `missing`."""
    old = stored.select("slot", F.col("hash").alias("__old"))
    stale = current.join(old, "slot", "left").filter(~F.col("hash").eqNullSafe(F.col("__old"))).select("slot", F.lit(None).cast("string").alias("question"), F.lit("stale").alias("reason"))
    asked = questions.filter("severity = 'blocker'").join(current.select("slot"), "slot", "left_semi")
    said = asked.join(answers, ["slot", "question"], "left").withColumn("answer", F.coalesce("answer", F.lit("missing")))
    return stale.unionByName(said.filter(~F.startswith("answer", F.lit("pass"))).select("slot", "question", F.col("answer").alias("reason")))


def settings_report(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Per phase of (phase, setting, value): how many claimed settings there are and how many of them are actually so."""
    both = claimed.withColumnRenamed("value", "claimed").join(actual.withColumnRenamed("value", "actual"), ["phase", "setting"], "left")
    return both.groupBy("phase").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("claimed").eqNullSafe(F.col("actual"))).alias("passed"))


def with_frame_number(samples: DataFrame, fps: float, start: int = 1, key: str = "id") -> DataFrame:
    """samples (key, t) with `frame`: start plus the seconds since the track's first sample times fps."""
    return samples.withColumn("frame", start + (F.col("t") - F.min("t").over(Window.partitionBy(key))) * fps)


def texture_grid(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> tuple[Column, Column]:
    """Texture tiles across (TILES_ACROSS at most) and along a box, one at least."""
    across, along = (F.greatest(F.lit(1), F.ceil((hi - lo) / TILE_M).cast("int")) for lo, hi in ((min_x, max_x), (min_y, max_y)))
    return F.least(across, F.lit(TILES_ACROSS)), along
