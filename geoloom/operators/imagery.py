"""Quality measures of pictures given as pixel rows (image, row, col, r, g, b with 0 to 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of luminance; the hues that count as sky; brightness that counts as blown out.
LUMINANCE, SKY, BLOWN_OUT = (0.2126, 0.7152, 0.0722), (190 / 360, 230 / 360), 0.92


def luminance() -> Column:
    return sum(F.col(c) * w for c, w in zip("rgb", LUMINANCE))


def hue() -> Column:
    """0 to 1; 0 for greys."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(top > low, top - low).otherwise(1.0)
    sixth = F.when(top == low, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return F.pmod(sixth / 6.0, F.lit(1.0))


def _lower_half(pixels: DataFrame) -> DataFrame:
    size = pixels.groupBy("image").agg((F.max("row") + 1).alias("__h"))
    return pixels.join(size, "image").withColumn("__lower", F.col("row") >= F.floor(F.col("__h") / 2))


def summary(pixels: DataFrame) -> DataFrame:
    """Per image: share of ground and variance of luminance in the lower half, blue dominance and mean luminance."""
    p = _lower_half(pixels).withColumns({"__lum": luminance(), "__hue": hue()})
    sky = F.col("__hue").between(*SKY) & (F.col("b") > F.col("r")) & (F.col("b") > F.col("g"))
    ground = (~sky & (F.col("__lum") <= BLOWN_OUT)).cast("double")
    return p.groupBy("image").agg(
        F.avg(F.when(F.col("__lower"), ground)).alias("ground_pixel_ratio"), F.var_pop(F.when(F.col("__lower"), F.col("__lum"))).alias("ground_luminance_variance"),
        (F.avg("b") / F.greatest(F.avg("__lum"), F.lit(1e-6))).alias("blue_dominance"), F.avg("__lum").alias("mean_luminance"))


def diversity(pixels: DataFrame) -> DataFrame:
    """Hues in 24 bins among saturated pixels, and the share of green ones."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    strong = F.greatest(r, g, b) - F.least(r, g, b) > 0.05
    green = ((g > r * 1.1) & (g > b * 1.1) & (g > 0.15)).cast("double")
    return pixels.groupBy("image").agg(F.countDistinct(F.when(strong, F.floor(hue() * 24) % 24)).alias("hues"), F.avg(green).alias("green_ratio"))


def verdicts(pixels: DataFrame) -> DataFrame:
    """Per image, over the lower half in steps of 0 to 255: colours in 3 bits, spread, edges, and what they say."""
    p = _lower_half(pixels).filter("__lower").select("image", "row", "col", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb"))
    p = p.withColumn("luma", (F.col("r") + F.col("g") + F.col("b")) / 3.0)
    across, down = Window.partitionBy("image", "row").orderBy("col"), Window.partitionBy("image", "col").orderBy("row")
    edge = F.abs(F.lead("luma").over(across) - F.col("luma")) + F.abs(F.lead("luma").over(down) - F.col("luma"))
    q = [F.floor(F.col(c) / 32) for c in "rgb"]
    found = p.withColumn("edge", edge).groupBy("image").agg(
        F.countDistinct(q[0] * 4096 + q[1] * 64 + q[2]).alias("unique_hues"), ((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3.0).alias("rgb_std"),
        F.avg((F.col("edge") > 12).cast("double")).alias("edge_density"))
    seen = F.when((F.col("rgb_std") < 6) & (F.col("unique_hues") < 25), "EMPTY").when(
        (F.col("unique_hues") >= 60) & (F.col("rgb_std") >= 18) & (F.col("edge_density") >= 0.06), "GROUND_VISIBLE").otherwise("FLAT")
    return found.withColumn("verdict", seen)


def rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root mean square difference per image; pixels that only one side has count as an error of shape (null)."""
    keys = ["image", "row", "col"]
    left, right = (d.select(*keys, *(F.col(c).alias(f"{c}{i}") for c in "rgb")) for i, d in enumerate((a, b)))
    both = left.join(right, keys, "full_outer")
    square = sum((F.col(f"{c}0") - F.col(f"{c}1")) ** 2 for c in "rgb") / 3.0
    return both.groupBy("image").agg(F.when(F.count(square) == F.count(F.lit(1)), F.sqrt(F.avg(square))).alias("rmse"))


def out_of_tolerance(actual: DataFrame, golden: DataFrame, tolerance: float) -> DataFrame:
    """(key, value) pairs that are missing or differ by more than the tolerance, relative to the golden value."""
    joined = golden.withColumnRenamed("value", "golden").join(actual.withColumnRenamed("value", "actual"), "key", "left")
    off = F.abs(F.col("actual") - F.col("golden")) / F.greatest(F.abs("golden"), F.lit(1e-9))
    return joined.filter(F.col("actual").isNull() | (off > tolerance))
