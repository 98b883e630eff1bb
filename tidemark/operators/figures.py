"""Figures of series and record sets: reconstruction error, thresholds, block transforms, regions, tombstones."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rational approximation 7.1.26 of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def reconstruction(points: DataFrame, back: Column) -> DataFrame:
    """Per series: mean square error, peak signal to noise in dB (200 without error), largest error."""
    d = F.col("value") - back
    s = points.where(F.col("value").isNotNull() & back.isNotNull()).groupBy("tag_id").agg(F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("largest"), (F.max("value") - F.min("value")).alias("range"))
    return s.select("tag_id", "mse", "largest", F.when(F.col("mse") == 0, 200.0).when(F.col("range") > 0, 10 * F.log10(F.col("range") * F.col("range") / F.col("mse"))).alias("psnr"))


def universal_threshold(points: DataFrame) -> DataFrame:
    """Per series: median(|x|) / 0.6745 * sqrt(2 ln n)."""
    s = points.where("value is not null").groupBy("tag_id").agg(F.percentile(F.abs("value"), 0.5).alias("m"), F.count("*").alias("n"))
    return s.select("tag_id", (F.col("m") / 0.6745 * F.sqrt(2 * F.ln(F.col("n")))).alias("threshold"))


def deadband_estimate(z: Column) -> Column:
    """Expected compression 1 / (2 - 2 Phi(z)) of a threshold of z deviations, for Gaussian steps; null where that is infinite."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    tail = reduce(lambda out, a: (out + F.lit(a)) * t, reversed(ERF_A), F.lit(0.0)) * F.exp(-x * x)
    return F.try_divide(F.lit(1.0), F.when(z >= 0, tail).otherwise(2 - tail))


def blocks(points: DataFrame, n: int) -> DataFrame:
    """Whole blocks of n values of each series: tag_id, block, i, value."""
    at = F.row_number().over(Window.partitionBy("tag_id").orderBy("us", "seq")) - 1
    p = points.where("value is not null").withColumn("at", at).withColumn("block", F.floor(F.col("at") / n).cast("long"))
    full = p.groupBy("tag_id", "block").count().where(F.col("count") == n).drop("count")
    return p.join(full, ["tag_id", "block"], "left_semi").select("tag_id", "block", (F.col("at") % n).cast("int").alias("i"), "value")


def dft(blocked: DataFrame, n: int) -> DataFrame:
    """Real and imaginary parts (re, im) of frequency k of each block: n rows a value, summed before the shuffle."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    turn = -2 * math.pi / n * ((F.col("i") * F.col("k")) % n)
    return blocked.withColumn("k", k).groupBy("tag_id", "block", "k").agg(F.sum(F.col("value") * F.cos(turn)).alias("re"), F.sum(F.col("value") * F.sin(turn)).alias("im"))


def inverse_dft(spectrum: DataFrame, n: int) -> DataFrame:
    """The values of each block from its spectrum."""
    turn = 2 * math.pi / n * ((F.col("i") * F.col("k")) % n)
    part = (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)) / n
    return spectrum.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("tag_id", "block", "i").agg(F.sum(part).alias("value"))


def bounding_boxes(rects: DataFrame, key: str) -> DataFrame:
    """The box around the rectangles (x, y, w, h) of each key; those without width or height don't count."""
    s = rects.where("w > 0 and h > 0").groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return s.select(key, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def compact(records: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Records without those that a tombstone of the same key, at their time or later, deletes."""
    dead = tombstones.groupBy(key).agg(F.max("us").alias("_dead"))
    return records.join(dead, key, "left").where("_dead is null or us > _dead").drop("_dead")


def template_errors(attributes: DataFrame) -> DataFrame:
    """Per template: attributes without a name, and required ones with neither default nor reference."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return attributes.groupBy("template").agg(F.count_if(blank("name")).alias("unnamed"), F.count_if(F.col("required") & blank("default_value") & blank("reference")).alias("unset"))


#: Bytes of a stored point, of a value and of a run.
POINT_BYTES, VALUE_BYTES, RUN_BYTES = 24, 8, 16


def size_figures(points: DataFrame, kept: DataFrame, runs: DataFrame) -> DataFrame:
    """For each series how much smaller it is as kept points and as runs: ratios, per cent saved, and bytes saved."""
    n = points.groupBy("tag_id").agg(F.count("*").alias("n"))
    j = n.join(kept.groupBy("tag_id").agg(F.count("*").alias("kept")), "tag_id").join(runs.groupBy("tag_id").agg(F.count("*").alias("runs")), "tag_id")
    n, k = F.col("n"), F.col("kept")
    return j.select(
        "tag_id", "n", "kept", "runs", (n / k).alias("ratio"), ((1 - k / n) * 100).alias("percent_saved"), ((n - k) * POINT_BYTES).alias("bytes_saved"), (n * VALUE_BYTES / (F.col("runs") * RUN_BYTES)).alias("run_ratio"))
