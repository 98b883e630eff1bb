"""Day summaries that merge: stored partial states of each series and day.

A state has what its day contributes to any longer range: counts, sums, extremes, the area
between its points, and its first and last point. Two neighbouring states merge by adding up, with the area
between the last point of one and the first of the next, so aggregates of a range come from the
states of its whole days and from raw points at its two ends alone, and equal those from all raw
points. Days that got late points are made anew one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quality import is_good
from tidemark.points import DAY, SECOND

_AT = ("us", "seq")


def _area(v0: Column, t0: Column, v1: Column, t1: Column) -> tuple[Column, Column]:
    """Area of the trapezoid between two points and its width in seconds; null where a value is."""
    dt = (t1 - t0) / SECOND
    area = (v0 + v1) * 0.5 * dt
    return area, F.when(area.isNotNull(), dt)


def day_states(points: DataFrame, width: int = DAY) -> DataFrame:
    """One row for each series and day (its start in microseconds)."""
    v, day = F.col("value"), F.col("us") - F.pmod(F.col("us"), F.lit(width).cast("long"))
    p = points.withColumn("day", day)
    w = Window.partitionBy("tag_id", "day").orderBy(*_AT)
    area, dt = _area(v, F.col("us"), F.lead("value").over(w), F.lead("us").over(w))
    p = p.withColumn("_area", area).withColumn("_dt", dt)
    at = F.struct(*_AT)
    end = F.struct("us", "value")
    return p.groupBy("tag_id", "day").agg(
        F.count("*").alias("n"), F.count("value").alias("valued"), F.count_if(is_good(F.col("quality"))).alias("good"), F.sum("value").alias("total"), F.sum(v * v).alias("squares"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("_area").alias("area"), F.sum("_dt").alias("seconds"), F.min_by(end, at).alias("first"), F.max_by(end, at).alias("last"))


def merge(states: DataFrame) -> DataFrame:
    """Aggregates of each series over all its states, which must not overlap."""
    w = Window.partitionBy("tag_id").orderBy("day")
    after = F.lead("first").over(w)
    area, dt = _area(F.col("last.value"), F.col("last.us"), after["value"], after["us"])
    g = states.withColumn("_area", area).withColumn("_dt", dt).groupBy("tag_id").agg(
        F.sum("n").alias("n"), F.sum("valued").alias("_m"), F.sum("good").alias("_good"), F.sum("total").alias("_s"), F.sum("squares").alias("_q"), F.min("low").alias("minimum"), F.max("high").alias("maximum"),
        F.sum("area").alias("_a1"), F.sum("_area").alias("_a2"), F.sum("seconds").alias("_d1"), F.sum("_dt").alias("_d2"), F.min_by("first", "day").alias("first"), F.max_by("last", "day").alias("last"))
    zero = F.lit(0.0)
    area, dt = F.coalesce("_a1", zero) + F.coalesce("_a2", zero), F.coalesce("_d1", zero) + F.coalesce("_d2", zero)
    mean = F.try_divide("_s", "_m")
    return g.select(
        "tag_id", "n", "minimum", "maximum", F.col("_s").alias("total"), mean.alias("average"), F.sqrt(F.greatest(zero, F.try_divide("_q", "_m") - mean * mean)).alias("stddev"),
        area.alias("integral"), F.coalesce(F.try_divide(area, dt), F.col("first.value")).alias("time_average"), (100.0 * F.col("_good") / F.col("n")).alias("percent_good"),
        F.col("first.value").alias("first"), F.col("last.value").alias("last"), (F.col("last.us") - F.col("first.us")).alias("span_us"))


def over_range(states: DataFrame, points: DataFrame, start: int, end: int, width: int = DAY) -> DataFrame:
    """Aggregates over [start, end): states of whole days, raw points of the two days that the range cuts."""
    whole_from, whole_to = -(-start // width) * width, end // width * width
    us = F.col("us")
    if whole_from >= whole_to:
        return merge(day_states(points.where((us >= start) & (us < end)), width))
    edges = points.where(((us >= start) & (us < whole_from)) | ((us >= whole_to) & (us < end)))
    return merge(states.where((F.col("day") >= whole_from) & (F.col("day") < whole_to)).unionByName(day_states(edges, width)))


def refresh(states: DataFrame, points: DataFrame, late: DataFrame, width: int = DAY) -> DataFrame:
    """The states after late points came: those of the days that they touch are made anew from all points (late ones included)."""
    day = (F.col("us") - F.pmod(F.col("us"), F.lit(width).cast("long"))).alias("day")
    touched = late.select("tag_id", day).distinct()
    anew = points.withColumn("day", day).join(touched, ["tag_id", "day"], "left_semi").drop("day")
    return states.join(touched, ["tag_id", "day"], "left_anti").unionByName(day_states(anew, width))
