"""Event frames: overlap search, statistics, correlation, retention, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames that meet [start, end]; open ones reach to its end."""
    return frames.where((F.col("start_us") <= end) & (F.coalesce("end_us", F.lit(end)) >= start))


def statistics(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Totals by severity of the frames that start in [start, end)."""
    f = frames.where((F.col("start_us") >= start) & (F.col("start_us") < end))
    d = F.when(F.col("end_us") > F.col("start_us"), (F.col("end_us") - F.col("start_us")) / 1e6)
    return f.groupBy("severity").agg(F.count("*").alias("n"), F.avg(d).alias("avg_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.countDistinct("template").alias("templates"))


def correlation_links(frames: DataFrame, window_us: int, least: float = 0.1) -> DataFrame:
    """Pairs of frames of one series that start within the window, with their strength.

    The pairs come from an equality on the series and on time buckets of the window's
    width (each frame also looks one bucket ahead), so nothing is compared across
    buckets.
    """
    b = F.floor(F.col("start_us") / window_us)
    left = frames.select(F.col("id").alias("a"), "tag_id", F.col("start_us").alias("s1"), F.col("end_us").alias("e1"), F.col("template").alias("t1"), F.col("severity").alias("v1"), F.explode(F.array(b, b + 1)).alias("b"))
    right = frames.select(F.col("id").alias("o"), "tag_id", F.col("start_us").alias("s2"), F.col("end_us").alias("e2"), F.col("template").alias("t2"), F.col("severity").alias("v2"), b.alias("b"))
    j = left.join(right, ["tag_id", "b"]).where((F.struct("s1", "a") < F.struct("s2", "o")) & (F.col("s2") - F.col("s1") <= window_us))
    gap = F.greatest(F.lit(0), F.col("s2") - F.coalesce("e1", "s1"))
    temporal = F.greatest(F.lit(0.0), 1 - gap / window_us)
    strength = 0.35 * temporal + 0.25 * (F.col("t1") == F.col("t2")).cast("int") + 0.15 * F.when(F.col("v1") == F.col("v2"), 0.5).otherwise(0.0)
    return j.select("a", F.col("o").alias("b"), strength.alias("strength"), (temporal > 0.7).alias("causal")).where(F.col("strength") >= least)


def lagged_pairs(frames: DataFrame, cause: str, effect: str, lag_us: int) -> DataFrame:
    """For each series how often an effect frame starts within the lag after a cause frame."""
    bucket = F.floor(F.col("start_us") / lag_us)
    a = frames.where(F.col("template") == cause).select("tag_id", F.col("start_us").alias("s1"), F.explode(F.array(bucket, bucket + 1)).alias("b"))
    e = frames.where(F.col("template") == effect).select("tag_id", F.col("start_us").alias("s2"), bucket.alias("b"))
    return a.join(e, ["tag_id", "b"]).where((F.col("s2") >= F.col("s1")) & (F.col("s2") - F.col("s1") <= lag_us)).groupBy("tag_id").agg(F.count("*").alias("pairs"))


def retain_by_age(frames: DataFrame, newest: int, max_age_us: int) -> DataFrame:
    return frames.where(F.col("start_us") >= newest - max_age_us)


def retain_by_count(frames: DataFrame, keep: int, key: str = "tag_id") -> DataFrame:
    """The newest `keep` frames of each series."""
    w = Window.partitionBy(key).orderBy(F.desc("start_us"), F.desc("id"))
    return frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def match_rules(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """Deliveries (frame, rule, recipient); rules are a small table with recipients as an array.

    Rules with a template meet frames by equality on it. Those without one are first
    spread over the severities that occur, a few rows, and then meet frames by equality too.
    """
    r = rules.where("enabled")
    levels = r.where("rule_template is null").join(frames.select("severity").distinct(), F.col("severity") >= F.col("min_severity"))
    exact = frames.join(r.withColumnRenamed("rule_template", "template"), "template").where(F.col("severity") >= F.col("min_severity"))
    any_ = frames.join(levels, "severity")
    cols = [F.col("id"), F.col("rule_id"), F.explode("recipients").alias("recipient")]
    return exact.select(*cols).unionAll(any_.select(*cols))


def from_condition(points: DataFrame, condition: Column, min_us: int = 0) -> DataFrame:
    """Frames of the runs of points for which a condition holds; they end at the next point."""
    from tidemark.operators.windows import islands
    from tidemark.points import ordered

    p = points.withColumn("_next", F.lead("us").over(ordered()))
    runs = islands(p, F.coalesce(condition, F.lit(False)), ordered())
    f = runs.groupBy("tag_id", "island").agg(F.min("us").alias("start_us"), F.max(F.coalesce("_next", "us")).alias("end_us"), F.count("*").alias("n"), F.max("value").alias("peak"))
    return f.where(F.col("end_us") - F.col("start_us") >= min_us)
