"""Frames that go together: full link strengths, what is related to a frame, and the significance of lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.chance import poisson_tail

#: Weights of time, attributes, template and severity in a link's strength, and of equal severity.
WEIGHTS = {"time": 0.35, "attributes": 0.25, "template": 0.25, "severity": 0.15}
EQUAL_SEVERITY = 0.5


def links(frames: DataFrame, window_us: int, least: float = 0.1) -> DataFrame:
    """Links (a, b, strength, parts, causal) between frames of one series that start within the window.

    frames: id, tag_id, start_us, end_us, template, severity, attributes (an array of name=value texts). The
    attribute part is the Jaccard index of the two sets, 0 where both are empty. Frames meet on the
    series and on buckets of time as wide as the window, each frame also in the next bucket.
    """
    bucket = F.floor(F.col("start_us") / window_us)
    cols = ["id", "start_us", "end_us", "template", "severity", "attributes"]
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in cols]
    left = frames.select("tag_id", *side("a"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    right = frames.select("tag_id", *side("b"), bucket.alias("_b"))
    j = left.join(right, ["tag_id", "_b"]).where((F.struct("start_us_a", "id_a") < F.struct("start_us_b", "id_b")) & (F.col("start_us_b") - F.col("start_us_a") <= window_us))
    gap = F.greatest(F.lit(0), F.col("start_us_b") - F.coalesce("end_us_a", "start_us_a"))
    union = F.size(F.array_union("attributes_a", "attributes_b"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("attributes_a", "attributes_b")) / union).otherwise(0.0)
    parts = {
        "time": F.greatest(F.lit(0.0), 1 - gap / window_us), "attributes": jaccard, "template": (F.col("template_a") == F.col("template_b")).cast("double"),
        "severity": F.when(F.col("severity_a") == F.col("severity_b"), EQUAL_SEVERITY).otherwise(0.0)}
    j = j.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *[F.coalesce(c, F.lit(0.0)).alias(f"by_{n}") for n, c in parts.items()])
    strength = sum((w * F.col(f"by_{n}") for n, w in WEIGHTS.items()), F.lit(0.0))
    return j.withColumn("strength", strength).withColumn("causal", F.col("by_time") > 0.7).where(F.col("strength") >= least)


def related(linked: DataFrame, ids: DataFrame, k: int | None = None) -> DataFrame:
    """(id, other, strength, place): for each frame of a table of ids what it is linked with, the strongest first."""
    both = linked.select(F.col("a").alias("id"), F.col("b").alias("other"), "strength").unionByName(linked.select(F.col("b").alias("id"), F.col("a").alias("other"), "strength"))
    w = Window.partitionBy("id").orderBy(F.desc("strength"), "other")
    out = both.join(ids.select("id").distinct(), "id", "left_semi").withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= k) if k else out


def summary(frames: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: frames, links, their mean strength, and causal links."""
    one = linked.agg(F.count("*").alias("links"), F.avg("strength").alias("average_strength"), F.count_if("causal").alias("causal_links"))
    return frames.agg(F.count("*").alias("frames")).join(one)


def lag_significance(frames: DataFrame, cause: str, effect: str, lag_us: int) -> DataFrame:
    """For each series how often effect frames start within the lag after cause frames, against chance.

    pairs counts every cause and effect at 0 to lag_us; expected is causes * effects * lag / span (the span of
    all frames, a second at least; the factor 1 at most), p the Poisson chance of as many pairs or more, and
    causal means more than twice the expected pairs with p < 0.05. The pairs are the difference
    of two running counts of effects, at the end and before the start of each cause's lag, so no pair is made.
    """
    of = F.col("template")
    mark = lambda kind, us, order: F.struct(F.lit(kind).alias("kind"), us.alias("us"), F.lit(order).alias("order"))
    us = F.col("start_us")
    marks = F.array_compact(F.array(
        F.when(of == cause, mark("before", us, 0)), F.when(of == effect, mark("effect", us, 1)), F.when(of == cause, mark("after", us + lag_us, 2))))
    m = frames.select("tag_id", F.explode(marks).alias("m")).select("tag_id", "m.*")
    w = Window.partitionBy("tag_id").orderBy("us", "order").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_n", F.count_if(F.col("kind") == "effect").over(w))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    sum_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_n"))), F.lit(0))
    got = m.groupBy("tag_id").agg(count("before").alias("causes"), count("effect").alias("effects"), (sum_of("after") - sum_of("before")).alias("pairs"))
    span = frames.groupBy("tag_id").agg(F.min("start_us").alias("_lo"), F.max("start_us").alias("_hi"))
    chance = F.least(F.lit(1.0), lag_us / F.greatest(F.lit(1_000_000), F.col("_hi") - F.col("_lo")))
    j = got.where("causes > 0 and effects > 0").join(span, "tag_id").withColumn("expected", F.col("causes") * F.col("effects") * chance)
    j = j.select("tag_id", "causes", "effects", "pairs", "expected", poisson_tail(F.col("pairs"), F.col("expected")).alias("p"))
    return j.withColumn("causal", (F.col("pairs") > 2 * F.col("expected")) & (F.col("p") < 0.05))
