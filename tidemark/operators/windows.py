"""Row windows, smoothing, change detection and time windows over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import bucket
from tidemark.operators.follow import follow, nothing
from tidemark.points import SECOND, ordered



def lag_lead(points: DataFrame, n: int) -> DataFrame:
    w = ordered()
    return points.select("tag_id", "us", "seq", F.lag("value", n).over(w).alias("lag_value"), F.lead("value", n).over(w).alias("lead_value"))


def moving_average(points: DataFrame, width: int, mode: str = "trailing") -> DataFrame:
    """Mean over the last `width` rows, or over width // 2 rows on both sides."""
    w = ordered().rowsBetween(-(width - 1), 0) if mode == "trailing" else ordered().rowsBetween(-(width // 2), width // 2)
    return points.select("tag_id", "us", "seq", F.avg("value").over(w).alias("average"))


def cumulative_sum(points: DataFrame) -> DataFrame:
    return points.select("tag_id", "us", "seq", F.sum("value").over(ordered().rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def rate_of_change(points: DataFrame) -> DataFrame:
    """Slope per second: central inside, one-sided at both ends of a series."""
    w = ordered()
    pv, pt, nv, nt = F.lag("value").over(w), F.lag("us").over(w), F.lead("value").over(w), F.lead("us").over(w)
    v0, t0, v1, t1 = F.coalesce(pv, F.col("value")), F.coalesce(pt, F.col("us")), F.coalesce(nv, F.col("value")), F.coalesce(nt, F.col("us"))
    return points.select("tag_id", "us", "seq", F.try_divide(v1 - v0, (t1 - t0) / SECOND).alias("rate"))


def gaps(points: DataFrame, max_gap: int) -> DataFrame:
    """Neighbouring points further apart than max_gap."""
    p = points.select("tag_id", F.lag("us").over(ordered()).alias("gap_start"), F.col("us").alias("gap_end"))
    return p.where(F.col("gap_end") - F.col("gap_start") > max_gap).withColumn("gap", F.col("gap_end") - F.col("gap_start"))


def islands(df: DataFrame, flag: Column, order: Window) -> DataFrame:
    """Rows where flag holds, numbered by run in `island`."""
    f = df.withColumn("_f", flag)
    start = F.col("_f") & ~F.coalesce(F.lag("_f").over(order), F.lit(False))
    return f.withColumn("island", F.sum(start.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_f").drop("_f")


def roc_events(points: DataFrame, threshold: float) -> DataFrame:
    """Runs of points whose slope from the point before is steeper than the threshold."""
    w = ordered()
    roc = F.try_divide(F.col("value") - F.lag("value").over(w), (F.col("us") - F.lag("us").over(w)) / SECOND)
    p = points.withColumn("roc", roc)
    runs = islands(p, F.coalesce(F.abs("roc") > threshold, F.lit(False)), w)
    return runs.groupBy("tag_id", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.max(F.abs("roc")).alias("peak"))


def crossings(points: DataFrame, level: float, direction: str = "up") -> DataFrame:
    before = F.lag("value").over(ordered())
    up, down = (before <= level) & (F.col("value") > level), (before >= level) & (F.col("value") < level)
    p = points.withColumn("_hit", {"up": up, "down": down, "both": up | down}[direction])
    return p.where("_hit").select("tag_id", "us", "seq", "value")


def peaks(points: DataFrame, threshold: float) -> DataFrame:
    """Strict local maxima above the threshold."""
    w = ordered()
    p = points.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w))
    return p.where((F.col("value") > F.col("_a")) & (F.col("value") > F.col("_b")) & (F.col("value") > threshold)).select("tag_id", "us", "seq", "value")


def cusum(points: DataFrame, mean: float, slack: float, limit: float) -> DataFrame:
    """Two-sided cumulative sums and their alarm.

    s = max(0, s + x) equals S - min(0, lowest S so far) for the running sum S, so
    two running windows over one sort replace the recurrence. A sum at the limit is no
    alarm, nor is one that is above it by less than a billionth, which sums of doubles are off by.
    """
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("_up", F.sum(F.col("value") - mean - slack).over(w)).withColumn("_dn", F.sum(mean - F.col("value") - slack).over(w))
    p = p.withColumn("high", F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(w))).withColumn("low", F.col("_dn") - F.least(F.lit(0.0), F.min("_dn").over(w)))
    top = limit + 1e-9 * abs(limit)
    return p.select("tag_id", "us", "seq", "high", "low", ((F.col("high") > top) | (F.col("low") > top)).alias("alarm"))


def ema(points: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average of each series, carried along it in time order."""

    def start():
        now = None

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal now
            now = v if now is None else alpha * v + (1 - alpha) * now
            return ((us, seq, now),)

        return step, nothing

    return follow(points, start, "tag_id long, us long, seq long, ema double")


def ema_last(points: DataFrame, alpha: float) -> DataFrame:
    """The last value of each series' exponential moving average, as a fold without its history."""
    seq = F.array_sort(F.collect_list(F.struct("us", "seq", "value")))
    a = points.where("value is not null").groupBy("tag_id").agg(seq.alias("s"))
    fold = F.aggregate("s", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["value"]).otherwise(alpha * x["value"] + (1 - alpha) * acc))
    return a.select("tag_id", fold.alias("ema"))


def exceptions(points: DataFrame, step: float, rate: float, low: float, high: float) -> DataFrame:
    """The first exception test that a point meets: quality, step, rate, limits."""
    from tidemark.functions.quality import is_bad, major

    w = ordered()
    q = F.col("quality")
    pq, pv, pt = F.lag("quality").over(w), F.lag("value").over(w), F.lag("us").over(w)
    jump = F.abs(F.col("value") - pv)
    kind = (
        F.when(is_bad(q) & ~is_bad(pq), "BAD_QUALITY").when(is_bad(pq) & ~is_bad(q), "RECOVERED").when(major(q) != major(pq), "QUALITY_CHANGE")
        .when(jump >= step, "STEP").when(F.try_divide(jump, (F.col("us") - pt) / SECOND) >= rate, "RATE").when(F.col("value") < low, "LOW").when(F.col("value") > high, "HIGH"))
    return points.withColumn("kind", kind).where("kind is not null").select("tag_id", "us", "seq", "value", "kind")


def threshold_trigger(points: DataFrame, level: float, hysteresis: float) -> DataFrame:
    """Rising crossings that pass the whole hysteresis band from one point to the next."""
    before = F.lag("value").over(ordered())
    p = points.withColumn("_hit", (before <= level - hysteresis) & (F.col("value") >= level + hysteresis))
    return p.where("_hit").select("tag_id", "us", "seq", "value")


def state_held(points: DataFrame, state: Column, hold: int) -> DataFrame:
    """Times when a state has been held for `hold`; once for each run of equal states."""
    w = ordered()
    p = points.withColumn("_s", state)
    change = F.coalesce(F.col("_s") != F.lag("_s").over(w), F.lit(True))
    p = p.withColumn("run", F.sum(change.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = p.withColumn("start_us", F.min("us").over(Window.partitionBy("tag_id", "run")))
    hit = start.where(F.col("us") >= F.col("start_us") + hold)
    return hit.groupBy("tag_id", "run").agg(F.min("us").alias("fired_us"), F.first("start_us").alias("start_us"), F.first("_s").alias("state"))


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    bad = F.when(F.col("quality") < 192, F.struct("us", "seq"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("average"), F.coalesce(F.max_by("quality", bad), F.lit(192)).alias("window_quality"))


def tumbling(points: DataFrame, width: int) -> DataFrame:
    """Windows counted from each series' first point; empty ones are not given."""
    first = F.min("us").over(Window.partitionBy("tag_id"))
    p = points.withColumn("start_us", bucket(F.col("us"), width, first))
    return _summary(p, "tag_id", "start_us").withColumn("end_us", F.col("start_us") + width)


def calendar(points: DataFrame, width: int, offset: int = 0) -> DataFrame:
    """Windows aligned to the epoch plus an offset."""
    p = points.withColumn("start_us", bucket(F.col("us"), width, offset))
    return _summary(p, "tag_id", "start_us").withColumn("end_us", F.col("start_us") + width)


def sliding(points: DataFrame, width: int, slide: int) -> DataFrame:
    """Overlapping windows from each series' first point; a point goes to width / slide of them."""
    first = F.min("us").over(Window.partitionBy("tag_id"))
    p = points.withColumn("_d", F.col("us") - first).withColumn("_o", first)
    hi = F.floor(F.col("_d") / slide).cast("long")
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_d") - width) / slide).cast("long") + 1)
    p = p.withColumn("k", F.explode(F.sequence(lo, hi))).withColumn("start_us", F.col("_o") + F.col("k") * slide)
    return _summary(p, "tag_id", "start_us").withColumn("end_us", F.col("start_us") + width)


def sessions(points: DataFrame, max_gap: int) -> DataFrame:
    """Runs of points no further apart than max_gap, with the times of their first and last point."""
    w = ordered()
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > max_gap, F.lit(True))
    p = points.withColumn("session", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("tag_id", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.avg("value").alias("average"))


def row_blocks(points: DataFrame, size: int) -> DataFrame:
    """Mean and extremes of complete blocks of rows."""
    p = points.withColumn("block", F.floor((F.row_number().over(ordered()) - 1) / size).cast("long"))
    out = p.groupBy("tag_id", "block").agg(F.count("*").alias("n"), F.avg("value").alias("average"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.where(F.col("n") == size).drop("n")


def every_kth(points: DataFrame, k: int) -> DataFrame:
    return points.withColumn("_r", F.row_number().over(ordered())).where((F.col("_r") - 1) % k == 0).select("tag_id", "us", "seq", "value")


def envelope(points: DataFrame, buckets: int) -> DataFrame:
    """Extremes of each series in equal parts of its time span, without the last point."""
    w = Window.partitionBy("tag_id")
    p = points.withColumn("_lo", F.min("us").over(w)).withColumn("_hi", F.max("us").over(w)).where("us < _hi")
    part = F.floor((F.col("us") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo"))).cast("long")
    return p.groupBy("tag_id", part.alias("part")).agg(F.min("value").alias("lower"), F.max("value").alias("upper"))


def alarm_rate(points: DataFrame, limit: float, width: int, allowed: int) -> DataFrame:
    """Alarms (values over the limit) in fixed windows, and whether their number is acceptable."""
    a = points.where(F.col("value") > limit).groupBy(bucket(F.col("us"), width).alias("start_us")).agg(F.count("*").alias("alarms"))
    return a.withColumn("acceptable", F.col("alarms") <= allowed)


def rate_alarms(points: DataFrame, limit: float) -> DataFrame:
    """Points that changed by more than the limit a second since the one before; of equal times any change is one."""
    w = ordered()
    step, dt = F.abs(F.col("value") - F.lag("value").over(w)), (F.col("us") - F.lag("us").over(w)) / SECOND
    rate = F.when(dt > 0, step / dt)
    p = points.withColumn("rate", rate).withColumn("_hit", F.when(dt > 0, rate > limit).otherwise(step > 0))
    return p.where("_hit").select("tag_id", "us", "seq", "value", "rate")
