"""Sequential rules over whole series: alarms, debounced triggers, seasonal smoothing, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.follow import POINT, follow, nothing
from tidemark.points import ordered


def latched_alarms(points: DataFrame, lolo: float, lo: float, hi: float, hihi: float, deadband: float) -> DataFrame:
    """Alarm state at each point: a limit holds until the value is back by the deadband."""

    def start():
        on = {"HIHI": False, "HI": False, "LOLO": False, "LO": False}

        def step(us: int, seq: int, v: float) -> tuple:
            for k, limit in (("HIHI", hihi), ("HI", hi)):
                on[k] = v >= limit or (on[k] and v > limit - deadband)
            for k, limit in (("LOLO", lolo), ("LO", lo)):
                on[k] = v <= limit or (on[k] and v < limit + deadband)
            return ((us, seq, v, next((k for k, x in on.items() if x), "NONE")),)

        return step, nothing

    return follow(points, start, f"{POINT}, alarm string")


def debounced_trigger(points: DataFrame, level: float, hysteresis: float, samples: int = 3, cooldown_us: int = 5_000_000) -> DataFrame:
    """Times when a value has been above the band for some samples in a row, armed again below it."""

    def start():
        armed, seen, last = True, 0, None

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal armed, seen, last
            seen = seen + 1 if v >= level + hysteresis else 0
            if v <= level - hysteresis:
                armed = True
            if armed and seen >= samples and (last is None or us - last >= cooldown_us):
                armed, last = False, us
                return ((us, seq, v),)
            return ()

        return step, nothing

    return follow(points, start)


def holt_winters(points: DataFrame, alpha: float, beta: float, gamma: float, season: int, ahead: int = 1) -> DataFrame:
    """Multiplicative seasonal smoothing: level, trend and forecast after each point."""

    def start():
        s, level, trend, i = [1.0] * season, 0.0, 0.0, -1

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal level, trend, i
            i += 1
            k = i % season
            if i == 0:
                level = v
            else:
                before = level
                level = alpha * (v / s[k] if s[k] else v) + (1 - alpha) * (level + trend)
                trend = beta * (level - before) + (1 - beta) * trend
                s[k] = gamma * (v / level if level else 1.0) + (1 - gamma) * s[k]
            return ((us, seq, level, trend, (level + ahead * trend) * s[(i + ahead) % season]),)

        return step, nothing

    return follow(points, start, "tag_id long, us long, seq long, level double, trend double, forecast double")


def time_clusters(points: DataFrame, reach_us: int, least: int) -> DataFrame:
    """Density clusters on the time line, by windows alone.

    A point with `least` points (itself included) within reach is a core point; core
    points within reach of each other share a cluster, and border points join
    the nearest core before or after them.
    """
    w = Window.partitionBy("tag_id").orderBy("us")
    p = points.select("tag_id", "us", "seq").withColumn("_n", F.count("*").over(w.rangeBetween(-reach_us, reach_us)))
    core = F.when(F.col("_n") >= least, F.col("us"))
    o = ordered()
    p = p.withColumn("_before", F.last(core, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("_core", core).withColumn("_after", F.first(core, ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing)))
    start = (F.col("_core").isNotNull() & (F.col("_before").isNull() | (F.col("_core") - F.col("_before") > reach_us))).cast("long")
    p = p.withColumn("_id", F.sum(start).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.when(F.col("us") - F.col("_before") <= reach_us, F.col("us") - F.col("_before"))
    ahead = F.when(F.col("_after") - F.col("us") <= reach_us, F.col("_after") - F.col("us"))
    at_start = F.coalesce(F.col("_after") - F.col("_before") > reach_us, F.lit(True))
    cluster = F.when(F.col("_core").isNotNull(), F.col("_id")).when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_id")).when(ahead.isNotNull(), F.col("_id") + at_start.cast("long"))
    return p.select("tag_id", "us", "seq", cluster.alias("cluster"), F.col("_core").isNotNull().alias("core"))
