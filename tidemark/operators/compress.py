"""Lossy compression of series: deadbands, swinging door, piecewise lines, and their errors.

Rules that look at the last kept point are state machines that run once over each whole
series in time order, in bounded memory. Rules that look both ways hold a series at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.follow import follow, nothing, whole
from tidemark.points import ordered

def deadband(points: DataFrame, width: float, inclusive: bool = False) -> DataFrame:
    """Points that leave the band around the last kept value."""

    def start():
        last = None

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal last
            d = 0.0 if last is None else abs(v - last)
            if last is None or d > width or (inclusive and d >= width):
                last = v
                return ((us, seq, v),)
            return ()

        return step, nothing

    return follow(points, start)


def percent_deadband(points: DataFrame, percent: float, span: float) -> DataFrame:
    return deadband(points, percent / 100 * span)


def swinging_door(points: DataFrame, deviation: float, max_gap_s: float | None = None) -> DataFrame:
    """Ends of the longest lines that stay within the deviation of all points between them.

    A point is kept when the next one shows that no line from the last kept point goes on.
    """

    def start():
        base, before, kept, low, high = None, None, True, float("-inf"), float("inf")

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal base, before, kept, low, high
            now, out = (us, seq, v), ()
            if base is None:
                base = before = now
                return (now,)
            dt = (us - base[0]) / 1e6
            if dt > 0:
                slope = (v - base[2]) / dt
                if not low <= slope <= high or (max_gap_s is not None and dt > max_gap_s):
                    if not kept:
                        base, out = before, (before,)
                    low, high = float("-inf"), float("inf")
                    dt = (us - base[0]) / 1e6
                if dt > 0:
                    low, high = max(low, (v - deviation - base[2]) / dt), min(high, (v + deviation - base[2]) / dt)
            before, kept = now, False
            return out

        return step, lambda: () if kept else (before,)

    return follow(points, start)


def top_down_mask(t: np.ndarray, v: np.ndarray, tolerance: float, vertical: bool = True) -> np.ndarray:
    """Knots of lines split at the farthest point until all are within the tolerance."""
    n = len(v)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dt = t[b] - t[a]
        line = v[a] + (v[b] - v[a]) * ((t[a + 1 : b] - t[a]) / dt if dt else 0.0)
        d = np.abs(v[a + 1 : b] - line)
        if not vertical:
            d = d * abs(dt) / np.hypot(dt, v[b] - v[a]) if dt or v[b] != v[a] else d
        i = int(np.argmax(d))
        if d[i] > tolerance:
            m = a + 1 + i
            keep[m] = True
            todo += [(a, m), (m, b)]
    return keep


def piecewise_linear(points: DataFrame, tolerance: float) -> DataFrame:
    return whole(points, lambda t, v: top_down_mask(t, v, tolerance))


def line_simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """The same with the distance at right angles to the line."""
    return whole(points, lambda t, v: top_down_mask(t, v, tolerance, vertical=False))


def largest_triangle_mask(t: np.ndarray, v: np.ndarray, buckets: int) -> np.ndarray:
    """One point of each of `buckets` runs of rows: the one with the largest triangle to its neighbours."""
    n = len(v)
    if n <= buckets or buckets < 3:
        return np.ones(n, bool)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    edges = np.linspace(1, n - 1, buckets - 1).astype(int)
    a = 0
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        nlo, nhi = (edges[k + 1], edges[k + 2]) if k + 2 < len(edges) else (n - 1, n)
        ct, cv = t[nlo:nhi].mean(), v[nlo:nhi].mean()
        area = np.abs((t[a] - ct) * (v[lo:hi] - v[a]) - (t[a] - t[lo:hi]) * (cv - v[a]))
        a = lo + int(np.argmax(area))
        keep[a] = True
    return keep


def largest_triangle(points: DataFrame, buckets: int) -> DataFrame:
    return whole(points, lambda t, v: largest_triangle_mask(t, v, buckets))


def deadband_previous(points: DataFrame, width: float) -> DataFrame:
    """Points that differ from the one before by more than the width; the first of each series stays."""
    p = points.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(ordered())))
    return p.where(F.col("_d").isNull() | (F.col("_d") > width)).select("tag_id", "us", "seq", "value")


def runs(points: DataFrame) -> DataFrame:
    """Run lengths of equal neighbouring values."""
    w = ordered()
    change = F.coalesce(~F.col("value").eqNullSafe(F.lag("value").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    p = points.withColumn("_c", change).withColumn("run", F.sum(F.col("_c").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("tag_id", "run").agg(F.first("value").alias("value"), F.min("us").alias("start_us"), F.count("*").alias("length"))


def noise_band(points: DataFrame, factor: float = 3.0) -> DataFrame:
    """A deadband for each series: a multiple of the median absolute deviation of its steps."""
    step = points.withColumn("_d", F.col("value") - F.lag("value").over(ordered())).where("_d is not null")
    med = step.groupBy("tag_id").agg(F.median("_d").alias("_m"))
    return step.join(med, "tag_id").groupBy("tag_id").agg((factor * 1.4826 * F.median(F.abs(F.col("_d") - F.col("_m")))).alias("band"))


def errors(points: DataFrame, kept: DataFrame, method: str = "linear") -> DataFrame:
    """Errors of each series when it is rebuilt from kept points: largest, root mean square, normalised, signal to noise, ratio."""
    from tidemark.operators.interpolate import interpolate

    k = kept.withColumn("quality", F.lit(192))
    q = points.where("value is not null").select("tag_id", F.col("us").alias("q_us"), F.col("value").alias("actual"))
    back = interpolate(k, q.select("tag_id", "q_us").distinct(), method, extrapolate=False)
    j = q.join(back, ["tag_id", "q_us"])
    d = F.col("actual") - F.col("value")
    n = kept.groupBy("tag_id").agg(F.count("*").alias("kept"))
    e = j.groupBy("tag_id").agg(
        F.max(F.abs(d)).alias("max_error"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.max("actual") - F.min("actual")).alias("_range"), F.sum(F.col("actual") * F.col("actual")).alias("_s"), F.sum(d * d).alias("_e"), F.count("*").alias("n"))
    return e.join(n, "tag_id").select(
        "tag_id", "n", "kept", "max_error", "rmse", F.try_divide("rmse", F.nullif("_range", F.lit(0.0))).alias("nrmse"), F.when(F.col("_e") > 0, 10 * F.log10(F.col("_s") / F.col("_e"))).alias("snr_db"),
        (F.col("n") / F.col("kept")).alias("ratio"))


def bottom_up_mask(t: np.ndarray, v: np.ndarray, tolerance: float) -> np.ndarray:
    """Knots left when the cheapest are taken out one by one while all points stay within the tolerance."""
    import heapq

    n = len(v)
    keep = np.ones(n, bool)
    left, right = np.arange(n) - 1, np.arange(n) + 1

    def cost(i: int) -> float:
        a, b = left[i], right[i]
        dt = t[b] - t[a]
        line = v[a] + (v[b] - v[a]) * ((t[a + 1 : b] - t[a]) / dt if dt else 0.0)
        return float(np.abs(v[a + 1 : b] - line).max())

    heap = [(cost(i), i, 0) for i in range(1, n - 1)]
    heapq.heapify(heap)
    version = np.zeros(n, int)
    while heap:
        c, i, k = heapq.heappop(heap)
        if not keep[i] or version[i] != k:
            continue
        if c > tolerance:
            break
        keep[i] = False
        a, b = left[i], right[i]
        right[a], left[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                version[j] += 1
                heapq.heappush(heap, (cost(j), j, version[j]))
    return keep


def bottom_up(points: DataFrame, tolerance: float) -> DataFrame:
    return whole(points, lambda t, v: bottom_up_mask(t, v, tolerance))


def deadband_or_timeout(points: DataFrame, width: float, max_gap_s: float) -> DataFrame:
    """Points that leave the band around the last kept value, or come too long after it."""

    def start():
        last, at = None, 0

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal last, at
            if last is None or abs(v - last) > width or (us - at) / 1e6 >= max_gap_s:
                last, at = v, us
                return ((us, seq, v),)
            return ()

        return step, nothing

    return follow(points, start)


def rate_filter(points: DataFrame, limit: float) -> DataFrame:
    """Points whose slope from the one before is steeper than the limit per second."""
    w = ordered()
    p = points.withColumn("_r", F.abs(F.try_divide(F.col("value") - F.lag("value").over(w), (F.col("us") - F.lag("us").over(w)) / 1e6)))
    return p.where(F.col("_r") > limit).select("tag_id", "us", "seq", "value")


def expand_runs(table: DataFrame) -> DataFrame:
    """The values of run lengths, one row each, with their place in the run."""
    return table.select("tag_id", "run", F.posexplode(F.array_repeat("value", F.col("length").cast("int"))).alias("place", "value"))


def estimated_ratio(points: DataFrame, deviation: float) -> DataFrame:
    """Expected compression of each series by its spread: 5 (sd / deviation)^-0.7 + 1, in 1..10000 (fixed formula)."""
    sd = F.stddev_pop("value")
    ratio = F.when(sd > 0, F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), 5 * F.pow(sd / deviation, F.lit(-0.7)) + 1))).otherwise(1000.0)
    return points.groupBy("tag_id").agg(ratio.alias("ratio"))


def noise_ratio(points: DataFrame) -> DataFrame:
    """Signal to noise in decibels of each series: variance against the mean square of its steps."""
    p = points.withColumn("_d", F.col("value") - F.lag("value").over(ordered()))
    return p.groupBy("tag_id").agg(F.coalesce(10 * F.log10(F.try_divide(F.var_pop("value"), F.nullif(F.avg(F.col("_d") * F.col("_d")), F.lit(0.0)))), F.lit(100.0)).alias("snr_db"))
