"""Piecewise lines in one pass: sliding-window segments, SWAB, and the choice of a tolerance by description length.

A segment runs from its anchor as far as every point between lies within the tolerance of
the line to the last one. Whether the next point still fits is two slopes, the cone that the
points since the anchor leave open, and the squared error of a finished line is five running
sums, so a segment of any length is a few numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.compress import bottom_up_mask
from tidemark.operators.follow import follow
from tidemark.points import ordered

_SEGMENT = "tag_id long, start_us long, start_value double, end_us long, end_value double, n long, sse double"


def last_of_equal(points: DataFrame) -> DataFrame:
    """Points with a value; of those of a series with equal time the last."""
    p = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return p.withColumn("_next", F.lead("us").over(ordered())).where(F.col("_next").isNull() | (F.col("_next") != F.col("us"))).drop("_next")


class _Line:
    """The open segment of a series."""

    def __init__(self, tolerance: float, longest: int | None = None):
        self.tolerance, self.longest, self.anchor = tolerance, longest, None

    def begin(self, us: int, v: float) -> None:
        self.anchor = self.last = (us, v)
        self.low, self.high, self.n = -math.inf, math.inf, 1
        self.tt = self.tv = self.vv = 0.0

    def segment(self) -> tuple:
        """The line to the last point: ends, points (both ends included) and squared error."""
        (t0, v0), (t1, v1) = self.anchor, self.last
        slope = (v1 - v0) / ((t1 - t0) / 1e6)
        return t0, v0, t1, v1, self.n, max(0.0, self.vv - 2 * slope * self.tv + slope * slope * self.tt)

    def add(self, us: int, v: float) -> tuple | None:
        """Takes a point; the segment that it closed, if it did."""
        if self.anchor is None:
            self.begin(us, v)
            return None
        t, done = (us - self.anchor[0]) / 1e6, None
        slope = (v - self.anchor[1]) / t
        if self.n > 1 and (not self.low <= slope <= self.high or (self.longest and self.n >= self.longest)):
            done = self.segment()
            self.begin(*self.last)
            t = (us - self.anchor[0]) / 1e6
        d = v - self.anchor[1]
        self.low, self.high = max(self.low, (d - self.tolerance) / t), min(self.high, (d + self.tolerance) / t)
        self.tt, self.tv, self.vv = self.tt + t * t, self.tv + t * d, self.vv + d * d
        self.last, self.n = (us, v), self.n + 1
        return done

    def end(self) -> tuple | None:
        return self.segment() if self.anchor is not None and self.n > 1 else None


def sliding_window(points: DataFrame, tolerance: float, longest: int | None = None) -> DataFrame:
    """Segments of each series, each from where the one before ends; at most `longest` points each, both ends included."""

    def start():
        line = _Line(tolerance, longest)
        return (lambda us, seq, v: ((done,) if (done := line.add(us, v)) else ())), (lambda: ((done,) if (done := line.end()) else ()))

    return follow(last_of_equal(points), start, _SEGMENT)


def segment_points(segments: DataFrame) -> DataFrame:
    """Both ends of each segment as points: what a compressed series stores."""
    ends = F.array(F.struct(F.col("start_us").alias("us"), F.col("start_value").alias("value")), F.struct(F.col("end_us").alias("us"), F.col("end_value").alias("value")))
    return segments.select("tag_id", F.explode(ends).alias("e")).select("tag_id", "e.us", "e.value")


def swab(points: DataFrame, tolerance: float, buffer: int = 50) -> DataFrame:
    """Knots of lines by bottom-up merging inside a buffer of the last points.

    When the buffer is full, its points are merged from the cheapest on while all stay within the
    tolerance, the first line is final, and the buffer goes on from its end. A line longer than
    the buffer is cut there.
    """
    if buffer < 3:
        raise ValueError("a buffer of less than three points has nothing to merge")

    def start():
        held: list[tuple] = []
        first = True

        def merged() -> np.ndarray:
            t0 = held[0][0]
            return np.flatnonzero(bottom_up_mask(np.array([(us - t0) / 1e6 for us, _, _ in held]), np.array([v for _, _, v in held]), tolerance))

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal held, first
            held.append((us, seq, v))
            if len(held) < buffer:
                return ()
            knot = int(merged()[1])
            out = (*held[:1],) if first else ()
            first = False
            out = (*out, held[knot])
            held = held[knot:]
            return out

        def end() -> tuple:
            if not held:
                return ()
            return tuple(held[i] for i in merged()[0 if first else 1 :].tolist())

        return step, end

    return follow(last_of_equal(points), start)


def description_lengths(points: DataFrame, tolerances: list[float], cost: float = 2.0) -> DataFrame:
    """For each series and tolerance its segments, squared error and bits, and whether it has the fewest bits.

    bits = segments * log2(n) * cost + n / 2 * log2(mean squared error), the error being 1e-24 at least.
    All tolerances are followed in one pass over the series; ties go to the wider one.
    """

    def start():
        lines, count, error, n = [_Line(t) for t in tolerances], [0] * len(tolerances), [0.0] * len(tolerances), 0

        def note(i: int, done: tuple | None) -> None:
            if done:
                count[i] += 1
                error[i] += done[-1]

        def step(us: int, seq: int, v: float) -> tuple:
            nonlocal n
            n += 1
            for i, line in enumerate(lines):
                note(i, line.add(us, v))
            return ()

        def end() -> list:
            for i, line in enumerate(lines):
                note(i, line.end())
            return [(t, c, n, e) for t, c, e in zip(tolerances, count, error, strict=True)]

        return step, end

    totals = follow(last_of_equal(points), start, "tag_id long, tolerance double, segments long, n long, sse double").where("segments > 0")
    bits = F.col("segments") * F.log2(F.col("n")) * cost + F.col("n") / 2 * F.log2(F.greatest(F.lit(1e-24), F.col("sse") / F.col("n")))
    first = Window.partitionBy("tag_id").orderBy("bits", F.desc("tolerance"))
    return totals.withColumn("bits", bits).withColumn("best", F.row_number().over(first) == 1)
