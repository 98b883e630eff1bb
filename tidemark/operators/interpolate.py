"""As-of lookups, interpolation and resampling of points at query times.

Queries and points of a series are merged by one union and one sort per series;
windows then carry the neighbouring points to each query. That is one shuffle on
the series, with no range join and nothing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quality import is_good

METHODS = ("step", "linear", "previous", "next", "nearest", "quadratic", "lagrange3", "hermite")


def grid(points: DataFrame, step: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Query times (tag_id, q_us) every `step`, on multiples of it, within each series' span or the given range."""
    span = points.groupBy("tag_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    s = F.lit(step).cast("long")
    lo = F.lit(start).cast("long") if start is not None else F.col("lo") + F.pmod(-F.col("lo"), s)
    hi = F.lit(end).cast("long") if end is not None else F.col("hi")
    times = span.select("tag_id", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return times.select("tag_id", F.explode(F.sequence("lo", "hi", s)).alias("q_us"))


def neighbours(points: DataFrame, queries: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """queries with b1 (the last point at or before), b2, .., a1 (the first after), a2, .. as structs (us, value)."""
    at = F.struct("us", "value")
    p = points.where("value is not null").withColumn("_r", F.row_number().over(Window.partitionBy("tag_id", "us").orderBy(F.desc("seq")))).where("_r = 1")
    w = Window.partitionBy("tag_id").orderBy("us")
    knots = p.select("tag_id", "us", *[(F.lag(at, i - 1).over(w) if i > 1 else at).alias(f"b{i}") for i in range(1, before + 1)], *[F.lead(at, i).over(w).alias(f"f{i}") for i in range(1, after + 1)])
    cols = [*[f"b{i}" for i in range(1, before + 1)], *[f"f{i}" for i in range(1, after + 1)]]
    k = knots.select("tag_id", "us", F.struct(*cols).alias("knot"), F.lit(0).alias("kind"))
    # the knots after a query that has no point before it
    q = queries.select("tag_id", F.col("q_us").alias("us"), F.lit(None).cast(k.schema["knot"].dataType).alias("knot"), F.lit(1).alias("kind"))
    m = Window.partitionBy("tag_id").orderBy("us", "kind")
    last = F.last("knot", ignorenulls=True).over(m.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("knot", ignorenulls=True).over(m.rowsBetween(0, Window.unboundedFollowing))
    j = k.unionByName(q).select("tag_id", F.col("us").alias("q_us"), "kind", last.alias("l"), first.alias("n")).where("kind = 1")
    none = F.col("l").isNull()
    out = [F.col(f"l.b{i}").alias(f"b{i}") for i in range(1, before + 1)]
    for i in range(1, after + 1):
        lead = F.col("n.b1") if i == 1 else F.col(f"n.f{i - 1}")
        out.append(F.when(none, lead).otherwise(F.col(f"l.f{i}")).alias(f"a{i}"))
    return j.select("tag_id", "q_us", *out)


def _t(c: str) -> Column:
    return F.col(f"{c}.us").cast("double")


def _v(c: str) -> Column:
    return F.col(f"{c}.value")


def _line(a: str, b: str, q: Column) -> Column:
    return _v(a) + (_v(b) - _v(a)) * F.try_divide(q - _t(a), _t(b) - _t(a))


def _lagrange(knots: list[tuple[Column, Column]], q: Column) -> Column:
    total = None
    for i, (ti, vi) in enumerate(knots):
        term = vi
        for j, (tj, _) in enumerate(knots):
            if i != j:
                term = term * F.try_divide(q - tj, ti - tj)
        total = term if total is None else total + term
    return total


def interpolate(points: DataFrame, queries: DataFrame, method: str = "linear", extrapolate: bool = True, good_only: bool = False) -> DataFrame:
    """Value of each series at each query time (tag_id, q_us); null where the method gives none.

    linear goes on along the nearest segment outside the points if extrapolate is
    set, else holds the nearest value; step and previous give null before the first
    point, next after the last; nearest takes the earlier point on ties. quadratic
    and lagrange3 use the nearest 3 and 4 points, hermite finite-difference tangents;
    with fewer points they fall back to linear.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if good_only:
        points = points.where(is_good(F.col("quality")))
    n = neighbours(points, queries)
    q = F.col("q_us").cast("double")
    has = lambda c: F.col(c).isNotNull()
    outside = (_line("b2", "b1", q), _line("a1", "a2", q)) if extrapolate else (_v("b1"), _v("a1"))
    linear = F.when(has("b1") & has("a1"), _line("b1", "a1", q)).when(has("b1"), F.when(_t("b1") == q, _v("b1")).otherwise(F.coalesce(outside[0], _v("b1")))).otherwise(F.coalesce(outside[1], _v("a1")))
    if method in ("step", "previous"):
        value = _v("b1")
    elif method == "next":
        value = F.when(has("b1") & (_t("b1") == q), _v("b1")).otherwise(_v("a1"))
    elif method == "nearest":
        value = F.when(~has("a1"), _v("b1")).when(~has("b1"), _v("a1")).when(q - _t("b1") <= _t("a1") - q, _v("b1")).otherwise(_v("a1"))
    elif method == "linear":
        value = linear
    elif method == "lagrange3":
        four = has("b2") & has("b1") & has("a1") & has("a2")
        value = F.when(four, _lagrange([(_t(c), _v(c)) for c in ("b2", "b1", "a1", "a2")], q)).otherwise(linear)
    elif method == "quadratic":
        left = _lagrange([(_t(c), _v(c)) for c in ("b2", "b1", "a1")], q)
        right = _lagrange([(_t(c), _v(c)) for c in ("b1", "a1", "a2")], q)
        use_left = has("b2") & (~has("a2") | (q - _t("b2") <= _t("a2") - q))
        value = F.when(has("b1") & has("a1") & use_left, left).when(has("b1") & has("a1") & has("a2"), right).otherwise(linear)
    else:
        h = _t("a1") - _t("b1")
        s = F.try_divide(q - _t("b1"), h)
        slope = lambda a, b: F.try_divide(_v(b) - _v(a), _t(b) - _t(a))
        m0, m1 = F.coalesce(slope("b2", "a1"), slope("b1", "a1")), F.coalesce(slope("b1", "a2"), slope("b1", "a1"))
        cubic = (2 * s * s * s - 3 * s * s + 1) * _v("b1") + (s * s * s - 2 * s * s + s) * h * m0 + (-2 * s * s * s + 3 * s * s) * _v("a1") + (s * s * s - s * s) * h * m1
        value = F.when(has("b1") & has("a1"), cubic).otherwise(linear)
    return n.select("tag_id", "q_us", value.alias("value"))


def _natural_spline(t: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = len(t)
    if n < 3:
        return np.interp(q, t, v) if n else np.full(len(q), np.nan)
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    # tridiagonal system of the inner second derivatives
    a, b, r = h[1:-1], 2 * (h[:-1] + h[1:]), 6 * np.diff(d)
    m, b, r = np.zeros(n), b.copy(), r.copy()
    for i in range(1, len(b)):
        f = a[i - 1] / b[i - 1]
        b[i] -= f * a[i - 1]
        r[i] -= f * r[i - 1]
    for i in range(len(b) - 1, -1, -1):
        m[i + 1] = (r[i] - (a[i] * m[i + 2] if i < len(b) - 1 else 0)) / b[i]
    k = np.clip(np.searchsorted(t, q, side="right") - 1, 0, n - 2)
    x, y = t[k + 1] - q, q - t[k]
    return (m[k] * x**3 + m[k + 1] * y**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * x + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * y


def _akima(t: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = len(t)
    if n < 3:
        return np.interp(q, t, v) if n else np.full(len(q), np.nan)
    d = np.diff(v) / np.diff(t)
    e = np.concatenate([[3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]])
    w1, w2 = np.abs(e[3:] - e[2:-1]), np.abs(e[1:-2] - e[:-3])
    flat = w1 + w2 == 0
    m = np.where(flat, (e[1:-2] + e[2:-1]) / 2, (w1 * e[1:-2] + w2 * e[2:-1]) / np.where(flat, 1, w1 + w2))
    k = np.clip(np.searchsorted(t, q, side="right") - 1, 0, n - 2)
    h, y = t[k + 1] - t[k], q - t[k]
    c, g = (3 * d[k] - 2 * m[k] - m[k + 1]) / h, (m[k] + m[k + 1] - 2 * d[k]) / h**2
    return v[k] + y * (m[k] + y * (c + y * g))


def smooth(points: DataFrame, queries: DataFrame, method: str = "spline") -> DataFrame:
    """Natural cubic spline or Akima (1970) values at query times; a series is one task's unit."""
    f = {"spline": _natural_spline, "akima": _akima}[method]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["value"]).sort_values(["us", "seq"]).drop_duplicates("us", keep="last")
        origin = int(p["us"].iloc[0]) if len(p) else 0
        t, x = (p["us"].to_numpy() - origin) / 1e6, (q["q_us"].to_numpy() - origin) / 1e6
        return q.assign(value=f(t, p["value"].to_numpy(), x))[["tag_id", "q_us", "value"]]

    return points.groupBy("tag_id").cogroup(queries.groupBy("tag_id")).applyInPandas(run, "tag_id long, q_us long, value double")


def snapshot(points: DataFrame) -> DataFrame:
    """The latest point of each series, by a grouped maximum with partial sums."""
    return points.groupBy("tag_id").agg(F.max_by(F.struct("us", "seq", "value", "quality"), F.struct("us", "seq")).alias("p")).select("tag_id", "p.*")
