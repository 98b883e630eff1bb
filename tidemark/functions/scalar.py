"""Scalar column functions: engineering units, interpolation, time, limits, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01 to 1970-01-01 (fixed value).
EPOCH_1601 = 11_644_473_600


def finite(v: Column) -> Column:
    """v where it is a finite number, else null."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def scale_range(v: Column, in_lo: Column, in_hi: Column, out_lo: Column, out_hi: Column) -> Column:
    """Map by the tops of both ranges; null for an empty input range."""
    return out_lo + (v - in_lo) * F.try_divide(out_hi - out_lo, in_hi - in_lo)


def scale_width(v: Column, in_zero: Column, in_span: Column, out_zero: Column, out_span: Column) -> Column:
    """Map by the widths of both ranges; null for an empty input range."""
    return out_zero + (v - in_zero) * F.try_divide(out_span, in_span)


def to_percent(v: Column, zero: Column, span: Column) -> Column:
    return F.when(span > 0, (v - zero) / span * 100).otherwise(0.0)


def from_percent(p: Column, zero: Column, span: Column) -> Column:
    return zero + p / 100 * span


def clamp(v: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), v))


def in_span(v: Column, a: Column, b: Column) -> Column:
    return v.between(F.least(a, b), F.greatest(a, b))


def lerp(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, clamped: bool = True) -> Column:
    """The line through two points; y0 where both share their x."""
    t = F.try_divide(x - x0, x1 - x0)
    if clamped:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.coalesce(y0 + (y1 - y0) * t, y0)


def convert(kind: str, v: Column, a: float = 0.0, b: float = 1.0, poly: tuple[float, ...] = (), table: tuple[tuple[float, float], ...] = ()) -> Column:
    """linear a + b*v, sqrt a + b*sqrt(v), log a + b*ln(v), polynomial by Horner, or a clamped table."""
    if kind == "linear":
        return F.lit(a) + F.lit(b) * v
    if kind == "sqrt":
        return F.when(v >= 0, F.lit(a) + F.lit(b) * F.sqrt(v))
    if kind == "log":
        return F.when(v > 0, F.lit(a) + F.lit(b) * F.ln(v))
    if kind == "polynomial":
        out = F.lit(0.0)
        for c in reversed(poly):
            out = out * v + F.lit(c)
        return out
    if kind == "table":
        pts = sorted(table)
        out = F.when(v <= pts[0][0], F.lit(pts[0][1]))
        for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
            out = out.when(v <= x1, lerp(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1), v))
        return out.otherwise(F.lit(pts[-1][1]))
    raise ValueError(f"unknown conversion {kind!r}")


def filetime_to_unix(ticks: Column) -> Column:
    """Seconds since 1970 of a count of 100 ns since 1601."""
    return F.floor(ticks / 10_000_000).cast("long") - EPOCH_1601


def unix_to_filetime(seconds: Column) -> Column:
    return (seconds + EPOCH_1601) * 10_000_000


def iso_millis(us: Column) -> Column:
    """UTC ISO 8601 text with milliseconds of microseconds since 1970, whatever the session's zone."""
    ntz = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals meet; false for intervals the wrong way round."""
    return (s1 <= e1) & (s2 <= e2) & (s1 <= e2) & (s2 <= e1)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def nice_step(span: Column, max_ticks: int) -> Column:
    """The smallest of 1, 2, 5, 10 times a power of ten that gives at most max_ticks steps."""
    raw = span / max_ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    f = raw / power
    return power * F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0)


def topic_regex(topic_filter: Column) -> Column:
    """Regular expression of a publish/subscribe filter: + is one level, # all that follow."""
    escaped = F.regexp_replace(topic_filter, r"([.\\^$|?*(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\+", "[^/]*"), "#", ".*"), F.lit("$"))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern with * and ?."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def kpi_status(v: Column, lo: Column, hi: Column, margin: float = 0.1) -> Column:
    """GOOD inside the range, WARNING within a tenth of its width outside, else BAD."""
    m = (hi - lo) * margin
    return F.when(v.between(lo, hi), "GOOD").when(v.between(lo - m, hi + m), "WARNING").otherwise("BAD")
