"""Column functions of displays: gauges, pixels, colours, rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gauge_angle(v: Column, zero: Column, span: Column, start: float, sweep: float) -> Column:
    """Angle of a value on a gauge that runs `sweep` degrees from `start`, held at its ends."""
    t = F.coalesce(F.try_divide(v - zero, span - zero), F.lit(0.0))
    return start + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * sweep


def gauge_value(angle: Column, zero: Column, span: Column, start: float, sweep: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (angle - start) / sweep))
    return zero + t * (span - zero)


def pixel_y(v: Column, low: Column, high: Column, top: int, height: int) -> Column:
    """Row of a value in a plot whose highest value is at its top."""
    t = F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.round(top + (1 - t) * height, 0).cast("int")


def pixel_x(us: Column, start: Column, end: Column, left: int, width: int) -> Column:
    t = F.coalesce(F.try_divide(us - start, end - start), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.round(left + t * width, 0).cast("int")


def auto_scale(low: Column, high: Column) -> tuple[Column, Column]:
    """Limits a tenth of the range outside the values; a tenth of the value, or 10, where all are equal."""
    pad = F.when(high > low, (high - low) * 0.1).when(low != 0, F.abs(low) * 0.1).otherwise(10.0)
    return low - pad, high + pad


def limit_color(v: Column, warn_low: float, warn_high: float, alarm_low: float, alarm_high: float) -> Column:
    return F.when((v <= alarm_low) | (v >= alarm_high), "alarm").when((v <= warn_low) | (v >= warn_high), "warn").otherwise("normal")


def rects_overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def rect_contains(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    return px.between(x, x + w) & py.between(y, y + h)


def blend(fg: Column, bg: Column, alpha: Column) -> Column:
    """One channel of a colour over another, alpha in 0..255."""
    return F.floor((fg * alpha + bg * (255 - alpha)) / 255).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit channels (fixed weights)."""
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Channels 0..255 of hue (degrees), saturation and value (0..1)."""
    def channel(n: int) -> Column:
        k = F.pmod(n + h / 60, F.lit(6.0))
        return F.round((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255, 0).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def resolution(range_us: Column, pixels: int) -> Column:
    """The coarsest standard bucket that still gives a point for each pixel."""
    per = range_us / pixels / 1e6
    return F.when(per < 1, "RAW").when(per < 60, "SECOND").when(per < 3600, "MINUTE").when(per < 86400, "HOUR").when(per < 2592000, "DAY").otherwise("MONTH")
