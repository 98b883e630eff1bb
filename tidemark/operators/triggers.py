"""Event frames that triggers open and close.

A template has start and end triggers on signals (formulas over a point). Thresholds fire
when a series passes the whole hysteresis band from one point to the next, digital ones when a
signal leaves or reaches 0, expressions at each point where they aren't 0. At each point end
triggers go first, then start triggers; a series has one open frame of a template at most, and a
start while it is open is passed over. A frame with a time limit ends there if no end trigger
came by then.

Which triggers fire at a point needs only the point before, so that is a window over all
points. What opens and closes is then decided over the few points at which something fired,
read as a sorted stream with one series' open frame in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.expression import compile_formula
from tidemark.points import ordered

FRAME = "tag_id long, template string, start_us long, start_seq long, end_us long, reason string"


@dataclass(frozen=True)
class Trigger:
    """kind: up, down (through threshold -/+ hysteresis), on, off, or expression."""

    kind: str
    threshold: float = 0.0
    hysteresis: float = 0.0
    signal: str = "|value"

    def __post_init__(self):
        if self.kind not in ("up", "down", "on", "off", "expression"):
            raise ValueError(f"unknown kind of trigger {self.kind!r}")

    def column(self, before: Column, now: Column) -> Column:
        low, high = self.threshold - self.hysteresis, self.threshold + self.hysteresis
        hit = {
            "up": lambda: (before <= low) & (now >= high), "down": lambda: (before >= high) & (now <= low), "on": lambda: (before == 0) & (now != 0),
            "off": lambda: (before != 0) & (now == 0), "expression": lambda: now != 0}[self.kind]()
        return F.coalesce(hit, F.lit(False))

    def fires(self, before: float | None, now: float | None) -> bool:
        """The same of two numbers."""
        if now is None or (before is None and self.kind != "expression"):
            return False
        low, high = self.threshold - self.hysteresis, self.threshold + self.hysteresis
        return {
            "up": lambda: before <= low and now >= high, "down": lambda: before >= high and now <= low, "on": lambda: before == 0 and now != 0,
            "off": lambda: before != 0 and now == 0, "expression": lambda: now != 0}[self.kind]()


@dataclass(frozen=True)
class FrameTemplate:
    name: str
    start: tuple[Trigger, ...]
    end: tuple[Trigger, ...]
    limit_us: int | None = None


Open = tuple[int, int]


def advance(template: FrameTemplate, opened: Open | None, us: int, seq: int, starts: bool, ends: bool) -> tuple[Open | None, tuple | None]:
    """The open frame (start and its seq) after a point, and the frame that closed there: start, seq, end, reason."""
    closed = None
    if opened and template.limit_us is not None and us > opened[0] + template.limit_us:
        opened, closed = None, (*opened, opened[0] + template.limit_us, "limit")
    elif opened and ends:
        opened, closed = None, (*opened, us, "end")
    return ((us, seq) if starts else None) if opened is None else opened, closed


def signals(templates: list[FrameTemplate]) -> list[str]:
    """The formulas that the templates watch, each once."""
    return list(dict.fromkeys(x.signal for t in templates for x in (*t.start, *t.end)))


def firings(points: DataFrame, templates: list[FrameTemplate]) -> DataFrame:
    """Points at which a trigger of a template fired: tag_id, template (its number), us, seq, starts, ends."""
    names = signals(templates)
    p = points.where(F.col("value").isNotNull()).select("tag_id", "us", "seq", *[compile_formula(s).alias(f"_s{i}") for i, s in enumerate(names)])
    p = p.withColumns({f"_b{i}": F.lag(f"_s{i}").over(ordered()) for i in range(len(names))})

    def any_of(triggers: tuple[Trigger, ...]) -> Column:
        hit = F.lit(False)
        for x in triggers:
            i = names.index(x.signal)
            hit = hit | x.column(F.col(f"_b{i}"), F.col(f"_s{i}"))
        return hit

    each = F.array(*[F.struct(F.lit(i).alias("template"), any_of(t.start).alias("starts"), any_of(t.end).alias("ends")) for i, t in enumerate(templates)])
    return p.select("tag_id", "us", "seq", F.explode(F.filter(each, lambda e: e["starts"] | e["ends"])).alias("_e")).select("tag_id", "_e.template", "us", "seq", "_e.starts", "_e.ends")


def frames(points: DataFrame, templates: list[FrameTemplate]) -> DataFrame:
    """Closed frames with their reason (end, limit), and those still open (no end, reason open)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, opened = None, None
        for b in batches:
            out = []
            for tag, k, us, seq, starts, ends in zip(*(b[c].tolist() for c in ("tag_id", "template", "us", "seq", "starts", "ends")), strict=True):
                if own != (tag, k):
                    out += [(own[0], templates[own[1]].name, *opened, None, "open")] if opened else []
                    own, opened = (tag, k), None
                opened, closed = advance(templates[k], opened, us, seq, starts, ends)
                if closed:
                    out.append((tag, templates[k].name, *closed))
            yield _frame_rows(out)
        yield _frame_rows([(own[0], templates[own[1]].name, *opened, None, "open")] if opened else [])

    sorted_ = firings(points, templates).repartition("tag_id", "template").sortWithinPartitions("tag_id", "template", "us", "seq")
    return sorted_.mapInPandas(run, FRAME)


def _frame_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in FRAME.split(", ")])
    return out.astype({"tag_id": "int64", "start_us": "int64", "start_seq": "int64", "end_us": "Int64"})
