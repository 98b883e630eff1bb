"""Retrieval specifications: filters, order and paging as one plan, and as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quality import is_good
from tidemark.functions.scalar import glob_regex


class SpecError(ValueError):
    """An invalid specification; `code` tells which rule it breaks."""

    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


@dataclass(frozen=True)
class QuerySpec:
    """What to read: series, time range (half-open unless end_inclusive), values, quality, order and page."""

    tag_ids: tuple[int, ...] = ()
    tag_pattern: str | None = None
    start_us: int | None = None
    end_us: int | None = None
    end_inclusive: bool = False
    min_value: float | None = None
    max_value: float | None = None
    good_only: bool = False
    descending: bool | None = None
    limit: int | None = None
    offset: int = 0

    def validate(self) -> None:
        if self.start_us is not None and self.end_us is not None and self.end_us <= self.start_us:
            raise SpecError(-3, "the end must be after the start")
        if self.min_value is not None and self.max_value is not None and self.min_value > self.max_value:
            raise SpecError(-6, "the lowest value is above the highest")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise SpecError(-7, "limit and offset can't be negative")

    def retrieve(self, points: DataFrame) -> DataFrame:
        """The filters reach the scan; a page with an order is a top-k, not a full sort."""
        self.validate()
        p = points
        if self.tag_ids:
            p = p.where(F.col("tag_id").isin(*self.tag_ids))
        if self.tag_pattern is not None:
            p = p.where(F.col("tag_name").rlike(glob_regex(self.tag_pattern)))
        if self.start_us is not None:
            p = p.where(F.col("us") >= self.start_us)
        if self.end_us is not None:
            p = p.where(F.col("us") <= self.end_us if self.end_inclusive else F.col("us") < self.end_us)
        if self.min_value is not None:
            p = p.where(F.col("value") >= self.min_value)
        if self.max_value is not None:
            p = p.where(F.col("value") <= self.max_value)
        if self.good_only:
            p = p.where(is_good(F.col("quality")))
        if self.descending is not None or self.limit is not None:
            p = p.orderBy("us", "seq") if not self.descending else p.orderBy(F.desc("us"), F.desc("seq"))
        if self.offset:
            p = p.offset(self.offset)
        return p.limit(self.limit) if self.limit is not None else p

    def sql(self, table: str = "points") -> tuple[str, dict]:
        """The same query as Spark SQL with named parameters, for spark.sql(text, args=...)."""
        self.validate()
        where, args = [], {}
        if self.tag_ids:
            where.append("array_contains(:tags, tag_id)")
            args["tags"] = list(self.tag_ids)
        for name, op, value in (("start", ">=", self.start_us), ("end", "<=" if self.end_inclusive else "<", self.end_us)):
            if value is not None:
                where.append(f"us {op} :{name}")
                args[name] = value
        for name, op, value in (("low", ">=", self.min_value), ("high", "<=", self.max_value)):
            if value is not None:
                where.append(f"value {op} :{name}")
                args[name] = value
        if self.good_only:
            where.append("(quality & 192) = 192")
        text = f"SELECT tag_id, us, seq, value, quality FROM {table}" + (f" WHERE {' AND '.join(where)}" if where else "")
        if self.descending is not None or self.limit is not None:
            text += " ORDER BY us DESC, seq DESC" if self.descending else " ORDER BY us, seq"
        text += f" LIMIT {self.limit}" if self.limit is not None else ""
        return text + (f" OFFSET {self.offset}" if self.offset else ""), args

    def estimated_rows(self, interval_us: int = 10_000_000, cap: int = 5_000_000) -> int:
        """Expected rows at one stored point for each interval and series."""
        if self.start_us is None or self.end_us is None:
            return cap
        return max(1, min(cap, (self.end_us - self.start_us) // interval_us * max(1, len(self.tag_ids))))

    def page_size(self, target_bytes: int = 1 << 20, row_bytes: int = 48) -> int:
        return max(1, min(max(100, min(100_000, target_bytes // row_bytes)), self.estimated_rows()))
