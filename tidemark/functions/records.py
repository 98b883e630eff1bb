"""Column functions of records: time texts, status words, topics, point types, attribute sets, text templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status word of each quality, in the order of the specification.
STATUS_WORDS = {
    "GOOD": 0x00000000,
    "BAD": 0x80000000,
    "UNCERTAIN": 0x40000000,
    "SUBSTITUTED": 0x00040000,
    "QUESTIONABLE": 0x40800000,
    "CONVERSION_ERROR": 0x80100000,
    "SENSOR_FAILURE": 0x80020000,
    "LAST_KNOWN": 0x00080000,
    "COMM_FAILURE": 0x80310000,
    "OUT_OF_SERVICE": 0x80320000,
}
# Bytes of a value of each point type; 0 where they vary.
TYPE_BYTES = {
    "DIGITAL": 2,
    "INT16": 2,
    "INT32": 4,
    "FLOAT16": 2,
    "FLOAT32": 4,
    "FLOAT64": 8,
    "STRING": 80,
    "TIMESTAMP": 8,
    "BLOB": 0,
}
NUMERIC_TYPES = ("INT16", "INT32", "FLOAT16", "FLOAT32", "FLOAT64")


def _lookup(key: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def status_word(quality: Column) -> Column:
    """Status word of a quality name; that of BAD where the name is unknown or null."""
    return F.coalesce(_lookup(quality, STATUS_WORDS), F.lit(STATUS_WORDS["BAD"])).cast("long")


def status_quality(word: Column) -> Column:
    """Quality name by the two high bits of a status word."""
    return F.when(word == 0, "GOOD").when(word.bitwiseAND(F.lit(0x80000000)) != 0, "BAD").when(word.bitwiseAND(F.lit(0x40000000)) != 0, "UNCERTAIN").when(word.isNotNull(), "QUESTIONABLE")


def type_bytes(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, TYPE_BYTES), F.lit(0)).cast("int")


def type_is_numeric(kind: Column) -> Column:
    return F.coalesce(kind.isin(*NUMERIC_TYPES), F.lit(False))


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 time with Z or an offset (UTC without one); null for any other text."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"), F.unix_micros(F.try_to_timestamp(zoned)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order of a and b."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def add_seconds(us: Column, seconds: Column) -> Column:
    """A time moved by seconds with fraction, to the nearest microsecond."""
    return us + F.round(seconds * 1_000_000).cast("long")


def range_meet(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """Start and end of the common part of two time ranges, null where there is none; a null border is open."""
    start, end = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(start <= end, start), F.when(start <= end, end)


def topic_valid(topic: Column) -> Column:
    """A topic to publish to: not empty, no wildcard."""
    return (F.length(topic) > 0) & ~topic.rlike("[#+]")


def topic_filter_valid(topic_filter: Column) -> Column:
    """A subscription: # only as the whole last level, + only as a whole level."""
    level = r"([^/#+]*|\+)"
    return (F.length(topic_filter) > 0) & topic_filter.rlike(f"^({level}/)*({level}|#)$")


def jaccard(a: Column, b: Column) -> Column:
    """Shared names over all names of two attribute lists; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def build_text(template: str, parts: list[Column]) -> Column:
    """The template with {0}, {1}, ... replaced by the parts; a null part is empty, other braces stay."""
    return reduce(lambda out, part: F.replace(out, F.lit(f"{{{part[0]}}}"), F.coalesce(part[1].cast("string"), F.lit(""))), enumerate(parts), F.lit(template))


def metadata_error(tag_id: Column, name: Column, eu: tuple[Column, Column], instrument: tuple[Column, Column], kind: Column, kinds: int, deviation: Column, times: tuple[Column, Column], retention: Column) -> Column:
    """0 for valid tag data, else the code of the first rule that it breaks (-2 to -9)."""
    empty = lambda zero, span: F.abs(span - zero) < 1e-12
    return (
        F.when(tag_id < -1, -2).when(F.coalesce(F.length(name), F.lit(0)) == 0, -3).when(empty(*eu), -4).when(empty(*instrument), -5).when(kind >= kinds, -6)
        .when(deviation < 0, -7).when((times[1] > 0) & (times[0] > times[1]), -8).when(retention <= 0, -9).otherwise(0)
    )


def eu_deadband(zero: Column, span: Column, deviation: Column, percent: Column) -> Column:
    """The wider of an absolute deviation and a percentage of the range."""
    return F.greatest(deviation, percent * F.abs(span - zero) / 100)
