"""Quality codes: one SMALLINT in the OPC DA layout, and the mappings onto it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the quality byte.
GOOD, UNCERTAIN, BAD, MAJOR = 0xC0, 0x40, 0x00, 0xC0


def major(q: Column) -> Column:
    return q.bitwiseAND(F.lit(MAJOR))


def is_good(q: Column) -> Column:
    return major(q) == GOOD


def is_bad(q: Column) -> Column:
    return major(q) == BAD


def set_bits(q: Column, bits: int | Column) -> Column:
    return q.bitwiseOR(bits if isinstance(bits, Column) else F.lit(bits))


def name(q: Column) -> Column:
    m = major(q)
    return F.when(m == GOOD, "GOOD").when(m == UNCERTAIN, "UNCERTAIN").when(m == BAD, "BAD").otherwise("UNKNOWN")


def is_valid(q: Column) -> Column:
    return major(q).isin(GOOD, UNCERTAIN, BAD)


def worst(*q: Column) -> Column:
    """The worst of several quality codes by major bits: bad, then uncertain, then good."""
    rank = [F.struct(F.when(is_bad(x), 0).when(major(x) == UNCERTAIN, 1).otherwise(2).alias("r"), x.alias("q")) for x in q]
    return (F.least(*rank) if len(rank) > 1 else rank[0])["q"]


def from_staleness(age_us: Column, max_us: Column) -> Column:
    """Good up to a tenth of the allowed age, uncertain up to all of it, then bad."""
    return F.when(age_us <= max_us / 10, GOOD).when(age_us <= max_us, UNCERTAIN).otherwise(BAD)
