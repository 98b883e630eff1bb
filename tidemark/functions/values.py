"""Values as typed by their attribute: casts, texts and back, changes, name hashes, type maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOATS, INTEGERS = ("FLOAT16", "FLOAT32", "FLOAT64"), ("INT16", "INT32")
#: Offset and prime of the FNV-1a hashes of 32 and 64 bits.
FNV32, FNV32_PRIME = 0x811C9DC5, 0x01000193
FNV64, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3

#: Numbers of each point type in two other type systems, and whether the first holds it without loss.
OTHER_TYPES = {"FLOAT64": (11, 10, True), "FLOAT32": (10, 9, True), "INT32": (6, 3, True), "INT16": (4, 1, True), "DIGITAL": (0, 11, False), "STRING": (12, 12, True)}


def other_types(kind: Column) -> Column:
    """Struct of the numbers of a point type in the two systems (-1 where there is none) and lossless."""
    out = F.struct(F.lit(-1).alias("server"), F.lit(-1).alias("broker"), F.lit(False).alias("lossless"))
    for name, (a, b, whole) in OTHER_TYPES.items():
        out = F.when(kind == name, F.struct(F.lit(a).alias("server"), F.lit(b).alias("broker"), F.lit(whole).alias("lossless"))).otherwise(out)
    return out


def as_float(value: Column, kind: Column) -> Column:
    """A value of a float type, 0 for any other type."""
    return F.when(kind.isin(*FLOATS), value.cast("double")).otherwise(0.0)


def as_int(value: Column, kind: Column) -> Column:
    """A value of an integer type cut to a whole number, null outside 32 bits, 0 for any other type."""
    return F.when(kind.isin(*INTEGERS), F.when(value.between(-(2**31), 2**31 - 1), value.cast("int"))).otherwise(0)


def as_digital(value: Column, kind: Column) -> Column:
    """The state number of a digital value, 0 for any other type."""
    return F.when(kind == "DIGITAL", value.cast("int")).otherwise(0)


def changed(now: Column, before: Column) -> Column:
    """Whether two values, or structs of value, time and status, differ in any part; nulls are equal."""
    return ~now.eqNullSafe(before)


def to_text(value: Column, kind: Column, good: Column) -> Column:
    """A value as text: BAD where it isn't good, numbers to six places without trailing zeros, booleans as words, enum numbers in brackets."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(~good | value.isNull(), "BAD").when(kind.isin(*FLOATS), number).when(kind.isin(*INTEGERS), F.format_string("%d", value.cast("long")))
        .when(kind == "BOOLEAN", F.when(value != 0, "true").otherwise("false")).when(kind == "DIGITAL", F.format_string("enum(%d)", value.cast("long"))).otherwise(value.cast("string")))


def from_text(text: Column, kind: Column) -> Column:
    """The number that a text gives for a type, null where it gives none."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))
    return (
        F.when(kind.isin(*INTEGERS), F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.cast("double"))).when(kind == "BOOLEAN", F.when(F.lower(t).isin("true", "1"), 1.0).when(F.lower(t).isin("false", "0"), 0.0))
        .when(kind == "DIGITAL", F.nullif(F.regexp_extract(t, r"^enum\((\d{1,9})\)$", 1), F.lit("")).cast("double")).otherwise(number))


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))
    return F.when(F.length(digits) > 0, F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv32(text: Column) -> Column:
    """FNV-1a hash of 32 bits of a text's bytes, as a long."""
    return F.aggregate(_bytes(text), F.lit(FNV32).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv64(text: Column) -> Column:
    """FNV-1a hash of 64 bits of a text's bytes, as 16 hexadecimal digits.

    The product is taken in halves of 32 bits, so nothing overflows a long.
    """
    half, low_prime = F.lit(0xFFFFFFFF), FNV64_PRIME & 0xFFFFFFFF
    start = F.struct(F.lit(FNV64 >> 32).cast("long").alias("hi"), F.lit(FNV64 & 0xFFFFFFFF).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        low = lo * low_prime
        high = h["hi"] * low_prime + F.shiftright(low, 32) + F.shiftleft(lo, 8)  # the prime's high half is 2**8
        return F.struct(high.bitwiseAND(half).alias("hi"), low.bitwiseAND(half).alias("lo"))

    h = F.aggregate(_bytes(text), start, step)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
