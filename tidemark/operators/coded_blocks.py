"""Lossless codes of series in blocks: differences as varints, second differences and symbols as prefix codes, values by exclusive or.

Rows of a series are numbered and cut into blocks of `size`, so what is gathered in one row is bounded. Each
row's code is a column, of the row and the one before; a block joins its codes in order. Codes tell where
they end, so a block comes apart by one regular expression, and running sums inside the block give the
values back. Values share a window of bits with those before, so theirs is a fold over a block. All of it is
columns, grouping and windows; only the bits of a double are taken, a batch at a time, in Python.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import unzigzag, zigzag
from tidemark.points import ordered

SIZE = 256
#: Prefix and width of the classes of second differences; 0 alone is the bit 0.
CLASSES = (("10", 7), ("110", 9), ("1110", 12), ("1111", 64))
_VARINT = "(?:[89A-F][0-9A-F])*[0-7][0-9A-F]"
_SECOND = "|".join(["0", *(f"{p}[01]{{{w}}}" for p, w in CLASSES)])
_ROW = ("tag_id", "block")


def numbered(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Points with their block and their place i in it."""
    p = points.withColumn("_r", F.row_number().over(ordered()) - 1)
    return p.withColumn("block", F.floor(F.col("_r") / size)).withColumn("i", (F.col("_r") % size).cast("int")).drop("_r")


def _in_block() -> Window:
    return Window.partitionBy(*_ROW).orderBy("i")


def _joined(rows: DataFrame, code: str) -> DataFrame:
    """Blocks (tag_id, block, n, code) of rows' codes, one after the other."""
    g = rows.groupBy(*_ROW).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("i", code))).alias("_c"))
    return g.select(*_ROW, "n", F.array_join(F.transform("_c", lambda c: c[code]), "").alias(code))


def varint(n: Column) -> Column:
    """Hexadecimal digits of a folded whole number, seven bits a byte, the low ones first, 80 added to all bytes but the last."""
    parts = []
    for k in range(10):
        here, rest = F.shiftrightunsigned(n, 7 * k), F.shiftrightunsigned(n, 7 * (k + 1)) if k < 9 else F.lit(0).cast("long")
        byte = F.lpad(F.hex(here.bitwiseAND(F.lit(127)) + F.when(rest > 0, 128).otherwise(0)), 2, "0")
        parts.append(byte if k == 0 else F.when(here > 0, byte).otherwise(""))
    return F.concat(*parts)


def encode_times(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of times as the first one and the differences from each to the next, folded, as varints."""
    p = numbered(points, size)
    step = F.col("us") - F.coalesce(F.lag("us").over(_in_block()), F.lit(0))
    b = _joined(p.withColumn("_code", varint(zigzag(step))), "_code")
    return b.select(*_ROW, "n", F.unhex("_code").alias("data"))


def decode_times(blocks: DataFrame) -> DataFrame:
    """tag_id, block, i and us of all times in blocks."""
    t = blocks.select(*_ROW, F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit(f"({_VARINT})"))).alias("i", "_t"))
    places = F.sequence((F.length("_t") / 2 - 1).cast("int"), F.lit(0))
    folded = F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc * 128 + F.conv(F.substring("_t", k * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)))
    t = t.select(*_ROW, "i", unzigzag(folded).alias("_d"))
    return t.select(*_ROW, "i", F.sum("_d").over(_in_block().rowsBetween(Window.unboundedPreceding, 0)).alias("us"))


def _bits(n: Column, width: int) -> Column:
    """The low bits of a whole number as a text of 0 and 1."""
    return F.lpad(F.bin(n if width == 64 else n.bitwiseAND(F.lit((1 << width) - 1))), width, "0")


def _packed(bits: str) -> Column:
    """A text of bits as bytes, filled up with 0."""
    at = F.sequence(F.lit(1), F.greatest(F.length(bits), F.lit(1)), F.lit(8))
    return F.unhex(F.array_join(F.transform(at, lambda p: F.lpad(F.conv(F.rpad(F.substring(F.col(bits), p, F.lit(8)), 8, "0"), 2, 16), 2, "0")), ""))


def _unpacked(data: str) -> Column:
    h = F.hex(data)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda p: F.lpad(F.conv(F.substring(h, p, F.lit(2)), 16, 2), 8, "0")), "")


def encode_second(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of times as 64 bits of the first one, then the second differences in five classes of size."""
    w = _in_block()
    p = numbered(points, size).withColumn("_d", F.when(F.col("i") > 0, F.col("us") - F.lag("us").over(w)))
    p = p.withColumn("_s", F.col("_d") - F.coalesce(F.lag("_d").over(w), F.lit(0)))
    s = F.col("_s")
    code = F.when(F.col("i") == 0, _bits(F.col("us"), 64)).when(s == 0, "0")
    for prefix, width in CLASSES[:-1]:
        code = code.when(s.between(-(1 << (width - 1)), (1 << (width - 1)) - 1), F.concat(F.lit(prefix), _bits(s, width)))
    p = p.withColumn("_code", code.otherwise(F.concat(F.lit(CLASSES[-1][0]), _bits(s, 64))))
    return _joined(p, "_code").select(*_ROW, "n", _packed("_code").alias("data"))


def decode_second(blocks: DataFrame) -> DataFrame:
    """tag_id, block, i and us of all times in blocks."""
    b = blocks.select(*_ROW, "n", _unpacked("data").alias("_b"))
    signed = lambda text: F.conv(text, 2, -10).cast("long")
    first = signed(F.substring("_b", 1, 64))
    tokens = F.slice(F.regexp_extract_all(F.expr("substring(_b, 65)"), F.lit(f"({_SECOND})")), F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))
    t = b.select(*_ROW, first.alias("_first"), F.posexplode(F.array_prepend(tokens, F.lit("0"))).alias("i", "_t"))
    value = F.lit(0).cast("long")
    for prefix, width in CLASSES:
        v = signed(F.substring("_t", len(prefix) + 1, width))
        value = F.when(F.length("_t") == len(prefix) + width, v if width == 64 else v - F.when(v >= 1 << (width - 1), 1 << width).otherwise(0)).otherwise(value)
    w = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    t = t.select(*_ROW, "i", "_first", value.alias("_s")).withColumn("_d", F.sum("_s").over(w))
    return t.select(*_ROW, "i", (F.col("_first") + F.sum("_d").over(w)).alias("us"))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol in an optimal prefix code; one symbol alone has one bit."""
    order = count()
    heap = [(n, next(order), (s,)) for s, n in sorted(counts.items())]
    out = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            out[s] += 1
        heapq.heappush(heap, (a + b, next(order), x + y))
    return {s: max(1, n) for s, n in out.items()}


def code_table(symbols: DataFrame) -> DataFrame:
    """symbol, n, bits and code (a text of 0 and 1) of the bytes in column symbol, in canonical order.

    Symbols are 0 to 255, so the counts that reach the driver are 256 rows at most.
    """
    counts = {r["symbol"]: r["n"] for r in symbols.where(F.col("symbol").between(0, 255)).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    rows, code, before = [], 0, 0
    for s, bits in sorted(code_lengths(counts).items(), key=lambda x: (x[1], x[0])):
        code <<= bits - before
        rows.append((s, counts[s], bits, format(code, f"0{bits}b")))
        code, before = code + 1, bits
    return symbols.sparkSession.createDataFrame(rows, "symbol int, n long, bits int, code string")


def average_bits(table: DataFrame) -> DataFrame:
    """One row: symbols, occurrences, mean bits of an occurrence, and the entropy that bounds them from below."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    t = table.withColumn("_p", share)  # 256 rows at most
    return t.agg(F.count("*").alias("symbols"), F.sum("n").alias("n"), F.sum(F.col("_p") * F.col("bits")).alias("average_bits"), F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"))


def encode_symbols(points: DataFrame, table: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of the byte in column symbol by a code table; n and bits (how many of the data's bits count)."""
    p = numbered(points, size).join(table.select("symbol", F.col("code").alias("_code")), "symbol")
    return _joined(p, "_code").select(*_ROW, "n", F.length("_code").alias("bits"), _packed("_code").alias("data"))


def decode_symbols(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """tag_id, block, i and symbol of all rows in blocks."""
    codes = [r["code"] for r in table.select("code").collect()]  # 256 at most
    b = blocks.select(*_ROW, F.substring(_unpacked("data"), F.lit(1), F.col("bits")).alias("_b"))
    t = b.select(*_ROW, F.posexplode(F.regexp_extract_all("_b", F.lit(f"({'|'.join(codes)})"))).alias("i", "code"))
    return t.join(table.select("code", "symbol"), "code").select(*_ROW, "i", "symbol")


def _viewed(column: str, kind: type, other: type) -> Column:
    """A column's 8 bytes as another kind of number."""

    @F.pandas_udf("long" if other is np.int64 else "double")
    def view(values: pd.Series) -> pd.Series:
        return pd.Series(values.to_numpy(kind).view(other))

    return view(column)


def encode_values(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of values: 64 bits of the first, then what differs from the one before.

    0: nothing differs. 10: it lies in the last window of bits, which follow. 11: a new window, its
    leading zeros (5 bits, 31 at most), its width less one (6 bits), and its bits. Points without a value are left out.
    """
    p = numbered(points.where("value is not null"), size).withColumn("_v", _viewed("value", np.float64, np.int64))
    x = F.col("_v").bitwiseXOR(F.lag("_v").over(_in_block()))
    p = p.select(*_ROW, "i", F.lpad(F.bin(F.coalesce(x, F.col("_v"))), 64, "0").alias("_x"))
    p = p.withColumn("_lead", F.least(F.lit(31), F.length("_x") - F.length(F.ltrim("_x", F.lit("0"))))).withColumn("_width", F.length(F.rtrim("_x", F.lit("0"))) - F.col("_lead"))
    g = p.groupBy(*_ROW).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("i", "_x", "_lead", "_width"))).alias("_c"))
    start = F.struct(F.lit(-1).alias("lead"), F.lit(0).alias("width"), F.lit("").alias("code"))

    def step(acc: Column, row: Column) -> Column:
        bits, lead, width = row["_x"], row["_lead"], row["_width"]
        fits = (acc["lead"] >= 0) & (lead >= acc["lead"]) & (lead + width <= acc["lead"] + acc["width"])
        inside = F.concat(F.lit("10"), F.substring(bits, acc["lead"] + 1, acc["width"]))
        anew = F.concat(F.lit("11"), F.lpad(F.bin(lead.cast("long")), 5, "0"), F.lpad(F.bin((width - 1).cast("long")), 6, "0"), F.substring(bits, lead + 1, width))
        same, first = ~bits.contains("1"), row["i"] == 0
        code = F.when(first, bits).when(same, "0").when(fits, inside).otherwise(anew)
        keep = first | same | fits
        return F.struct(F.when(keep, acc["lead"]).otherwise(lead).alias("lead"), F.when(keep, acc["width"]).otherwise(width).alias("width"), F.concat(acc["code"], code).alias("code"))

    g = g.select(*_ROW, "n", F.aggregate("_c", start, step)["code"].alias("_code"))
    return g.select(*_ROW, "n", _packed("_code").alias("data"))


def decode_values(blocks: DataFrame) -> DataFrame:
    """tag_id, block, i and value of all values in blocks."""
    b = blocks.select(*_ROW, "n", F.encode(_unpacked("data"), "UTF-8").alias("_b"))
    whole = F.col("_b")  # bytes are cut at any place without counting up to it
    cut = lambda at, width: F.decode(F.substring(whole, at, width), "UTF-8")
    number = lambda at, width: F.conv(cut(at, width), 2, 10).cast("int")
    first = F.conv(cut(F.lit(1), F.lit(64)), 2, -10).cast("long")
    start = F.struct(F.lit(65).alias("at"), F.lit(0).alias("lead"), F.lit(0).alias("width"), first.alias("last"), F.array(first).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        same, anew = cut(at, F.lit(1)) == "0", cut(at, F.lit(2)) == "11"
        lead = F.when(anew, number(at + 2, F.lit(5))).otherwise(acc["lead"])
        width = F.when(anew, number(at + 7, F.lit(6)) + 1).otherwise(acc["width"])
        begin = at + F.when(anew, 13).otherwise(2)
        bits = F.rpad(F.concat(F.repeat(F.lit("0"), lead), cut(begin, width)), 64, "0")
        value = F.when(same, acc["last"]).otherwise(acc["last"].bitwiseXOR(F.conv(bits, 2, -10).cast("long")))
        return F.struct(F.when(same, at + 1).otherwise(begin + width).alias("at"), F.when(same, acc["lead"]).otherwise(lead).alias("lead"), F.when(same, acc["width"]).otherwise(width).alias("width"), value.alias("last"), F.array_append(acc["out"], value).alias("out"))

    more = F.slice(F.sequence(F.lit(0), F.col("n")), F.lit(1), F.col("n") - 1)
    out = b.select(*_ROW, F.posexplode(F.aggregate(more, start, step)["out"]).alias("i", "_v"))
    return out.select(*_ROW, "i", _viewed("_v", np.int64, np.float64).alias("value"))
