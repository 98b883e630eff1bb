"""Payload formats of points: JSON, CSV lines, and length-prefixed binary."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_json(tag: Column, value: Column, timestamp: Column, quality: Column) -> Column:
    return F.to_json(F.struct(tag.alias("tag"), value.alias("value"), timestamp.alias("timestamp"), quality.alias("quality")))


def from_json(payload: Column) -> Column:
    return F.from_json(payload, "tag string, value double, timestamp long, quality int")


def to_csv_line(tag: Column, timestamp: Column, value: Column, quality: Column) -> Column:
    """tag,timestamp,value,quality with quality 0 for good and 1 otherwise."""
    return F.concat_ws(",", tag, timestamp.cast("string"), F.format_string("%.6f", value), F.when(quality.bitwiseAND(F.lit(192)) == 192, "0").otherwise("1"))


_HEAD, _HEAD_BYTES = "<BqdI", struct.calcsize("<BqdI")


def _pack(tag: str | None, ts: int, value: float, quality: int) -> bytes:
    t = (tag or "").encode()
    return struct.pack(_HEAD, 1, ts, value, quality) + struct.pack("<I", len(t)) + t


def _unpack(data: bytes) -> dict | None:
    if len(data) < _HEAD_BYTES + 4:
        return None
    version, ts, value, quality = struct.unpack_from(_HEAD, data)
    (n,) = struct.unpack_from("<I", data, _HEAD_BYTES)
    tag = data[_HEAD_BYTES + 4 : _HEAD_BYTES + 4 + n]
    return {"tag": tag.decode(), "timestamp": ts, "value": value, "quality": quality} if version == 1 and len(tag) == n else None


def to_binary(tag: Column, timestamp: Column, value: Column, quality: Column) -> Column:
    """A version byte, time, value, quality and the length-prefixed tag, little endian."""
    def run(*cols: pa.Array) -> pa.Array:
        return pa.array([_pack(*r) if None not in r[1:] else None for r in zip(*(c.to_pylist() for c in cols), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(tag, timestamp.cast("long"), value.cast("double"), quality.cast("int"))


def from_binary(payload: Column) -> Column:
    """The fields of a binary payload; null where it is cut short or of another version."""
    kind = pa.struct([("tag", pa.string()), ("timestamp", pa.int64()), ("value", pa.float64()), ("quality", pa.int32())])
    return F.arrow_udf(lambda a: pa.array([_unpack(x) if x else None for x in a.to_pylist()], kind), "struct<tag:string,timestamp:long,value:double,quality:int>")(payload)
