"""Typed values, hashes, enumerations, instances, unions and figures at their edges."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import admin as M
from tidemark.operators import order as G
from tidemark.operators import windows as W
from tidemark.streaming.outbox import wait_us


def fnv(data, size):
    h, p = (V.FNV32, V.FNV32_PRIME) if size == 32 else (V.FNV64, V.FNV64_PRIME)
    for b in data:
        h = (h ^ b) * p % (1 << size)
    return h


def test_hashes(spark):
    texts = ["", "a", "foobar", "Ünï €", "x" * 300, None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", V.fnv32(F.col("s")).alias("a"), V.fnv64(F.col("s")).alias("b")).collect()
    for r in got:
        if r["s"] is not None:
            assert r["a"] == fnv(r["s"].encode(), 32) and r["b"] == f"{fnv(r['s'].encode(), 64):016x}"
    assert fnv(b"a", 32) == 0xE40C292C and fnv(b"a", 64) == 0xAF63DC4C8601EC8C  # published values


def test_casts_and_texts(spark):
    rows = [(1.5, "FLOAT64"), (-7.9, "INT32"), (3e9, "INT32"), (2.0, "DIGITAL"), (1.0, "BOOLEAN"), (0.0, "BOOLEAN"), (100.0, "FLOAT32"), (0.1234567, "FLOAT64"), (None, "FLOAT64"), (5.0, "STRING")]
    v, k = F.col("v"), F.col("k")
    df = spark.createDataFrame(rows, "v double, k string").select("v", "k", V.as_float(v, k).alias("f"), V.as_int(v, k).alias("i"), V.as_digital(v, k).alias("d"), V.to_text(v, k, F.lit(True)).alias("t"))
    got = df.withColumn("back", V.from_text(F.col("t"), k)).collect()
    assert [r["f"] for r in got] == [1.5, 0, 0, 0, 0, 0, 100.0, 0.1234567, None, 0]
    assert [r["i"] for r in got][1:3] == [-7, None] and got[3]["d"] == 2
    assert [r["t"] for r in got] == ["1.5", "-7", "3000000000", "enum(2)", "true", "false", "100", "0.123457", "BAD", "5.0"]
    assert [r["back"] for r in got] == [1.5, -7.0, 3e9, 2.0, 1.0, 0.0, 100.0, 0.123457, None, 5.0]
    bad = spark.createDataFrame([("x", "FLOAT64"), ("1e", "FLOAT64"), ("1.5", "INT32"), ("maybe", "BOOLEAN"), ("enum(x)", "DIGITAL"), ("", "INT32"), (None, "FLOAT64")], "t string, k string")
    assert all(r[0] is None for r in bad.select(V.from_text(F.col("t"), F.col("k"))).collect())


def test_changes_see_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(V.changed(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]


def test_other_types(spark):
    df = spark.createDataFrame([("FLOAT64",), ("DIGITAL",), ("BLOB",), (None,)], "k string").select(V.other_types(F.col("k")).alias("m")).select("m.*")
    assert [tuple(r) for r in df.collect()] == [(11, 10, True), (0, 11, False), (-1, -1, False), (-1, -1, False)]


def test_enumerations(spark):
    enum = spark.createDataFrame([("a", 1, "ON", False), ("a", 2, "ON", False), ("a", 3, "OLD", True), ("b", 1, "OFF", True)], "set string, code int, name string, retired boolean")
    assert {(r["set"], r["active"], r["retired"]) for r in M.enum_sets(enum).collect()} == {("a", 2, 1), ("b", 0, 1)}
    names = spark.createDataFrame([("a", "ON"), ("a", "OLD"), ("b", "OFF"), ("c", "ON")], "set string, name string")
    assert sorted((r["set"], r["name"], r["code"], r["valid"]) for r in M.enum_codes(names, enum).collect()) == [("a", "OLD", None, False), ("a", "ON", 1, True), ("b", "OFF", None, False), ("c", "ON", None, False)]


def test_instances(spark):
    frames = spark.createDataFrame([(1, "t"), (2, "t"), (3, "none")], "id int, template string")
    d = spark.createDataFrame([("t", "a", None, True), ("t", "b", "x", True), ("t", "c", None, False)], "template string, name string, default string, required boolean")
    own = spark.createDataFrame([(1, "a", "1"), (1, "z", "9"), (2, "b", "y")], "id int, name string, value string")
    got = sorted((r["id"], r["name"], r["value"], r["is_set"], r["missing"]) for r in M.instances(frames, d, own).collect())
    assert got == [(1, "a", "1", True, False), (1, "b", "x", True, False), (1, "c", None, False, False), (2, "a", None, False, True), (2, "b", "y", True, False), (2, "c", None, False, False)]


def test_union_of_results(spark):
    one = spark.createDataFrame([(1, 10, 1, 1.0), (1, 20, 2, None)], "tag_id long, us long, seq long, value double")
    two = spark.createDataFrame([(1, 20, 2, 5.0), (2, 5, 3, 6.0)], "tag_id long, us long, seq long, value double")
    assert sorted((tuple(r) for r in M.union_results(one, two).collect()), key=lambda r: r[2]) == [(1, 10, 1, 1.0), (1, 20, 2, None), (2, 5, 3, 6.0)]
    assert M.union_results(one.limit(0), two).count() == 2


def test_rate_alarms(spark):
    p = spark.createDataFrame([(1, 0, 1, 0.0), (1, 1_000_000, 2, 5.0), (1, 1_000_000, 3, 5.0), (1, 1_000_000, 4, 6.0), (1, 3_000_000, 5, 7.0)], "tag_id long, us long, seq long, value double")
    assert [(r["seq"], r["rate"]) for r in W.rate_alarms(p, 2.0).orderBy("seq").collect()] == [(2, 5.0), (4, None)]


def test_frame_lifecycles(spark):
    rows = [(1, 10, "start", "a"), (1, 20, "start", "a"), (1, 30, "close", "a"), (1, 40, "cancel", "a"), (1, 50, "acknowledge", "bo"), (1, 60, "acknowledge", "cy"), (2, 5, "close", "a"), (2, 6, "sing", None), (3, 1, "start", "a"), (3, 2, "cancel", "a")]
    got = {r["frame_id"]: tuple(r)[1:] for r in G.frame_lifecycle(spark.createDataFrame(rows, "frame_id int, us long, action string, actor string")).collect()}
    assert got == {1: ("ACKNOWLEDGED", 10, 30, 50, "bo", 3), 2: ("INACTIVE", None, None, None, None, 2), 3: ("CANCELLED", 1, 2, None, None, 0)}


@pytest.mark.parametrize(("attempt", "want"), [(1, 100), (2, 200), (3, 400), (4, 450), (60, 450)])
def test_waits(spark, attempt, want):
    assert spark.range(1).select(wait_us(F.lit(attempt), 100, 2.0, 450)).first()[0] == want
