"""Lossless block codes: there and back, against plain codes, at edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs as X
from tidemark.operators import coded_blocks as B


def points_of(spark, times, tag=1):
    return spark.createDataFrame([(tag, t, i, float(i)) for i, t in enumerate(times)], "tag_id long, us long, seq long, value double")


def times(n, seed):
    rng = np.random.default_rng(seed)
    steps = rng.choice([0, 1, 60, 61, 200, 3000, 10**6, 10**12], n, p=[0.1, 0.2, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])
    return np.cumsum(steps).tolist()


@pytest.mark.parametrize("n,size", [(1, 4), (2, 4), (4, 4), (5, 4), (300, 64)])
def test_times_there_and_back(spark, n, size):
    t = sorted([*times(n, n)])
    p = points_of(spark, t)
    for encode, decode in ((B.encode_times, B.decode_times), (B.encode_second, B.decode_second)):
        b = encode(p, size)
        assert b.count() == -(-n // size)
        got = [r["us"] for r in decode(b).orderBy("block", "i").collect()]
        assert got == t


def test_codes_are_the_plain_ones(spark):
    t = times(60, 3)
    p = points_of(spark, t)
    data = B.encode_times(p, 100).first()["data"]
    assert bytes(data) == X.varint_encode([t[0], *np.diff(t).tolist()])
    bits = "".join(f"{b:08b}" for b in X.times_encode(t))[32:]  # the plain form has its count first
    own = B.encode_second(p, 100).select(B._unpacked("data")).first()[0]
    assert own.rstrip("0") == bits.rstrip("0")


def test_large_and_negative(spark):
    t = [-(2**62), -5, 0, 2**61]
    p = points_of(spark, t)
    assert [r["us"] for r in B.decode_second(B.encode_second(p)).orderBy("i").collect()] == t
    t = [-(2**60), -5, 0, 2**60]
    assert [r["us"] for r in B.decode_times(B.encode_times(points_of(spark, t))).orderBy("i").collect()] == t
    assert B.encode_times(p.limit(0)).count() == B.encode_second(p.limit(0)).count() == 0


def test_prefix_codes(spark):
    rng = np.random.default_rng(1)
    s = np.minimum(rng.geometric(0.2, 700) - 1, 255).tolist()
    p = points_of(spark, range(len(s))).withColumn("symbol", F.element_at(F.array(*map(F.lit, s)), F.col("seq").cast("int") + 1))
    table = B.code_table(p)
    codes = {r["symbol"]: r["code"] for r in table.collect()}
    assert not any(a != b and codes[b].startswith(codes[a]) for a in codes for b in codes)
    assert sum(2.0 ** -len(c) for c in codes.values()) == 1.0
    got = [r["symbol"] for r in B.decode_symbols(B.encode_symbols(p, table, 64), table).orderBy("block", "i").collect()]
    assert got == s
    a = B.average_bits(table).first()
    assert a["entropy"] <= a["average_bits"] < a["entropy"] + 1 and a["n"] == 700
    one = points_of(spark, range(9)).withColumn("symbol", F.lit(7))
    only = B.code_table(one)
    assert [r["symbol"] for r in B.decode_symbols(B.encode_symbols(one, only), only).collect()] == [7] * 9
    assert B.code_lengths({}) == {} and B.code_lengths({1: 5, 2: 5, 3: 10}) == {1: 2, 2: 2, 3: 1}


def test_values_there_and_back(spark):
    rng = np.random.default_rng(4)
    for v in ([1.5], [2.0, 2.0], np.round(rng.normal(size=200), 2).tolist(), [0.0, -0.0, 5e-324, 1e308, -1e308, 1.0, 1.0, 1 / 3], np.repeat([1.0, 1.5, 2.0], 40).tolist()):
        p = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(v)], "tag_id long, us long, seq long, value double")
        b = B.encode_values(p, 64)
        got = [r["value"] for r in B.decode_values(b).orderBy("block", "i").collect()]
        assert np.array_equal(np.array(got).view(np.int64), np.array(v).view(np.int64))
        own = b.orderBy("block").select(B._unpacked("data")).first()[0]
        plain = "".join(f"{x:08b}" for x in X.xor_encode(v[:64]))[32:]
        assert own.rstrip("0") == plain.rstrip("0")
    assert B.decode_values(B.encode_values(p.limit(0))).count() == 0
