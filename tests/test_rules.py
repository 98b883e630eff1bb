"""Small fixtures with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs as X
from tidemark.functions import quality as Q
from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A
from tidemark.operators import compress as C
from tidemark.operators import frames as E
from tidemark.operators import hierarchy as H
from tidemark.operators import interpolate as I
from tidemark.operators import order as G
from tidemark.operators import state as T
from tidemark.operators import windows as W
from tidemark.plans.expression import FormulaError, compile_formula, validate
from tidemark.plans.query_spec import QuerySpec, SpecError
from tidemark.sources import archive

SEC = 1_000_000


def series(spark, pairs, tag=1, quality=192):
    return spark.createDataFrame([(tag, int(t * SEC), i, None if v is None else float(v), quality) for i, (t, v) in enumerate(pairs)], "tag_id long, us long, seq long, value double, quality int")


def one(df, *cols):
    r = df.first()
    return tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]


def test_ramp_aggregates(spark):
    p = series(spark, [(i, 10 * i) for i in range(100)])
    assert one(A.aggregate(p, ["average", "minimum", "maximum"]), "average", "minimum", "maximum") == (495.0, 0.0, 990.0)
    assert one(A.aggregate(series(spark, [(0, 0), (10, 10)]), ["time_average", "integral"]), "time_average", "integral") == (5.0, 50.0)
    assert one(A.aggregate(series(spark, [(i, 5) for i in range(10)]), ["stddev_pop"]), "stddev_pop") == 0.0


def test_nulls_and_single_points(spark):
    p = series(spark, [(0, None), (1, 4)])
    got = A.aggregate(p, ["average", "count", "sum", "delta", "rate", "time_average"]).first()
    assert (got["average"], got["count"], got["sum"]) == (4.0, 2, 4.0)
    single = A.aggregate(series(spark, [(0, 7)]), ["delta", "rate", "time_average"]).first()
    assert (single["delta"], single["rate"], single["time_average"]) == (None, None, 7.0)


def test_windows(spark):
    p = series(spark, [(i, i) for i in range(100)])
    assert W.tumbling(p, 10 * SEC).count() == 10
    s = series(spark, [(i, i) for i in range(20)] + [(60 + i, i) for i in range(30)])
    assert W.sessions(s, 5 * SEC).count() == 2
    g = series(spark, [(0, 1), (1, 1), (11, 1), (12, 1), (62, 1)])
    assert W.gaps(g, 5 * SEC).count() == 2


def test_cusum_and_ema(spark):
    p = series(spark, [(i, 50) for i in range(5)] + [(5 + i, 55) for i in range(5)])
    assert W.cusum(p, 50.0, 1.0, 5.0).where("alarm").count() > 0
    e = W.ema(series(spark, [(0, 100), (1, 200), (2, 130)]), 0.3).orderBy("us").toPandas()["ema"].tolist()
    assert e == pytest.approx([100, 130, 130])


def test_cusum_at_its_limit_is_no_alarm(spark):
    # 19.54 + 80.46 is 100.00000000000001 in doubles, and 100 in hundredths
    alarms = lambda *v: [r["alarm"] for r in W.cusum(series(spark, list(enumerate(v))), 45.0, 5.0, 100.0).orderBy("us").collect()]
    assert alarms(69.54, 130.46) == [False, False]
    assert alarms(86.34, 76.18, 87.48) == [False, False, False]
    assert alarms(69.54, 130.47) == [False, True]
    assert alarms(20.46, -40.46) == [False, False]
    assert alarms(20.46, -40.47) == [False, True]


def test_interpolation(spark):
    p = series(spark, [(0, 0), (10, 100), (20, 200)])
    q = spark.createDataFrame([(1, t * SEC) for t in (-5, 0, 5, 15, 25)], "tag_id long, q_us long")
    get = lambda m, **k: {r["q_us"] // SEC: r["value"] for r in I.interpolate(p, q, m, **k).collect()}
    assert get("linear") == pytest.approx({-5: -50.0, 0: 0.0, 5: 50.0, 15: 150.0, 25: 250.0})
    assert get("linear", extrapolate=False)[25] == 200.0
    step = get("step")
    assert step[-5] is None and step[5] == 0.0 and step[15] == 100.0
    squares = series(spark, [(i, i * i) for i in range(4)])
    at = spark.createDataFrame([(1, 1_500_000)], "tag_id long, q_us long")
    assert one(I.interpolate(squares, at, "lagrange3"), "value") == pytest.approx(2.25)
    assert one(I.interpolate(squares, at, "quadratic"), "value") == pytest.approx(2.25)
    line = series(spark, [(10 * i, 10 * i) for i in range(4)])
    mid = spark.createDataFrame([(1, 15 * SEC)], "tag_id long, q_us long")
    for m in ("spline", "akima"):
        assert one(I.smooth(line, mid, m), "value") == pytest.approx(15.0)


def test_lossy_filters(spark):
    kept = lambda df: [r["us"] // SEC for r in df.orderBy("us").collect()]
    assert kept(C.deadband(series(spark, enumerate([0, 0.1, 0.2, 5, 5.1])), 2.0)) == [0, 3]
    assert kept(C.deadband(series(spark, enumerate([10, 10.2, 10.7, 10.85])), 0.5)) == [0, 2]
    t = np.arange(50.0)
    assert kept(C.swinging_door(series(spark, [(i, 2 * i) for i in range(50)]), 0.1)) == [0, 49]
    assert C.top_down_mask(t, 2 * t, 0.1).sum() == 2
    v = np.sin(t / 5) * 10
    keep = kept(C.swinging_door(series(spark, enumerate(v.tolist())), 0.5))
    assert np.abs(np.interp(t, keep, v[keep]) - v).max() <= 1.0
    assert C.largest_triangle_mask(t, v, 10).sum() == 10


def test_filters_carry_their_state(spark):
    """Long series over many batches, beside short ones: the filters against their masks over whole series."""
    rng = np.random.default_rng(4)
    sizes = {1: 30_000, 2: 1, 3: 25_000, 4: 2, 5: 400}
    v = {k: np.cumsum(rng.normal(size=n)) for k, n in sizes.items()}
    rows = [(k, i * SEC, i, float(x), 192) for k in v for i, x in enumerate(v[k])]
    p = spark.createDataFrame(rows, "tag_id long, us long, seq long, value double, quality int").repartition(5)
    count = lambda df: {r["tag_id"]: r["count"] for r in df.groupBy("tag_id").count().collect()}
    want = {}
    for k, x in v.items():
        last, n = None, 0
        for y in x:
            if last is None or abs(y - last) > 3:
                last, n = y, n + 1
        want[k] = n
    assert count(C.deadband(p, 3.0)) == want
    assert count(C.piecewise_linear(p, 3.0)) == {k: int(C.top_down_mask(np.arange(len(x)) * 1.0, x, 3.0).sum()) for k, x in v.items()}
    door = C.swinging_door(p, 3.0).toPandas().sort_values("us")
    for k, x in v.items():
        at = door[door["tag_id"] == k]["seq"].to_numpy()
        assert {0, len(x) - 1} <= set(at) and np.abs(np.interp(np.arange(len(x)), at, x[at]) - x).max() <= 6.0


def test_depth_has_no_bound(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id long, parent long")
    assert H.closure(chain).count() == 100 * 101 // 2
    with pytest.raises(ValueError):
        H.closure(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent long"))
    links = spark.createDataFrame([(i, i + 1, 1.0, True) for i in range(40)], "a long, b long, strength double, causal boolean")
    assert [r["length"] for r in G.causal_chains(links).collect()] == [41]


def test_rules_of_any_severity(spark):
    frames = spark.createDataFrame([(1, "t", 12), (2, "t", 9), (3, "u", 10), (4, "u", 2)], "id long, template string, severity int")
    rules = spark.createDataFrame([(1, 3, None, ["a"], True), (2, 10, None, ["b"], True), (3, 10, "t", ["c"], True)], "rule_id int, min_severity int, rule_template string, recipients array<string>, enabled boolean")
    got = {(r["id"], r["recipient"]) for r in E.match_rules(frames, rules).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "a"), (1, "b"), (3, "b"), (1, "c")}


def test_state(spark):
    p = series(spark, [(0, 70), (1, 82), (2, 78), (3, 74), (4, 96), (5, 3), (6, 1)])
    assert [r["alarm"] for r in T.latched_alarms(p, 2, 5, 80, 95, 5).orderBy("us").collect()] == ["NONE", "HI", "HI", "NONE", "HIHI", "LO", "LOLO"]
    d = series(spark, [(0, 0), (1, 9), (2, 9), (3, 9), (4, 0), (5, 9)])
    assert T.debounced_trigger(d, 5, 1, samples=3).count() == 1
    c = series(spark, [(0, 1), (1, 1), (2, 1), (100, 1), (200, 1), (201, 1), (202, 1)])
    got = T.time_clusters(c, 2 * SEC, 3).orderBy("us").toPandas()["cluster"]
    assert got[:3].nunique() == 1 and np.isnan(got[3]) and got[4:].nunique() == 1 and got[0] != got[4]


def test_codecs():
    rng = np.random.default_rng(1)
    for v in ([], [1.0], [1.0, 1.0, 1.5, -2.25e300], rng.normal(size=200).tolist()):
        assert X.xor_decode(X.xor_encode(v)) == v
    for t in ([], [5], [0, 60, 120, 180, 181, 10**15, -7], sorted(rng.integers(0, 10**9, 50).tolist())):
        assert X.times_decode(X.times_encode(t)) == t
        assert X.varint_decode(X.varint_encode(t)) == t
    n = X.huffman_lengths({0: 45, 1: 13, 2: 12, 3: 16, 4: 9, 5: 5})
    assert sum(n[s] * c for s, c in {0: 45, 1: 13, 2: 12, 3: 16, 4: 9, 5: 5}.items()) == 224
    codes = X.canonical_codes(n)
    assert len({c for c in codes.values()}) == 6
    assert np.allclose(X.inverse_dct(X.dct([i * i for i in range(8)])), [i * i for i in range(8)])


def test_formulas(spark):
    row = spark.range(1).select(F.lit(4.0).alias("x"), F.lit(0.0).alias("z"))
    value = lambda f: row.select(compile_formula(f).alias("v")).first()["v"]
    assert value("2 + 3 * 4") == 14 and value("5 > 3 && 2 < 10") == 1 and value("Abs(-42)") == 42 and value("Min(10, 5, 8)") == 5 and value("If(1, 100, 200)") == 100
    assert value("-|x ^ 2") == -16 and value("2 ^ 3 ^ 2") == 512 and value("|x / |z") is None and value("0 || !|z") == 1
    assert validate("1 +") and validate("Foo(1)") and validate("1 2") and validate("2 * (3 + |x)") is None
    with pytest.raises(FormulaError):
        compile_formula("Sqrt(1, 2)")


def test_query_spec(spark):
    with pytest.raises(SpecError) as e:
        QuerySpec(start_us=5, end_us=5).validate()
    assert e.value.code == -3
    p = series(spark, [(i, i) for i in range(10)])
    spec = QuerySpec(tag_ids=(1,), start_us=2 * SEC, end_us=8 * SEC, min_value=3.0, limit=3, descending=True)
    p.createOrReplaceTempView("points")
    text, args = spec.sql()
    assert [r["value"] for r in spec.retrieve(p).collect()] == [7.0, 6.0, 5.0] == [r["value"] for r in spark.sql(text, args=args).collect()]


def test_tree(spark):
    t = spark.createDataFrame([("a", None, "A", None), ("b", "a", "B", 2.0), ("c", "a", "C", None), ("d", "c", "D", 4.0)], "id string, parent string, name string, value double")
    assert {r["id"]: r["rolled"] for r in H.rollup(t, t.select("id", "value")).collect()} == {"a": 6.0, "b": 2.0, "c": 4.0, "d": 4.0}
    assert {r["id"]: r["path"] for r in H.paths(t).collect()}["d"] == "A\\C\\D"
    pairs = spark.createDataFrame([("b", "d")], "x string, y string")
    assert one(H.lowest_common_ancestors(t, pairs), "lca") == "a"


def test_scalars(spark):
    r = spark.range(1).select(
        S.scale_range(F.lit(12.0), F.lit(4.0), F.lit(20.0), F.lit(0.0), F.lit(100.0)).alias("a"), S.scale_width(F.lit(12.0), F.lit(4.0), F.lit(16.0), F.lit(0.0), F.lit(100.0)).alias("b"),
        S.nice_step(F.lit(93.0), 10).alias("c"), Q.name(F.lit(0x80)).alias("d"), S.unix_to_filetime(F.lit(0)).alias("e"), F.regexp_like(F.lit("a/b"), S.topic_regex(F.lit("a/+"))).alias("f")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (50.0, 50.0, 10.0, "UNKNOWN", 116_444_736_000_000_000, True)


def test_archive(spark, tmp_path):
    p = spark.range(100).selectExpr("id % 2 AS tag_id", "id DIV 2 * 3600000000L AS us", "id AS seq", "id * 1.5D AS value", "192 AS quality")
    archive.append(p, str(tmp_path / "a"))
    got = archive.scan(spark, str(tmp_path / "a"), (1,), 0, 24 * 3_600_000_000 - 1)
    assert got.count() == 24
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()


def test_build_levels_of_long_chains(spark):
    ids = lambda n: spark.range(n).select("id")
    chain = ids(70).where("id > 0").select("id", (F.col("id") - 1).alias("needed"))
    more = spark.createDataFrame([(69, 0), (69, 0), (71, 70)], "id long, needed long")  # a shorter way, and a node by itself
    got = {r["id"]: r["level"] for r in G.build_levels(ids(72), chain.union(more)).collect()}
    assert got == {i: i for i in range(70)} | {70: 0, 71: 1}
    with pytest.raises(ValueError, match="cycle"):
        G.build_levels(ids(6), spark.createDataFrame([(1, 0), (2, 1), (3, 2), (2, 3), (4, 5), (5, 4)], "id long, needed long"))


def test_build_levels_of_all_parts(spark, sf):
    import duckdb

    from tidemark.plans import q_more, registry

    whole = registry.oracle_sql()["build_levels"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    want, parts = dict(con.execute(whole).fetchall()), {x for (x,) in con.execute("SELECT p_partkey FROM part").fetchall()}
    got = {r["id"]: r["level"] for r in q_more._levels(spark, sf).collect()}
    assert set(got) == parts and max(got.values()) == 49
    assert got == want
