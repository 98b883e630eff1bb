"""Segments, run rules, chances, links, spectra and search against plain Python, with edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.chance import log_factorial, poisson_tail
from tidemark.operators import correlate as L
from tidemark.operators import runs as R
from tidemark.operators import search as S
from tidemark.operators import segments as G
from tidemark.operators import spectral as W
from tidemark.operators.compress import bottom_up_mask
from tidemark.points import from_events


def points_of(spark, values, tag=1, step=1_000_000):
    return spark.createDataFrame([(tag, i * step, i, v, 192) for i, v in enumerate(values)], "tag_id long, us long, seq long, value double, quality int")


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return np.round(np.cumsum(rng.normal(size=n)), 3).tolist()


# Segments


def greedy(v, tolerance, longest=None):
    """Segments by looking at every point between, as the rule says it."""
    out, a, i = [], 0, 2
    def off(a, b):  # noqa: E306
        return max((abs(v[j] - (v[a] + (v[b] - v[a]) * (j - a) / (b - a))) for j in range(a + 1, b)), default=0.0)
    while i < len(v):
        if off(a, i) > tolerance or (longest and i - a >= longest):
            out.append((a, i - 1))
            a = i - 1
            i = a + 2
        else:
            i += 1
    if a < len(v) - 1:
        out.append((a, len(v) - 1))
    return out


@pytest.mark.parametrize("tolerance,longest", [(0.5, None), (2.0, None), (2.0, 5), (0.0, None), (1e9, None)])
def test_sliding_window_is_the_greedy_rule(spark, tolerance, longest):
    v = walk(400, 3)
    got = sorted((r["start_us"] // 1_000_000, r["end_us"] // 1_000_000, r["n"], r["sse"]) for r in G.sliding_window(points_of(spark, v), tolerance, longest).collect())
    want = greedy(v, tolerance + 1e-12, longest)
    assert [(a, b, n) for a, b, n, _ in got] == [(a, b, b - a + 1) for a, b in want]
    for a, b, _, sse in got:
        line = np.linspace(v[a], v[b], b - a + 1)
        assert sse == pytest.approx(float(((np.array(v[a : b + 1]) - line) ** 2).sum()), abs=1e-6)
    ends = G.segment_points(G.sliding_window(points_of(spark, v), tolerance, longest))
    assert ends.count() == 2 * len(want)


def test_segment_edges(spark):
    assert G.sliding_window(points_of(spark, []), 1.0).count() == 0 and G.sliding_window(points_of(spark, [5.0]), 1.0).count() == 0
    assert G.swab(points_of(spark, []), 1.0).count() == 0 and G.swab(points_of(spark, [5.0, None]), 1.0).count() == 1
    equal = spark.createDataFrame([(1, 0, 0, 9.0), (1, 0, 1, 1.0), (1, 10, 2, 2.0)], "tag_id long, us long, seq long, value double")
    assert [r["start_value"] for r in G.sliding_window(equal, 1.0).collect()] == [1.0]
    with pytest.raises(ValueError):
        G.swab(equal, 1.0, 2)


def swab_by_hand(v, tolerance, buffer):
    keep, a = [0], 0
    while True:
        b = min(len(v), a + buffer)
        knots = a + np.flatnonzero(bottom_up_mask(np.arange(b - a, dtype=float), np.array(v[a:b]), tolerance))
        if b - a < buffer:
            return sorted({*keep, *knots.tolist()})
        a = int(knots[1])
        keep.append(a)


@pytest.mark.parametrize("n,buffer", [(500, 50), (500, 7), (50, 50), (49, 50), (51, 50)])
def test_swab_by_hand(spark, n, buffer):
    v = walk(n, n)
    got = sorted(r["seq"] for r in G.swab(points_of(spark, v), 1.0, buffer).collect())
    assert got == swab_by_hand(v, 1.0, buffer)
    knots = np.interp(range(n), got, [v[i] for i in got])
    assert np.abs(knots - v).max() <= 1.0 + 1e-9  # every point is within the tolerance of the line


def test_swab_runs_a_long_series_in_a_bounded_buffer(spark):
    flat = spark.range(60_000).select(F.lit(1).cast("long").alias("tag_id"), (F.col("id") * 1000).alias("us"), F.col("id").alias("seq"), F.sin(F.col("id") / 3000).alias("value"))
    assert 1000 < G.swab(flat, 0.01, 40).count() < 3000


def test_description_lengths(spark):
    v = walk(300, 8)
    p = points_of(spark, v)
    got = {r["tolerance"]: r for r in G.description_lengths(p, [0.5, 2.0, 8.0]).collect()}
    for t, r in got.items():
        s = G.sliding_window(p, t).agg(F.count("*").alias("k"), F.sum("sse").alias("e")).first()
        assert (r["segments"], r["n"]) == (s["k"], 300) and r["sse"] == pytest.approx(s["e"])
        assert r["bits"] == pytest.approx(s["k"] * math.log2(300) * 2 + 150 * math.log2(max(1e-24, s["e"] / 300)))
    assert [t for t, r in got.items() if r["best"]] == [min(got, key=lambda t: got[t]["bits"])]
    assert G.description_lengths(points_of(spark, [1.0]), [1.0]).count() == 0


# Run rules


def test_run_rules_by_hand(spark):
    limits = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 0.0)], "tag_id long, centre double, deviation double")
    v = [3.5, -3.5, 2.5, 0.1, 2.5, -2.5, 1.5, 1.5, -0.5, 1.5, 1.5, *[0.2] * 8, -0.2]
    got = {r["seq"]: r for r in R.run_rules(points_of(spark, v), limits).collect()}
    flagged = lambda name: [i for i in range(len(v)) if got[i][name]]
    assert flagged("beyond_3") == [0, 1]
    assert flagged("two_of_3") == [2, 4]  # 3.5 and 2.5; 2.5 and 2.5
    assert flagged("four_of_5") == [10]
    assert flagged("eight_in_row") == [16, 17, 18]
    assert R.run_rules(points_of(spark, v, tag=2), limits).where("beyond_3 or two_of_3 or z is not null").count() == 0
    assert R.run_rules(points_of(spark, [])).count() == 0
    n = R.violations(R.run_rules(points_of(spark, v), limits)).first()
    assert (n["n"], n["beyond_3"], n["eight_in_row"], n["flagged"]) == (20, 2, 3, 8)


# Chances


def test_poisson_tail(spark):
    cases = [(k, m) for m in (0.01, 0.5, 3.0, 30.0, 400.0) for k in {0, 1, 2, int(m), int(m) + 1, int(m + 3 * math.sqrt(m)), max(0, int(m - 3 * math.sqrt(m))), int(2 * m) + 9}]
    df = spark.createDataFrame(cases, "k long, m double")
    got = {(r["k"], r["m"]): r["p"] for r in df.select("k", "m", poisson_tail(F.col("k"), F.col("m")).alias("p")).collect()}
    for k, m in cases:
        upper = math.fsum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k, k + 3000))
        assert got[k, m] == pytest.approx(upper, rel=1e-9, abs=1e-14), (k, m)
    big = spark.range(1).select(poisson_tail(F.lit(1_000_000).cast("long"), F.lit(1e6)).alias("a"), poisson_tail(F.lit(5).cast("long"), F.lit(0.0)).alias("b"), poisson_tail(F.lit(1_010_000).cast("long"), F.lit(1e6)).alias("c")).first()
    assert big["a"] == pytest.approx(0.500133, abs=1e-6) and big["b"] is None and 0 < big["c"] < 1e-20
    n = spark.range(200).select("id", log_factorial(F.col("id")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-12, abs=1e-12) for r in n)


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "id long, tag_id long, start_us long, end_us long, template string, severity int, attributes array<string>")


def test_lags_by_hand(spark):
    s = 1_000_000
    rows = [(i, 1, t * s, None, k, 1, []) for i, (t, k) in enumerate([(0, "a"), (0, "b"), (5, "b"), (6, "a"), (10, "a"), (16, "b"), (17, "b"), (100, "x")])]
    rows += [(50, 2, 0, None, "a", 1, [])]
    got = L.lag_significance(frames_of(spark, rows), "a", "b", 10 * s).collect()
    pairs = sum(0 <= tb - ta <= 10 for ta in (0, 6, 10) for tb in (0, 5, 16, 17))
    assert len(got) == 1 and (got[0]["causes"], got[0]["effects"], got[0]["pairs"]) == (3, 4, pairs)
    assert got[0]["expected"] == pytest.approx(3 * 4 * 10 / 100) and got[0]["causal"] == (pairs > 2.4 and got[0]["p"] < 0.05)


def test_links_by_hand(spark):
    f = frames_of(spark, [(1, 1, 0, 10, "t", 2, ["x=1", "y=2"]), (2, 1, 20, None, "t", 2, ["x=1"]), (3, 1, 90, None, "u", 1, []), (4, 2, 0, None, "t", 2, ["x=1"]), (5, 1, 500, None, "u", 1, [])])
    got = {(r["a"], r["b"]): r for r in L.links(f, 100, 0.0).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    assert got[1, 2]["strength"] == pytest.approx(0.35 * 0.9 + 0.25 * 0.5 + 0.25 + 0.15 * 0.5) and got[1, 2]["causal"]
    assert got[2, 3]["strength"] == pytest.approx(0.35 * 0.3) and not got[2, 3]["causal"]
    near = [(r["id"], r["other"], r["place"]) for r in L.related(L.links(f, 100, 0.0), spark.createDataFrame([(2,), (5,)], "id long")).orderBy("place").collect()]
    assert near == [(2, 1, 1), (2, 3, 2)]
    assert L.summary(f, L.links(f, 100, 0.0)).first()["links"] == 3 and L.summary(f, L.links(f.limit(0), 100)).first()["average_strength"] is None


# Spectra


def test_all_coefficients_give_all_values_back(spark):
    for n in (1, 5, 16, 33):
        v = walk(n, n)
        p = points_of(spark, v)
        b = W.compress(p, 16, 16, 1e-9)
        back = {r["seq"]: r["value"] for r in W.decompress(b, p, 16, 1e-9).collect()}
        assert [back[i] for i in range(n)] == pytest.approx(v, abs=1e-7)


def test_errors_stay_within_their_bounds(spark, sf):
    p = from_events(spark, sf)
    for keep, step in ((2, 0.5), (8, 4.0), (32, 0.1)):
        b = W.compress(p, 32, keep, step)
        j = W.decompress(b, p, 32, step).join(p.select("tag_id", "seq", F.col("value").alias("a")), ["tag_id", "seq"])
        assert j.count() == p.where("value is not null").count() and j.where("abs(value - a) > bound + 1e-9").isEmpty()
        f = W.figures(p, W.decompress(b, p, 32, step), b).agg(F.max("rmse").alias("rmse"), F.min("ratio").alias("ratio")).first()
        assert f["ratio"] > 0 and (keep < 32 or f["rmse"] < 0.1)
    with pytest.raises(ValueError):
        W.compress(p, 15)
    assert W.compress(p.limit(0)).count() == 0


def test_rows_of_blocks_are_not_broadcast(spark, sf, tmp_path):
    p = from_events(spark, sf)
    W.compress(p).write.parquet(f"{tmp_path}/blocks")
    back = W.decompress(spark.read.parquet(f"{tmp_path}/blocks"), p)
    assert "BroadcastExchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == p.where("value is not null").count()


# Search


ELEMENTS = [("a", "Pump Station 1", "pump", ["north", "wet"]), ("b", "Pump Station 2", "pump", ["south"]), ("c", "Boiler", "boiler", []), ("d", None, "pump", None), ("e", "pump", None, ["north"]), ("f", "", "x", ["north"])]


def find(spark, queries, least=0.6):
    e = spark.createDataFrame(ELEMENTS, "id string, name string, template string, categories array<string>")
    q = spark.createDataFrame(queries, "query_id int, name string, template string, category string")
    return sorted((r["query_id"], r["id"], round(r["relevance"], 6)) for r in S.search(e, *S.index(e), q, least).collect())


def test_search_criteria(spark):
    assert find(spark, [(1, "pump station 1", None, None)], 0.99) == [(1, "a", 1.0)]
    assert {x[1] for x in find(spark, [(1, "pump station", None, None)])} == {"a", "b"}
    assert find(spark, [(1, None, "pump", None)]) == [(1, "a", 1.0), (1, "b", 1.0), (1, "d", 1.0)]
    assert find(spark, [(1, None, None, "north")]) == [(1, "a", 0.9), (1, "e", 0.9), (1, "f", 0.9)]
    assert find(spark, [(1, None, "pump", "north"), (2, "PUMP", None, "north"), (3, "PUMP", "pump", "south")]) == [(1, "a", 0.95), (2, "a", 0.95), (2, "e", 0.95), (3, "b", round(2.9 / 3, 6))]
    assert find(spark, [(1, None, None, None), (2, "zebra", None, None), (3, "", None, None)]) == []


def test_search_finds_what_sharing_finds(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(2, 9)))
    names = [f"unit {word()}" for _ in range(300)]
    e = spark.createDataFrame([(str(i), n, None, []) for i, n in enumerate(names)], "id string, name string, template string, categories array<string>")
    asks = [f"unit {word()}" for _ in range(40)]
    q = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(asks)], "query_id int, name string, template string, category string")
    grams = lambda t: {f" {t.lower()} "[i : i + 3] for i in range(len(t))}
    for least in (0.3, 0.6, 1.0):
        want = sorted((i, str(j)) for i, a in enumerate(asks) for j, n in enumerate(names) if len(grams(a) & grams(n)) >= math.ceil(len(grams(a)) * least))
        assert sorted((r["query_id"], r["id"]) for r in S.search(e, *S.index(e), q, least).collect()) == want
