"""Record functions on texts and values at their edges."""

from pyspark.sql import functions as F

from tidemark.functions import records as R


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_iso_texts(spark):
    texts = ["1970-01-01T00:00:01Z", "1970-01-01 00:00:01.5", "1970-01-01T05:30:00+05:30", "1969-12-31T23:59:59.999999Z", "1970-01-01", "1970-13-01T00:00:00Z", "", "x", None]
    got = [v for (v,) in values(spark, [(t,) for t in texts], "t string", R.iso_micros(F.col("t")))]
    assert got == [1_000_000, 1_500_000, 0, -1, None, None, None, None, None]


def test_status_words(spark):
    got = values(spark, [("GOOD",), ("COMM_FAILURE",), ("?",), (None,)], "q string", R.status_word(F.col("q")))
    assert got == [(0,), (0x80310000,), (0x80000000,), (0x80000000,)]
    words = [0, 0x80310000, 0xC0000000, 0x40800000, 0x00080000, None]
    assert [v for (v,) in values(spark, [(w,) for w in words], "w bigint", R.status_quality(F.col("w")))] == ["GOOD", "BAD", "BAD", "UNCERTAIN", "QUESTIONABLE", None]


def test_attribute_sets_and_texts(spark):
    sets = [(["a", "b"], ["b", "c"]), ([], []), (["a", "a"], ["a"]), (["a"], [])]
    assert [round(v, 6) for (v,) in values(spark, sets, "a array<string>, b array<string>", R.jaccard(F.col("a"), F.col("b")))] == [0.333333, 0.0, 1.0, 0.0]
    got = values(spark, [("x{1}", None)], "a string, b string", R.build_text("{0}-{1}-{7}", [F.col("a"), F.col("b")]))
    assert got[0][0].endswith("-{7}")


def test_ranges_and_moves(spark):
    rows = [(0, 5, 3, 9), (0, 5, 5, 9), (0, 5, 6, 9), (0, None, 1, 2)]
    first, last = R.range_meet(*(F.col(c) for c in "abcd"))
    got = values(spark, rows, "a long, b long, c long, d long", first, last)
    assert got[:3] == [(3, 5), (5, 5), (None, None)]
    assert values(spark, [(1_000_000,)], "t long", R.add_seconds(F.col("t"), F.lit(-1.25))) == [(-250_000,)]


def test_topics(spark):
    rows = [("a/b", True, True), ("a/+/c", False, True), ("a/#", False, True), ("#", False, True), ("a/#/b", False, False), ("a#", False, False), ("a/b+", False, False), ("", False, False)]
    for topic, plain, subscribed in rows:
        assert values(spark, [(topic,)], "t string", R.topic_valid(F.col("t")), R.topic_filter_valid(F.col("t"))) == [(plain, subscribed)], topic


def test_figures_at_edges(spark):
    from tidemark.operators import figures as G

    got = values(spark, [(0.0,), (3.0,), (-3.0,), (None,)], "z double", F.round(G.deadband_estimate(F.col("z")), 4))
    assert got[0] == (1.0,) and abs(got[1][0] - 370.4) < 1 and abs(got[2][0] - 0.5007) < 1e-3 and got[3] == (None,)
    points = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate([1, -2, 4, 0, 7])] + [(2, 0, 0, None)], "tag_id long, us long, seq long, value double")
    spectrum = G.dft(G.blocks(points, 4), 4)
    assert {r["k"]: (round(r["re"], 6), round(r["im"], 6)) for r in spectrum.collect()} == {0: (3, 0), 1: (-3, 2), 2: (7, 0), 3: (-3, -2)}
    assert [round(r["value"], 6) for r in G.inverse_dft(spectrum, 4).orderBy("i").collect()] == [1, -2, 4, 0]
    assert [tuple(r) for r in G.reconstruction(points, F.col("value")).collect()] == [(1, 0.0, 0.0, 200.0)]
    stones = spark.createDataFrame([(1, 2), (1, 3)], "tag_id long, us long")
    assert [(r["tag_id"], r["us"]) for r in G.compact(points, stones, "tag_id").orderBy("tag_id").collect()] == [(1, 4), (2, 0)]
