"""Rules over several tags, and day summaries that merge, against plain Python and raw points."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import multitag as M
from tidemark.operators import summaries as D
from tidemark.plans.expression import FormulaError, references
from tidemark.points import DAY, HOUR, from_events


def test_references_and_tag_syntax():
    assert references("tag('a') + tag(\"b c\") * tag(d) > |e AND 'f' < tag('a')") == ["a", "b c", "d", "e", "f"]
    for bad in ("tag()", "tag('a'", "tag(+)", "tag"):
        with pytest.raises(FormulaError):
            references(bad)


def points_of(spark, rows):
    return spark.createDataFrame(rows, "tag_id long, us long, seq long, value double")


def fired(df):
    return [(r["rule"], r["element"], r["us"], r["fired"], r["rises"]) for r in df.orderBy("rule", "element", "us").collect()]


def test_rules_by_hand(spark):
    p = points_of(spark, [(1, 10, 1, 5.0), (2, 20, 2, 3.0), (1, 30, 3, 2.0), (2, 30, 4, 0.0), (1, 40, 5, 4.0), (1, 40, 6, None), (1, 130, 7, 1.0), (2, 150, 8, 9.0), (3, 35, 9, 7.0)])
    b = spark.createDataFrame([("gt", 1, "x", 1), ("gt", 1, "y", 2), ("gt", 2, "x", 3), ("gt", 2, "y", 2), ("div", 1, "x", 1), ("div", 1, "y", 2), ("unknown", 1, "x", 1), ("gt", 3, "x", 1)], "rule string, element int, name string, tag_id long")
    rules = {"gt": "tag('x') > tag('y')", "div": "tag('x') / tag('y') >= 1"}
    want = [
        ("div", 1, 20, True, True), ("div", 1, 30, False, False), ("div", 1, 40, False, False), ("div", 1, 130, False, False), ("div", 1, 150, False, False),
        ("gt", 1, 20, True, True), ("gt", 1, 30, True, False), ("gt", 1, 40, True, False), ("gt", 1, 130, True, False), ("gt", 1, 150, False, False),
        ("gt", 2, 35, True, True), ("gt", 2, 150, False, False)]
    for chunk in (7, 100, DAY):  # chunks carry over what came before
        assert fired(M.evaluate(p, rules, b, chunk)) == want
    assert M.evaluate(p.limit(0), rules, b).count() == 0
    with pytest.raises(ValueError):
        M.evaluate(p, {"no tag": "1 > 0"}, b)


def test_rule_numbers(spark):
    p = points_of(spark, [(1, 10, 1, 0.3), (2, 10, 2, 0.1 + 0.2), (3, 10, 3, 0.4)])
    b = spark.createDataFrame([(r, 1, n, i) for r in ("eq", "half", "zero") for n, i in (("a", 1), ("b", 2), ("c", 3))], "rule string, element int, name string, tag_id long")
    rules = {"eq": "tag('a') == tag('b') AND NOT tag('a') != tag('b')", "half": "tag('c') OR tag('a')", "zero": "tag('a') / (tag('c') - tag('c')) == 0"}
    assert {(r["rule"], r["fired"]) for r in M.evaluate(p, rules, b).collect()} == {("eq", True), ("half", False), ("zero", True)}


# Day summaries


def close(a, b):
    rows = [{r["tag_id"]: r.asDict() for r in x.collect()} for x in (a, b)]
    assert rows[0].keys() == rows[1].keys()
    for k, r in rows[0].items():
        for c, v in r.items():
            assert v == (pytest.approx(rows[1][k][c], rel=1e-9, abs=1e-6) if isinstance(v, float) else rows[1][k][c]), (k, c)


@pytest.mark.parametrize("start,end", [(0, 40 * DAY), (3 * HOUR, 5 * DAY - HOUR), (2 * DAY, 6 * DAY), (DAY + HOUR, DAY + 9 * HOUR), (DAY + HOUR, 2 * DAY + 1), (100 * DAY, 101 * DAY)])
def test_ranges_from_states_equal_raw(spark, sf, start, end):
    p = from_events(spark, sf)
    t0 = p.agg(F.min("us")).first()[0] // DAY * DAY
    states = D.day_states(p)
    raw = D.merge(D.day_states(p.where(F.col("us").between(t0 + start, t0 + end - 1)), width=400 * DAY))
    close(D.over_range(states, p, t0 + start, t0 + end), raw)


def test_whole_days_are_not_read_again(spark, sf):
    p = from_events(spark, sf)
    t0 = p.agg(F.min("us")).first()[0] // DAY * DAY
    states = D.day_states(p)
    a, b = t0 + 3 * HOUR, t0 + 9 * DAY + HOUR
    inner = F.col("us").between(t0 + DAY, t0 + 9 * DAY - 1)
    close(D.over_range(states, p.where(~inner), a, b), D.over_range(states, p, a, b))


def test_states_with_nulls_and_equal_times(spark):
    rows = [(1, 5, 1, 2.0, 192), (1, 5, 2, None, 0), (1, DAY + 5, 3, 4.0, 192), (1, DAY + 10, 4, 6.0, 64), (1, DAY + 10, 5, 8.0, 192), (2, 7, 6, None, 0)]
    p = spark.createDataFrame(rows, "tag_id long, us long, seq long, value double, quality int")
    got = {r["tag_id"]: r for r in D.merge(D.day_states(p)).collect()}
    assert got[1]["n"] == 5 and got[1]["average"] == 5.0 and got[1]["integral"] == pytest.approx(5 * 5e-6) and got[1]["first"] == 2.0 and got[1]["last"] == 8.0
    assert got[2]["average"] is None and got[2]["time_average"] is None and got[2]["integral"] == 0.0
    assert D.merge(D.day_states(p.limit(0))).count() == 0


def test_late_points_change_their_days_only(spark, sf):
    p = from_events(spark, sf)
    late = p.where("seq % 97 = 0")
    before = D.day_states(p.join(late.select("seq"), "seq", "left_anti").select(*p.columns))
    close(D.merge(D.refresh(before, p, late)), D.merge(D.day_states(p)))
