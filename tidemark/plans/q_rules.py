"""Registered queries: rules over several tags, day summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import multitag as M
from tidemark.operators import summaries as D
from tidemark.operators.cut import cut
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, POINTS_SQL, from_events, r6

RULES = {
    "hot": "tag('a') + tag('b') > 100 AND tag('c') < 60", "ratio": "tag('a') / tag('b') >= 2 OR tag('c') == tag('a')",
    "spread": "(tag('a') - tag(\"b\")) * 2 > tag('c') + 5", "pair": "tag('a') > tag('b')"}


@register("multi_tag_rules", f"""WITH {POINTS_SQL}, k AS (SELECT tag_id // 3 AS element, tag_id % 3 AS role, us, value FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag_id, us ORDER BY seq DESC) = 1),
ka AS (SELECT * FROM k WHERE role = 0), kb AS (SELECT * FROM k WHERE role = 1), kc AS (SELECT * FROM k WHERE role = 2),
t AS (SELECT DISTINCT element, us, role < 2 AS ab FROM k), j AS (SELECT t.element, t.us, t.ab, ka.value AS a, kb.value AS b, kc.value AS c FROM t ASOF LEFT JOIN ka ON t.element = ka.element AND t.us >= ka.us
  ASOF LEFT JOIN kb ON t.element = kb.element AND t.us >= kb.us ASOF LEFT JOIN kc ON t.element = kc.element AND t.us >= kc.us),
e AS (SELECT DISTINCT 'hot' AS rule, element, us, a + b > 100 AND c < 60 AS fired FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
UNION ALL SELECT DISTINCT 'ratio', element, us, CASE WHEN b = 0 THEN 0 ELSE a / b END >= 2 OR abs(c - a) < 1e-9 FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
UNION ALL SELECT DISTINCT 'spread', element, us, (a - b) * 2 > c + 5 FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
UNION ALL SELECT DISTINCT 'pair', element, us, a > b FROM j WHERE ab AND a IS NOT NULL AND b IS NOT NULL)
SELECT rule, element, us, CAST(fired AS DOUBLE) AS result, fired, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY rule, element ORDER BY us), false) AS rises FROM e""")
def _rules(spark, sf_dir):
    """Tags in groups of three, the elements, each with the roles a, b and c; four rules at every element."""
    p = from_events(spark, sf_dir)
    t = F.col("tag_id")
    role = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (t % 3 + 1).cast("int"))
    bindings = p.select("tag_id").distinct().select(F.explode(F.array(*map(F.lit, RULES))).alias("rule"), F.floor(t / 3).alias("element"), role.alias("name"), "tag_id")
    return M.evaluate(p, RULES, bindings)


_START, _END = 1704240000000000 + 7 * HOUR + 13 * 60_000_000, 1705708800000000 + 19 * HOUR + 1
_W = "WINDOW w AS (PARTITION BY tag_id ORDER BY us, seq)"


@register("range_from_day_states", f"""WITH {POINTS_SQL}, r AS (SELECT *, lead(us) OVER w AS nu, lead(value) OVER w AS nv FROM p WHERE us >= {_START} AND us < {_END} {_W})
SELECT tag_id, count(*) AS n, min(value) AS minimum, max(value) AS maximum, round(sum(value), 4) + 0.0 AS total, round(avg(value), 9) + 0.0 AS average, round(stddev_pop(value), 5) + 0.0 AS stddev,
round(coalesce(sum((value + nv) / 2 * (nu - us) / 1e6), 0), 2) + 0.0 AS integral, round(coalesce(sum((value + nv) / 2 * (nu - us)) / nullif(sum(CASE WHEN value + nv IS NOT NULL THEN nu - us END), 0), arg_min(value, struct_pack(u := us, s := seq))), 5) + 0.0 AS time_average,
round(avg(CASE WHEN (quality & 192) = 192 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS percent_good, arg_min(value, struct_pack(u := us, s := seq)) AS first, arg_max(value, struct_pack(u := us, s := seq)) AS last, max(us) - min(us) AS span_us FROM r GROUP BY tag_id""")
def _range(spark, sf_dir):
    """A range that cuts two days, from stored states of the days between and raw points of the two."""
    p = from_events(spark, sf_dir)
    out = D.over_range(cut(D.day_states(p)), p, _START, _END)
    digits = {"total": 4, "average": 9, "stddev": 5, "integral": 2, "time_average": 5, "percent_good": 6}
    return out.withColumns({c: r6(F.col(c), d) for c, d in digits.items()})


@register("day_states", f"""WITH {POINTS_SQL}, d AS (SELECT *, us - us % {DAY} AS day FROM p), r AS (SELECT *, lead(us) OVER w AS nu, lead(value) OVER w AS nv FROM d WINDOW w AS (PARTITION BY tag_id, day ORDER BY us, seq))
SELECT tag_id, day, count(*) AS n, count(value) AS valued, count(*) FILTER (WHERE (quality & 192) = 192) AS good, round(sum(value), 4) + 0.0 AS total, round(sum(value * value), 5) + 0.0 AS squares, min(value) AS low, max(value) AS high,
round(sum((value + nv) / 2 * (nu - us) / 1e6), 3) + 0.0 AS area, min(us) AS first_us, max(us) AS last_us FROM r GROUP BY tag_id, day""")
def _day_states(spark, sf_dir):
    s = D.day_states(from_events(spark, sf_dir))
    return s.select("tag_id", "day", "n", "valued", "good", r6(F.col("total"), 4).alias("total"), r6(F.col("squares"), 5).alias("squares"), "low", "high", r6(F.col("area"), 3).alias("area"), F.col("first.us").alias("first_us"), F.col("last.us").alias("last_us"))
