"""SQL of rules that look both ways over a series, and of chains of frames."""

from __future__ import annotations

from tidemark.points import DAY, HOUR, POINTS_SQL

_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"
_T = f"WITH RECURSIVE {POINTS_SQL}, n AS MATERIALIZED (SELECT tag_id, us, seq, value, row_number() {_O} AS r, (us - min(us) OVER (PARTITION BY tag_id)) / 1e6 AS t, count(*) OVER (PARTITION BY tag_id) AS m FROM p WHERE value IS NOT NULL)"


def split_sql(right_angle: bool) -> str:
    """Lines split at the farthest point, again and again, while that lies more than 20 off."""
    d = "abs(n.value - (x.value + (y.value - x.value) * CASE WHEN y.t <> x.t THEN (n.t - x.t) / (y.t - x.t) ELSE 0 END))"
    if right_angle:
        d = f"{d} * CASE WHEN y.t <> x.t THEN abs(y.t - x.t) / sqrt((y.t - x.t) * (y.t - x.t) + (y.value - x.value) * (y.value - x.value)) WHEN y.value <> x.value THEN 0 ELSE 1 END"
    return f"""{_T}, s AS (SELECT DISTINCT tag_id, 1::BIGINT AS a, m AS b FROM n UNION ALL
SELECT tag_id, unnest([a, c]), unnest([c, b]) FROM (SELECT s.tag_id, s.a, s.b, arg_max(n.r, struct_pack(d := {d}, r := -n.r)) AS c FROM s JOIN n ON n.tag_id = s.tag_id AND n.r > s.a AND n.r < s.b JOIN n x ON x.tag_id = s.tag_id AND x.r = s.a JOIN n y ON y.tag_id = s.tag_id AND y.r = s.b
  GROUP BY s.tag_id, s.a, s.b HAVING max({d}) > 20))
SELECT n.tag_id, us, seq, value FROM n WHERE EXISTS (SELECT 1 FROM s WHERE s.tag_id = n.tag_id AND (s.a = n.r OR s.b = n.r))"""


#: One point of each of 20 runs: the largest triangle to the one before and the mean of the run after.
TRIANGLE = f"""{_T}, c AS (SELECT DISTINCT tag_id, m FROM n), e AS (SELECT tag_id, m, k, CASE WHEN k = 18 THEN m - 1 ELSE CAST(trunc(k * ((m - 2) / 18::DOUBLE) + 1) AS BIGINT) END AS at FROM c, range(19) f(k) WHERE m > 20),
g AS (SELECT x.tag_id, x.k, x.at AS lo, y.at AS hi, CASE WHEN x.k < 17 THEN y.at ELSE x.m - 1 END AS nlo, coalesce(z.at, x.m) AS nhi FROM e x JOIN e y ON y.tag_id = x.tag_id AND y.k = x.k + 1 LEFT JOIN e z ON z.tag_id = x.tag_id AND z.k = x.k + 2),
h AS MATERIALIZED (SELECT g.tag_id, g.k, lo, hi, avg(t) AS ct, avg(value) AS cv FROM g JOIN n ON n.tag_id = g.tag_id AND n.r - 1 >= nlo AND n.r - 1 < nhi GROUP BY g.tag_id, g.k, lo, hi),
w AS (SELECT DISTINCT tag_id, -1::BIGINT AS k, 1::BIGINT AS a FROM e UNION ALL SELECT w.tag_id, w.k + 1, arg_max(n.r, struct_pack(d := abs((x.t - ct) * (n.value - x.value) - (x.t - n.t) * (cv - x.value)), r := -n.r)) FROM w JOIN h ON h.tag_id = w.tag_id AND h.k = w.k + 1 JOIN n x ON x.tag_id = w.tag_id AND x.r = w.a JOIN n ON n.tag_id = w.tag_id AND n.r - 1 >= lo AND n.r - 1 < hi GROUP BY w.tag_id, w.k)
SELECT n.tag_id, us, seq, value FROM n WHERE m <= 20 OR r = m OR EXISTS (SELECT 1 FROM w WHERE w.tag_id = n.tag_id AND w.a = n.r)"""

#: The cheapest knot goes while all points stay within 20 of the lines.
BOTTOM = f"""{_T}, k AS (SELECT tag_id, list(r ORDER BY r) AS s FROM n GROUP BY tag_id UNION ALL
SELECT tag_id, list_filter(any_value(s), lambda x: x <> arg_min(i, struct_pack(c := cost, i := i))) FROM (
  SELECT q.tag_id, q.s, q.i, max(abs(n.value - (x.value + (y.value - x.value) * CASE WHEN y.t <> x.t THEN (n.t - x.t) / (y.t - x.t) ELSE 0 END))) AS cost
  FROM (SELECT tag_id, s, s[j] AS i, s[j - 1] AS a, s[j + 1] AS b FROM (SELECT tag_id, s, unnest(range(2, len(s))) AS j FROM k)) q
  JOIN n x ON x.tag_id = q.tag_id AND x.r = q.a JOIN n y ON y.tag_id = q.tag_id AND y.r = q.b JOIN n ON n.tag_id = q.tag_id AND n.r > q.a AND n.r < q.b GROUP BY q.tag_id, q.s, q.i) GROUP BY tag_id HAVING min(cost) <= 20)
SELECT n.tag_id, us, seq, value FROM n JOIN (SELECT tag_id, arg_min(s, len(s)) AS s FROM k GROUP BY tag_id) l ON l.tag_id = n.tag_id AND list_contains(l.s, n.r)"""
_R = 6 * HOUR

#: Density clusters by reach and at least three points.
CLUSTERS = f"""WITH {POINTS_SQL}, c AS (SELECT tag_id, us, seq, count(*) OVER (PARTITION BY tag_id ORDER BY us RANGE BETWEEN {_R} PRECEDING AND {_R} FOLLOWING) >= 3 AS core FROM p),
b AS (SELECT *, last_value(CASE WHEN core THEN us END IGNORE NULLS) {_O[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN core THEN us END IGNORE NULLS) {_O[:-1]} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM c),
i AS (SELECT *, CAST(sum(CASE WHEN core AND (before IS NULL OR us - before > {_R}) THEN 1 ELSE 0 END) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id FROM b),
j AS (SELECT *, CASE WHEN us - before <= {_R} THEN us - before END AS back, CASE WHEN after - us <= {_R} THEN after - us END AS ahead FROM i)
SELECT tag_id, us, seq, CASE WHEN core OR back IS NOT NULL AND (ahead IS NULL OR back <= ahead) THEN id WHEN ahead IS NOT NULL THEN id + CASE WHEN before IS NULL OR after - before > {_R} THEN 1 ELSE 0 END ELSE 0 END AS cluster, core FROM j"""

_KNOTS = f"""WITH RECURSIVE {POINTS_SQL}, q AS (SELECT tag_id, unnest(range(min(us) + ((-min(us)) % {DAY} + {DAY}) % {DAY}, max(us) + 1, {DAY})) AS q_us FROM p GROUP BY tag_id),
u AS (SELECT tag_id, us, value AS v FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag_id, us ORDER BY seq DESC) = 1),
n AS MATERIALIZED (SELECT tag_id, us, v, (us - min(us) OVER (PARTITION BY tag_id)) / 1e6 AS t, min(us) OVER (PARTITION BY tag_id) AS o, row_number() OVER (PARTITION BY tag_id ORDER BY us) AS r, count(*) OVER (PARTITION BY tag_id) AS m FROM u),
h AS MATERIALIZED (SELECT x.tag_id, x.r, x.m, x.us, x.o, x.t, x.v, y.t AS t2, y.v AS v2, y.t - x.t AS h, (y.v - x.v) / (y.t - x.t) AS d FROM n x JOIN n y ON y.tag_id = x.tag_id AND y.r = x.r + 1)"""
_AT = "FROM q ASOF JOIN h ON q.tag_id = h.tag_id AND q.q_us >= h.us"

#: Natural cubic spline: elimination forward and back substitution over the inner knots.
SPLINE = f"""{_KNOTS}, f AS (SELECT x.tag_id, y.r, 2 * (x.h + y.h) AS b, 6 * (y.d - x.d) AS c FROM h x JOIN h y ON y.tag_id = x.tag_id AND y.r = x.r + 1 WHERE x.r = 1
UNION ALL SELECT f.tag_id, y.r, 2 * (x.h + y.h) - x.h / f.b * x.h, 6 * (y.d - x.d) - x.h / f.b * f.c FROM f JOIN h x ON x.tag_id = f.tag_id AND x.r = f.r JOIN h y ON y.tag_id = f.tag_id AND y.r = f.r + 1),
s AS (SELECT DISTINCT tag_id, m AS r, 0.0::DOUBLE AS k FROM n UNION ALL SELECT s.tag_id, s.r - 1, CASE WHEN s.r > 2 THEN (f.c - h.h * s.k) / f.b ELSE 0 END FROM s JOIN h ON h.tag_id = s.tag_id AND h.r = s.r - 1 LEFT JOIN f ON f.tag_id = s.tag_id AND f.r = s.r - 1 WHERE s.r > 1)
SELECT q.tag_id, q.q_us, round((a.k * (t2 - (q_us - o) / 1e6) ^ 3 + b.k * ((q_us - o) / 1e6 - t) ^ 3) / (6 * h) + (v / h - a.k * h / 6) * (t2 - (q_us - o) / 1e6) + (v2 / h - b.k * h / 6) * ((q_us - o) / 1e6 - t), 3) + 0.0 AS value
{_AT} JOIN s a ON a.tag_id = h.tag_id AND a.r = h.r JOIN s b ON b.tag_id = h.tag_id AND b.r = h.r + 1"""

#: Akima's tangents from the slopes of five segments, two more added at each end.
AKIMA = f"""{_KNOTS}, e AS (SELECT tag_id, r, d FROM h UNION ALL SELECT x.tag_id, 0, 2 * x.d - y.d FROM h x JOIN h y ON y.tag_id = x.tag_id AND x.r = 1 AND y.r = 2 UNION ALL SELECT x.tag_id, -1, 3 * x.d - 2 * y.d FROM h x JOIN h y ON y.tag_id = x.tag_id AND x.r = 1 AND y.r = 2
UNION ALL SELECT x.tag_id, x.m, 2 * x.d - y.d FROM h x JOIN h y ON y.tag_id = x.tag_id AND x.r = x.m - 1 AND y.r = x.m - 2 UNION ALL SELECT x.tag_id, x.m + 1, 3 * x.d - 2 * y.d FROM h x JOIN h y ON y.tag_id = x.tag_id AND x.r = x.m - 1 AND y.r = x.m - 2),
w AS (SELECT tag_id, r, d, lag(d) OVER z AS d1, lag(d, 2) OVER z AS d2, lead(d) OVER z AS d3 FROM e WINDOW z AS (PARTITION BY tag_id ORDER BY r)),
g AS (SELECT tag_id, r, CASE WHEN abs(d3 - d) + abs(d1 - d2) = 0 THEN (d1 + d) / 2 ELSE (abs(d3 - d) * d1 + abs(d1 - d2) * d) / (abs(d3 - d) + abs(d1 - d2)) END AS k FROM w WHERE r >= 1)
SELECT q.tag_id, q.q_us, round(v + y * (a.k + y * ((3 * d - 2 * a.k - b.k) / h + y * ((a.k + b.k - 2 * d) / (h * h)))), 3) + 0.0 AS value
FROM (SELECT q.*, h.r, h.v, h.d, h.h, (q_us - o) / 1e6 - t AS y {_AT}) q JOIN g a ON a.tag_id = q.tag_id AND a.r = q.r JOIN g b ON b.tag_id = q.tag_id AND b.r = q.r + 1"""


def chains_sql(frames: str, window: int) -> str:
    """Chains along the strongest causal link out of each frame, from frames that none enters."""
    return f"""WITH RECURSIVE {frames}, j AS (SELECT x.id AS a, y.id AS b, greatest(0.0::DOUBLE, 1 - greatest(0, y.start_us - coalesce(x.end_us, x.start_us)) / {window}) AS temporal, x.template = y.template AS st, x.severity = y.severity AS ss
FROM f x JOIN f y ON x.tag_id = y.tag_id AND (x.start_us < y.start_us OR x.start_us = y.start_us AND x.id < y.id) AND y.start_us - x.start_us <= {window}),
l AS (SELECT a, b, 0.35::DOUBLE * temporal + 0.25::DOUBLE * st::INT + CASE WHEN ss THEN 0.075::DOUBLE ELSE 0.0::DOUBLE END AS strength FROM j WHERE temporal > 0.7),
s AS MATERIALIZED (SELECT a, b FROM l WHERE strength >= 0.1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY strength DESC, b) = 1),
c AS (SELECT a AS source, [a, b] AS events, b AS last FROM s WHERE a NOT IN (SELECT b FROM l WHERE strength >= 0.1) UNION ALL SELECT source, list_append(events, s.b), s.b FROM c JOIN s ON s.a = c.last WHERE NOT list_contains(events, s.b))
SELECT source, array_to_string(events, '>') AS events, CAST(len(events) AS INTEGER) AS length FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY len(events) DESC) = 1"""
