"""Registered queries: segments, description lengths, run rules, significance of lags, full links, spectra, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import correlate as L
from tidemark.operators import intervals as V
from tidemark.operators import runs as R
from tidemark.operators import search as S
from tidemark.operators import segments as G
from tidemark.operators import spectral as W
from tidemark.operators.cut import cut
from tidemark.plans.q_series import _FRAMES_SQL, _TREE_SQL, _frames, _tree
from tidemark.plans.registry import register
from tidemark.points import DAY, POINTS_SQL, from_events, r6

_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"


def _lines(tolerances: str) -> str:
    """Recursive SQL of the segments of each series and tolerance; c_ columns are the segment that a point closed."""
    return f"""WITH RECURSIVE {POINTS_SQL}, n AS MATERIALIZED (SELECT tag_id, us, value, row_number() OVER (PARTITION BY tag_id ORDER BY us) AS r FROM (SELECT * FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag_id, us ORDER BY seq DESC) = 1)),
tol AS (SELECT unnest([{tolerances}])::DOUBLE AS tol),
d AS (SELECT tag_id, tol, r, us AS a_us, value AS a_v, us AS l_us, value AS l_v, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1 AS m, 0.0::DOUBLE AS tt, 0.0::DOUBLE AS tv, 0.0::DOUBLE AS vv,
  NULL::BIGINT AS c_us, NULL::DOUBLE AS c_v, NULL::BIGINT AS c_end, NULL::DOUBLE AS c_end_v, NULL::BIGINT AS c_m, NULL::DOUBLE AS c_sse FROM n, tol WHERE r = 1
UNION ALL SELECT tag_id, tol, r, na_us, na_v, us, v, greatest(CASE WHEN brk THEN '-inf'::DOUBLE ELSE lo END, (v - na_v - tol) / t), least(CASE WHEN brk THEN 'inf'::DOUBLE ELSE hi END, (v - na_v + tol) / t),
  CASE WHEN brk THEN 1 ELSE m END + 1, CASE WHEN brk THEN 0 ELSE tt END + t * t, CASE WHEN brk THEN 0 ELSE tv END + t * (v - na_v), CASE WHEN brk THEN 0 ELSE vv END + (v - na_v) * (v - na_v),
  CASE WHEN brk THEN a_us END, CASE WHEN brk THEN a_v END, CASE WHEN brk THEN l_us END, CASE WHEN brk THEN l_v END, CASE WHEN brk THEN m END, CASE WHEN brk THEN sse END
  FROM (SELECT *, (us - na_us) / 1e6 AS t, greatest(0, vv - 2 * sl * tv + sl * sl * tt) AS sse FROM (SELECT *, CASE WHEN brk THEN l_us ELSE a_us END AS na_us, CASE WHEN brk THEN l_v ELSE a_v END AS na_v, (l_v - a_v) / ((l_us - a_us) / 1e6) AS sl
    FROM (SELECT d.*, n.us, n.value AS v, d.m > 1 AND NOT ((n.value - a_v) / ((n.us - a_us) / 1e6) BETWEEN lo AND hi) AS brk FROM (SELECT tag_id, tol, r + 1 AS r, a_us, a_v, l_us, l_v, lo, hi, m, tt, tv, vv FROM d) d JOIN n USING (tag_id, r)))) x),
s AS (SELECT tag_id, tol, c_us AS start_us, c_v AS start_value, c_end AS end_us, c_end_v AS end_value, c_m AS n, c_sse AS sse FROM d WHERE c_us IS NOT NULL
UNION ALL SELECT tag_id, tol, a_us, a_v, l_us, l_v, m, greatest(0, vv - 2 * sl * tv + sl * sl * tt) FROM (SELECT *, (l_v - a_v) / ((l_us - a_us) / 1e6) AS sl FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tag_id, tol ORDER BY r DESC) = 1) WHERE m > 1))"""


@register("sliding_segments", f"{_lines('20')} SELECT tag_id, start_us, start_value, end_us, end_value, n, round(sse, 4) + 0.0 AS sse FROM s")
def _segments(spark, sf_dir):
    return G.sliding_window(from_events(spark, sf_dir), 20.0).withColumn("sse", r6(F.col("sse"), 4))


_TOLERANCES = [2.0, 5.0, 10.0, 20.0, 40.0, 80.0]


@register("description_lengths", f"""{_lines(', '.join(map(str, _TOLERANCES)))}, g AS (SELECT s.tag_id, tol AS tolerance, count(*) AS segments, k.n, sum(sse) AS sse FROM s JOIN (SELECT tag_id, count(*) AS n FROM n GROUP BY tag_id) k ON k.tag_id = s.tag_id GROUP BY s.tag_id, tol, k.n),
b AS (SELECT *, segments * log2(n) * 2 + n / 2 * log2(greatest(1e-24, sse / n)) AS bits FROM g)
SELECT tag_id, tolerance, segments, n, round(sse, 3) + 0.0 AS sse, round(bits, 5) + 0.0 AS bits, row_number() OVER (PARTITION BY tag_id ORDER BY round(bits, 9), tolerance DESC) = 1 AS best FROM b""")
def _bits(spark, sf_dir):
    return G.description_lengths(from_events(spark, sf_dir), _TOLERANCES).withColumns({"sse": r6(F.col("sse"), 3), "bits": r6(F.col("bits"), 5)})


@register("swab_knots")
def _swab(spark, sf_dir):
    return G.swab(from_events(spark, sf_dir), 20.0)


_Z = f"""{POINTS_SQL}, l AS (SELECT tag_id, avg(value) AS c, stddev_pop(value) AS s FROM p WHERE value IS NOT NULL GROUP BY tag_id), z AS (SELECT p.tag_id, us, seq, value, CASE WHEN s > 0 THEN (value - c) / s END AS z FROM p JOIN l ON p.tag_id = l.tag_id WHERE value IS NOT NULL),
f AS (SELECT *, coalesce(abs(z) > 3, false) AS beyond_3,
  coalesce(z > 2 AND count_if(z > 2) {_O[:-1]} ROWS 2 PRECEDING) >= 2 OR z < -2 AND count_if(z < -2) {_O[:-1]} ROWS 2 PRECEDING) >= 2, false) AS two_of_3,
  coalesce(z > 1 AND count_if(z > 1) {_O[:-1]} ROWS 4 PRECEDING) >= 4 OR z < -1 AND count_if(z < -1) {_O[:-1]} ROWS 4 PRECEDING) >= 4, false) AS four_of_5,
  coalesce(z > 0 AND count_if(z > 0) {_O[:-1]} ROWS 7 PRECEDING) >= 8 OR z < 0 AND count_if(z < 0) {_O[:-1]} ROWS 7 PRECEDING) >= 8, false) AS eight_in_row FROM z)"""


@register("run_rules", f"WITH {_Z} SELECT tag_id, us, seq, value, round(z, 6) + 0.0 AS z, beyond_3, two_of_3, four_of_5, eight_in_row FROM f")
def _rules(spark, sf_dir):
    return R.run_rules(from_events(spark, sf_dir)).withColumn("z", r6(F.col("z")))


@register("run_rule_rollup", f"""WITH RECURSIVE {_TREE_SQL}, {_Z}, v AS (SELECT 'c:' || tag_id AS id, count_if(beyond_3 OR two_of_3 OR four_of_5 OR eight_in_row) AS flagged FROM f GROUP BY tag_id)
SELECT c.ancestor AS id, count(v.id) AS n, CAST(sum(flagged) AS DOUBLE) AS total FROM c LEFT JOIN v ON v.id = c.id GROUP BY c.ancestor""")
def _rule_rollup(spark, sf_dir):
    """Flagged points of all series at or below each element; a customer's series is the one of its number."""
    v = R.violations(R.run_rules(from_events(spark, sf_dir)))
    values = v.select(F.concat(F.lit("c:"), "tag_id").alias("id"), F.col("flagged").cast("double").alias("value"))
    return V.subtree_sums(V.labels(_tree(spark, sf_dir)), values).select("id", "n", "total")


@register("lag_significance", f"""WITH {_FRAMES_SQL}, t AS (SELECT tag_id, start_us, substr(template, 1, 1) AS k FROM f), c AS (SELECT tag_id, CAST(count_if(k = '1') AS BIGINT) AS causes, CAST(count_if(k = '2') AS BIGINT) AS effects, max(start_us) - min(start_us) AS span FROM t GROUP BY tag_id),
j AS (SELECT x.tag_id, count(*) AS pairs FROM t x JOIN t y ON x.tag_id = y.tag_id AND x.k = '1' AND y.k = '2' AND y.start_us BETWEEN x.start_us AND x.start_us + {90 * DAY} GROUP BY x.tag_id),
e AS (SELECT c.tag_id, causes, effects, coalesce(pairs, 0) AS pairs, causes * effects * least(1.0::DOUBLE, {90 * DAY} / greatest(1000000, span)) AS expected FROM c LEFT JOIN j ON j.tag_id = c.tag_id WHERE causes > 0 AND effects > 0),
q AS (SELECT *, CASE WHEN pairs = 0 THEN 1.0::DOUBLE ELSE 1 - list_sum(list_transform(range(0, pairs), lambda i: exp(-expected + i * ln(expected) - lgamma(i + 1)))) END AS p FROM e)
SELECT tag_id, causes, effects, pairs, round(expected, 6) + 0.0 AS expected, round(greatest(p, 0), 6) + 0.0 AS p, pairs > 2 * expected AND p < 0.05 AS causal FROM q""")
def _lags(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("template", F.substring("template", 1, 1))
    return L.lag_significance(f, "1", "2", 90 * DAY).withColumns({"expected": r6(F.col("expected")), "p": r6(F.col("p"))})


_ATTRS_SQL = f"""{_FRAMES_SQL}, av AS (SELECT l_orderkey AS id, list(DISTINCT x) AS s FROM (SELECT l_orderkey, unnest(['flag=' || l_returnflag, 'tax=' || CAST(round(l_tax * 100) AS INTEGER), 'line=' || l_linenumber]) AS x FROM lineitem) GROUP BY l_orderkey),
g AS (SELECT f.*, coalesce(av.s, []) AS s FROM f LEFT JOIN av USING (id)),
j AS (SELECT x.id AS a, y.id AS b, greatest(0.0::DOUBLE, 1 - greatest(0, y.start_us - coalesce(x.end_us, x.start_us)) / {30 * DAY}) AS by_time, CASE WHEN len(list_distinct(x.s || y.s)) > 0 THEN len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) ELSE 0 END AS by_attributes,
  (x.template = y.template)::INT::DOUBLE AS by_template, CASE WHEN x.severity = y.severity THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS by_severity
  FROM g x JOIN g y ON x.tag_id = y.tag_id AND (x.start_us < y.start_us OR x.start_us = y.start_us AND x.id < y.id) AND y.start_us - x.start_us <= {30 * DAY}),
k AS (SELECT *, 0.35::DOUBLE * by_time + 0.25::DOUBLE * by_attributes + 0.25::DOUBLE * by_template + 0.15::DOUBLE * by_severity AS strength, by_time > 0.7 AS causal FROM j), m AS (SELECT * FROM k WHERE strength >= 0.1::DOUBLE)"""


def _with_attributes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.array(F.concat(F.lit("flag="), "l_returnflag"), F.concat(F.lit("tax="), F.round(F.col("l_tax") * 100).cast("int").cast("string")), F.concat(F.lit("line="), F.col("l_linenumber").cast("string")))
    sets = li.select(F.col("l_orderkey").alias("id"), F.explode(text).alias("x")).groupBy("id").agg(F.collect_set("x").alias("attributes"))
    return _frames(spark, sf_dir).join(sets, "id", "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))


@register("frame_links", f"WITH {_ATTRS_SQL} SELECT a, b, round(by_time, 6) + 0.0 AS by_time, round(by_attributes, 6) + 0.0 AS by_attributes, by_template, by_severity, round(strength, 6) + 0.0 AS strength, causal FROM m")
def _links(spark, sf_dir):
    return L.links(_with_attributes(spark, sf_dir), 30 * DAY).withColumns({c: r6(F.col(c)) for c in ("by_time", "by_attributes", "strength")})


@register("related_frames", f"""WITH {_ATTRS_SQL}, b AS (SELECT a AS id, b AS other, round(strength, 9) AS strength FROM m UNION ALL SELECT b, a, round(strength, 9) FROM m)
SELECT b.id, other, round(b.strength, 6) + 0.0 AS strength, CAST(row_number() OVER (PARTITION BY b.id ORDER BY b.strength DESC, other) AS INTEGER) AS place FROM b JOIN f ON f.id = b.id WHERE f.severity = 1 QUALIFY place <= 3""")
def _related(spark, sf_dir):
    f = _with_attributes(spark, sf_dir)
    linked = L.links(f, 30 * DAY).withColumn("strength", F.round("strength", 9))
    return L.related(linked, f.where("severity = 1"), 3).withColumn("strength", r6(F.col("strength")))


@register("link_summary", f"WITH {_ATTRS_SQL} SELECT (SELECT count(*) FROM f) AS frames, count(*) AS links, round(avg(strength), 6) + 0.0 AS average_strength, CAST(count_if(causal) AS BIGINT) AS causal_links FROM m")
def _summary(spark, sf_dir):
    f = _with_attributes(spark, sf_dir)
    return L.summary(f, L.links(f, 30 * DAY)).withColumn("average_strength", r6(F.col("average_strength")))


_N, _KEEP, _STEP = 32, 8, 0.25
_SPECTRUM = f"""{POINTS_SQL}, q AS (SELECT tag_id, us, seq, value, row_number() {_O} - 1 AS r FROM p WHERE value IS NOT NULL), b AS (SELECT tag_id, value, r, unnest([r // {_N // 2}, r // {_N // 2} + 1]) AS block FROM q),
w AS (SELECT tag_id, block, r - (block - 1) * {_N // 2} AS i, value * sin(pi() * (r - (block - 1) * {_N // 2} + 0.5) / {_N}) AS x FROM b),
c AS (SELECT tag_id, block, k, sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {_N}) * sum(x * cos(pi() * (i + 0.5) * k / {_N})) AS c FROM w, range({_N}) f(k) GROUP BY tag_id, block, k),
l AS (SELECT tag_id, block, k, CAST(round(c / {_STEP}) AS BIGINT) AS level FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY tag_id, block ORDER BY abs(c) DESC, k) <= {_KEEP}) WHERE round(c / {_STEP}) <> 0)"""


@register("spectral_blocks", f"WITH {_SPECTRUM} SELECT tag_id, block, CAST(k AS INTEGER) AS k, level FROM l")
def _blocks(spark, sf_dir):
    b = W.compress(from_events(spark, sf_dir), _N, _KEEP, _STEP)
    return b.select("tag_id", "block", F.explode(F.arrays_zip(F.col("places").alias("k"), F.col("levels").alias("level"))).alias("e")).select("tag_id", "block", F.col("e.k").alias("k"), F.col("e.level").alias("level"))


@register("spectral_roundtrip", f"""WITH {_SPECTRUM}, y AS (SELECT b.tag_id, b.r, sum(sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {_N}) * level * {_STEP} * cos(pi() * (r - (b.block - 1) * {_N // 2} + 0.5) * k / {_N}) * sin(pi() * (r - (b.block - 1) * {_N // 2} + 0.5) / {_N})) AS v
FROM b JOIN l ON l.tag_id = b.tag_id AND l.block = b.block GROUP BY b.tag_id, b.r) SELECT q.tag_id, us, seq, round(coalesce(v, 0), 6) + 0.0 AS value, true AS within FROM q LEFT JOIN y ON y.tag_id = q.tag_id AND y.r = q.r""")
def _roundtrip(spark, sf_dir):
    """All values back from their blocks, and whether each is within the bound that its blocks state."""
    p = from_events(spark, sf_dir)
    back = W.decompress(cut(W.compress(p, _N, _KEEP, _STEP)), p, _N, _STEP)
    j = back.join(p.select("tag_id", "seq", F.col("value").alias("_a")), ["tag_id", "seq"])
    return j.select("tag_id", "us", "seq", r6(F.col("value")).alias("value"), (F.abs(F.col("value") - F.col("_a")) <= F.col("bound") + 1e-9).alias("within"))


@register("window_weighted", f"""WITH {POINTS_SQL}, q AS (SELECT tag_id, us, seq, value, row_number() {_O} - 1 AS r FROM p WHERE value IS NOT NULL), g AS (SELECT *, r // 16 AS run, r % 16 AS i, count(*) OVER (PARTITION BY tag_id, r // 16) - 1 AS top FROM q)
SELECT tag_id, us, seq, run, round(value * CASE WHEN top = 0 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * i / nullif(top, 0)) END, 6) + 0.0 AS value FROM g""")
def _weighted(spark, sf_dir):
    return W.weighted(from_events(spark, sf_dir), "hann", 16).withColumn("value", r6(F.col("value")))


_GRAMS = "CASE WHEN {0} IS NULL THEN NULL ELSE list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr(' ' || lower({0}) || ' ', i, 3))) END"
_SEARCH_SQL = f"""e AS (SELECT 'p:' || p_partkey AS id, p_name AS name, p_type AS template, [p_brand] AS categories FROM part UNION ALL SELECT 'c:' || c_custkey, c_name, c_mktsegment, ['NATION_' || c_nationkey, 'customer'] FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', ['NATION_' || s_nationkey] FROM supplier),
w AS (SELECT n_nationkey AS query_id, 'customer #' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 9, '0') AS name, NULL AS template, CASE WHEN n_nationkey % 2 = 0 THEN 'customer' END AS category FROM nation
  UNION ALL SELECT 100 + n_nationkey, NULL, CASE WHEN n_nationkey % 3 > 0 THEN 'supplier' END, CASE WHEN n_nationkey % 3 < 2 THEN n_name END FROM nation
  UNION ALL SELECT 1000 + CAST(substr(p_brand, 7) AS INTEGER) * 10 + p_size % 10, substr(min(p_name), 2), CASE WHEN p_size % 2 = 0 THEN min(p_type) END, CASE WHEN p_size % 3 = 0 THEN p_brand END FROM part WHERE p_size <= 10 GROUP BY p_brand, p_size),
q AS (SELECT *, {_GRAMS.format('name')} AS g FROM w), x AS (SELECT *, {_GRAMS.format('name')} AS h FROM e),
m AS (SELECT q.query_id, x.id, CASE WHEN q.g IS NOT NULL THEN len(list_intersect(g, h)) / len(g) END AS share, q.template, q.category FROM q JOIN x ON (g IS NULL OR len(list_intersect(g, h)) >= ceil(len(g) * 0.6::DOUBLE)) AND (q.template IS NULL OR q.template = x.template) AND (q.category IS NULL OR list_contains(x.categories, q.category))),
a AS (SELECT query_id, id, share, (coalesce(share, 0) + CASE WHEN template IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN category IS NOT NULL THEN 0.9::DOUBLE ELSE 0 END) / ((share IS NOT NULL)::INT + (template IS NOT NULL)::INT + (category IS NOT NULL)::INT) AS relevance FROM m)"""


@register("relevance_search", f"WITH {_SEARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, id) AS place FROM a) SELECT query_id, id, round(share, 6) + 0.0 AS share, round(relevance, 6) + 0.0 AS relevance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def _search(spark, sf_dir):
    """The ten most relevant of all parts, customers and suppliers for a query of each nation, brand and size."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    elements = (
        t("part").select(text("p:", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("template"), F.array("p_brand").alias("categories"))
        .unionByName(t("customer").select(text("c:", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("template"), F.array(text("NATION_", "c_nationkey"), F.lit("customer")).alias("categories")))
        .unionByName(t("supplier").select(text("s:", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("template"), F.array(text("NATION_", "s_nationkey")).alias("categories"))))
    n, k, none = t("nation"), F.col("n_nationkey"), F.lit(None).cast("string")
    size = F.col("p_size")
    queries = (
        n.select(k.alias("query_id"), F.concat(F.lit("customer #"), F.lpad((k * 7).cast("string"), 9, "0")).alias("name"), none.alias("template"), F.when(k % 2 == 0, "customer").alias("category"))
        .unionByName(n.select((k + 100).alias("query_id"), none.alias("name"), F.when(k % 3 > 0, "supplier").alias("template"), F.when(k % 3 < 2, F.col("n_name")).alias("category")))
        .unionByName(t("part").where("p_size <= 10").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("_n"), F.min("p_type").alias("_t")).select(
            (1000 + F.substring("p_brand", 7, 9).cast("int") * 10 + size % 10).alias("query_id"), F.expr("substring(_n, 2)").alias("name"), F.when(size % 2 == 0, F.col("_t")).alias("template"), F.when(size % 3 == 0, F.col("p_brand")).alias("category"))))
    lists, counts = S.index(elements)
    found = S.search(elements, cut(lists), cut(counts), queries).withColumn("relevance", F.round("relevance", 9))
    return S.by_relevance(found, 10).select("query_id", "id", r6(F.col("share")).alias("share"), r6(F.col("relevance")).alias("relevance"), "place")
