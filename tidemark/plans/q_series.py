"""Registered queries: interpolation, retrieval, hierarchy, event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalar as S
from tidemark.operators import frames as E
from tidemark.operators import hierarchy as H
from tidemark.operators import interpolate as I
from tidemark.plans import sql_series as Y
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, POINTS_SQL, from_events, micros, r6

_O = "OVER (PARTITION BY tag_id ORDER BY us)"
_GRID = f"g AS (SELECT tag_id, unnest(range(min(us) + ((-min(us)) % {6 * HOUR} + {6 * HOUR}) % {6 * HOUR}, max(us) + 1, {6 * HOUR})) AS q_us FROM p GROUP BY tag_id)"
_KNOTS = f"""k AS (SELECT tag_id, us AS t1, value AS v1, lag(us) {_O} AS t0, lag(value) {_O} AS v0, lead(us) {_O} AS t2, lead(value) {_O} AS v2,
  lead(us, 2) {_O} AS t3, lead(value, 2) {_O} AS v3 FROM p WHERE value IS NOT NULL)"""
_ASOF = f"WITH {POINTS_SQL}, {_GRID}, {_KNOTS}, j AS (SELECT g.tag_id, q_us, t0, v0, t1, v1, t2, v2, t3, v3 FROM g ASOF LEFT JOIN k ON g.tag_id = k.tag_id AND g.q_us >= k.t1)"
_LINE = "v1 + (v2 - v1) * (q_us - t1) / (t2 - t1)"
_SQL = {
    "step": "v1",
    "linear": f"CASE WHEN t2 IS NOT NULL THEN {_LINE} WHEN q_us = t1 THEN v1 ELSE coalesce(v0 + (v1 - v0) * (q_us - t0) / (t1 - t0), v1) END",
    "next": "CASE WHEN t1 = q_us THEN v1 ELSE v2 END",
    "nearest": "CASE WHEN t2 IS NULL OR q_us - t1 <= t2 - q_us THEN v1 ELSE v2 END",
    "lagrange3": f"""CASE WHEN t0 IS NOT NULL AND t3 IS NOT NULL THEN v0 * ((q_us - t1) / (t0 - t1)) * ((q_us - t2) / (t0 - t2)) * ((q_us - t3) / (t0 - t3)) + v1 * ((q_us - t0) / (t1 - t0)) * ((q_us - t2) / (t1 - t2)) * ((q_us - t3) / (t1 - t3))
      + v2 * ((q_us - t0) / (t2 - t0)) * ((q_us - t1) / (t2 - t1)) * ((q_us - t3) / (t2 - t3)) + v3 * ((q_us - t0) / (t3 - t0)) * ((q_us - t1) / (t3 - t1)) * ((q_us - t2) / (t3 - t2))
      WHEN t2 IS NOT NULL THEN {_LINE} WHEN q_us = t1 THEN v1 ELSE coalesce(v0 + (v1 - v0) * (q_us - t0) / (t1 - t0), v1) END""",
}


def _interp(method: str, sql: str) -> None:
    @register(f"interp_{method}", f"{_ASOF} SELECT tag_id, q_us, round({sql}, 6) + 0.0 AS value FROM j")
    def query(spark, sf_dir):
        p = from_events(spark, sf_dir)
        return I.interpolate(p, I.grid(p, 6 * HOUR), method).withColumn("value", r6(F.col("value")))


for _m, _s in _SQL.items():
    _interp(_m, _s)

_H = "(t2 - t1)"
_HS = f"((q_us - t1) / {_H})"
_interp("hermite", f"""CASE WHEN t2 IS NOT NULL THEN (2 * {_HS} * {_HS} * {_HS} - 3 * {_HS} * {_HS} + 1) * v1 + ({_HS} * {_HS} * {_HS} - 2 * {_HS} * {_HS} + {_HS}) * {_H} * coalesce((v2 - v0) / (t2 - t0), (v2 - v1) / (t2 - t1))
  + (-2 * {_HS} * {_HS} * {_HS} + 3 * {_HS} * {_HS}) * v2 + ({_HS} * {_HS} * {_HS} - {_HS} * {_HS}) * {_H} * coalesce((v3 - v1) / (t3 - t1), (v2 - v1) / (t2 - t1))
  WHEN q_us = t1 THEN v1 ELSE coalesce(v0 + (v1 - v0) * (q_us - t0) / (t1 - t0), v1) END""")


@register("interp_quality_aware", f"""{_ASOF.replace('WHERE value IS NOT NULL', 'WHERE value IS NOT NULL AND (quality & 192) = 192')} SELECT tag_id, q_us, round(CASE WHEN t1 IS NULL THEN NULL ELSE v1 END, 6) + 0.0 AS value FROM j""")
def _quality_aware(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return I.interpolate(p, I.grid(p, 6 * HOUR), "step", good_only=True).withColumn("value", r6(F.col("value")))


@register("interp_spline", Y.SPLINE)
def _spline(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return I.smooth(p, I.grid(p, DAY), "spline").withColumn("value", r6(F.col("value"), 3))


@register("interp_akima", Y.AKIMA)
def _akima(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return I.smooth(p, I.grid(p, DAY), "akima").withColumn("value", r6(F.col("value"), 3))


@register("latest_snapshot", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, value, quality FROM p QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY us DESC, seq DESC) = 1")
def _snapshot(spark, sf_dir):
    return I.snapshot(from_events(spark, sf_dir))


@register("raw_retrieval", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, value, quality FROM p WHERE tag_id IN (3, 7, 11) AND us >= 1704240000000000 AND us < 1705000000000000")
def _raw(spark, sf_dir):
    from tidemark.plans.query_spec import QuerySpec

    return QuerySpec(tag_ids=(3, 7, 11), start_us=1704240000000000, end_us=1705000000000000).retrieve(from_events(spark, sf_dir))


@register("retrieval_page", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, value, quality FROM p WHERE (quality & 192) = 192 AND value BETWEEN 10 AND 60 ORDER BY us DESC, seq DESC LIMIT 100 OFFSET 50")
def _page(spark, sf_dir):
    from tidemark.plans.query_spec import QuerySpec

    return QuerySpec(good_only=True, min_value=10.0, max_value=60.0, limit=100, offset=50, descending=True).retrieve(from_events(spark, sf_dir))


@register("quality_filter", f"""WITH {POINTS_SQL} SELECT tag_id, us, seq, CASE quality & 192 WHEN 192 THEN 'GOOD' WHEN 64 THEN 'UNCERTAIN' WHEN 0 THEN 'BAD' ELSE 'UNKNOWN' END AS quality_name FROM p WHERE (quality & 192) <> 0""")
def _quality(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return p.where(~Q.is_bad(F.col("quality"))).select("tag_id", "us", "seq", Q.name(F.col("quality")).alias("quality_name"))


@register("glob_search", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*a?*e*'")
def _glob(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_name").rlike(S.glob_regex("*a?*e*"))).select("p_partkey", "p_name")


@register("topic_match", """WITH t AS (SELECT c_custkey, 'plant/' || c_mktsegment || '/' || c_custkey AS topic FROM customer), f AS (SELECT unnest(['plant/+/1', 'plant/#', 'plant/BUILDING/#', 'x/+']) AS filter)
SELECT filter, count(*) AS topics FROM t, f WHERE regexp_full_match(topic, replace(replace(filter, '+', '[^/]*'), '#', '.*')) GROUP BY filter""")
def _topics(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("/", F.lit("plant"), "c_mktsegment", "c_custkey").alias("topic"))
    filters = F.array(*map(F.lit, ["plant/+/1", "plant/#", "plant/BUILDING/#", "x/+"]))
    return c.select("topic", F.explode(filters).alias("filter")).where(F.regexp_like("topic", S.topic_regex(F.col("filter")))).groupBy("filter").agg(F.count("*").alias("topics"))


@register("eu_scaling", f"WITH {POINTS_SQL} SELECT seq, round(value * 16 / 100 + 4, 6) + 0.0 AS milliamps, round(least(greatest(value, 10), 90), 6) + 0.0 AS clamped, value BETWEEN 10 AND 90 AS in_span FROM p")
def _scaling(spark, sf_dir):
    v, n = F.col("value"), F.lit
    p = from_events(spark, sf_dir)
    return p.select("seq", r6(S.scale_range(v, n(0.0), n(100.0), n(4.0), n(20.0))).alias("milliamps"), r6(S.clamp(v, n(10.0), n(90.0))).alias("clamped"), S.in_span(v, n(10.0), n(90.0)).alias("in_span"))


@register("conversions", f"""WITH {POINTS_SQL} SELECT seq, round(2 + 3 * value, 6) + 0.0 AS linear, round(1 + 2 * sqrt(value), 6) + 0.0 AS root, round(1 + value * (0.5 + value * 0.25), 6) + 0.0 AS poly,
round(CASE WHEN value <= 0 THEN 0 WHEN value <= 50 THEN 10 * value / 50 WHEN value <= 100 THEN 10 + 30 * (value - 50) / 50 ELSE 40 END, 6) + 0.0 AS looked_up FROM p""")
def _conversions(spark, sf_dir):
    v = F.col("value")
    return from_events(spark, sf_dir).select(
        "seq", r6(S.convert("linear", v, 2.0, 3.0)).alias("linear"), r6(S.convert("sqrt", v, 1.0, 2.0)).alias("root"), r6(S.convert("polynomial", v, poly=(1.0, 0.5, 0.25))).alias("poly"),
        r6(S.convert("table", v, table=((0.0, 0.0), (50.0, 10.0), (100.0, 40.0)))).alias("looked_up"))


@register("iso_format", f"WITH {POINTS_SQL} SELECT seq, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((us // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM p")
def _iso(spark, sf_dir):
    return from_events(spark, sf_dir).select("seq", S.iso_millis(F.col("us")).alias("iso"))


@register("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("kpi_status", f"WITH {POINTS_SQL} SELECT seq, CASE WHEN value BETWEEN 20 AND 70 THEN 'GOOD' WHEN value BETWEEN 15 AND 75 THEN 'WARNING' ELSE 'BAD' END AS status FROM p")
def _kpi(spark, sf_dir):
    return from_events(spark, sf_dir).select("seq", S.kpi_status(F.col("value"), F.lit(20.0), F.lit(70.0)).alias("status"))


_TREE_SQL = """t AS (SELECT 'r:' || r_regionkey AS id, NULL AS parent, r_name AS name, NULL::DOUBLE AS value FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, n_name, NULL FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, c_name, c_acctbal FROM customer),
c AS (SELECT id AS ancestor, id, 0 AS distance FROM t UNION ALL SELECT t.parent, c.id, c.distance + 1 FROM c JOIN t ON c.ancestor = t.id WHERE t.parent IS NOT NULL)"""


def _tree(spark, sf_dir):
    r, n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k))
    none = F.lit(None).cast("double").alias("value")
    return (
        r.select(key("r:", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), none)
        .unionAll(n.select(key("n:", "n_nationkey"), key("r:", "n_regionkey"), F.col("n_name"), none))
        .unionAll(c.select(key("c:", "c_custkey"), key("n:", "c_nationkey"), F.col("c_name"), F.col("c_acctbal"))))


@register("tree_closure", f"WITH RECURSIVE {_TREE_SQL} SELECT * FROM c")
def _closure(spark, sf_dir):
    return H.closure(_tree(spark, sf_dir))


@register("tree_depth", f"WITH RECURSIVE {_TREE_SQL} SELECT id, max(distance) AS depth FROM c GROUP BY id")
def _depth(spark, sf_dir):
    return H.depths(_tree(spark, sf_dir))


@register("tree_leaves", f"WITH RECURSIVE {_TREE_SQL} SELECT id FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
def _leaves(spark, sf_dir):
    return H.leaves(_tree(spark, sf_dir))


@register("descendant_count", f"WITH RECURSIVE {_TREE_SQL} SELECT ancestor AS id, count(*) - 1 AS descendants FROM c GROUP BY ancestor")
def _descendants(spark, sf_dir):
    return H.descendants(_tree(spark, sf_dir))


@register("tree_paths", f"WITH RECURSIVE {_TREE_SQL} SELECT c.id, string_agg(t.name, '\\' ORDER BY distance DESC) AS path FROM c JOIN t ON c.ancestor = t.id GROUP BY c.id")
def _paths(spark, sf_dir):
    return H.paths(_tree(spark, sf_dir))


@register("tree_lca", f"""WITH RECURSIVE {_TREE_SQL}, q AS (SELECT 'c:' || c_custkey AS x, 'c:' || (c_custkey + 1) AS y FROM customer)
SELECT x, y, arg_min(a.ancestor, a.distance + b.distance) AS lca FROM q JOIN c a ON a.id = x JOIN c b ON b.id = y AND b.ancestor = a.ancestor GROUP BY x, y""")
def _lca(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pairs = c.select(F.concat(F.lit("c:"), "c_custkey").alias("x"), F.concat(F.lit("c:"), F.col("c_custkey") + 1).alias("y"))
    return H.lowest_common_ancestors(_tree(spark, sf_dir), pairs)


def _roll(method: str, sql: str) -> None:
    @register(f"rollup_{method}", f"WITH RECURSIVE {_TREE_SQL} SELECT c.ancestor AS id, round({sql}, 6) + 0.0 AS rolled FROM c JOIN t ON c.id = t.id GROUP BY c.ancestor")
    def query(spark, sf_dir):
        t = _tree(spark, sf_dir)
        return H.rollup(t, t.select("id", "value", F.length("name").cast("double").alias("w")), method, "w").withColumn("rolled", r6(F.col("rolled")))


for _m, _s in {"sum": "sum(value)", "average": "avg(value)", "min": "min(value)", "max": "max(value)", "worst": "min(least(100.0, value))", "stddev": "stddev_pop(value)",
               "weighted": "sum(value * length(name)) / nullif(sum(CASE WHEN value IS NOT NULL THEN length(name) END), 0)"}.items():
    _roll(_m, _s.replace("min(least(100.0, value))", "min(CASE WHEN value IS NOT NULL THEN least(100.0::DOUBLE, value) ELSE 100.0::DOUBLE END)"))


@register("rollup_children", f"WITH RECURSIVE {_TREE_SQL} SELECT parent AS id, round(avg(value), 6) + 0.0 AS rolled FROM t WHERE parent IS NOT NULL GROUP BY parent")
def _children(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return H.rollup_children(t.select("id", "parent"), t.select("id", "value")).withColumn("rolled", r6(F.col("rolled")))


_FRAMES_SQL = """f AS (SELECT o_orderkey AS id, o_custkey AS tag_id, epoch_us(o_orderdate) AS start_us, e AS end_us, o_orderpriority AS template, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS severity
FROM orders LEFT JOIN (SELECT l_orderkey, epoch_us(max(l_shipdate)) AS e FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _frames(spark, sf_dir):
    o, li = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ends = li.groupBy("l_orderkey").agg(micros(F.max("l_shipdate"), spark).alias("end_us"))
    return o.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tag_id"), micros(F.col("o_orderdate"), spark).alias("start_us"), "end_us", F.col("o_orderpriority").alias("template"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("severity"))


_A, _B = 788918400000000, 820454400000000


@register("frame_overlap", f"WITH {_FRAMES_SQL} SELECT id, template FROM f WHERE start_us <= {_B} AND coalesce(end_us, {_B}) >= {_A}")
def _overlap(spark, sf_dir):
    return E.overlapping(_frames(spark, sf_dir), _A, _B).select("id", "template")


@register("frame_stats", f"""WITH {_FRAMES_SQL}, d AS (SELECT *, CASE WHEN end_us > start_us THEN (end_us - start_us) / 1e6 END AS s FROM f WHERE start_us >= {_A} AND start_us < {_B})
SELECT severity, count(*) AS n, round(avg(s), 6) + 0.0 AS avg_s, min(s) AS min_s, max(s) AS max_s, count(DISTINCT template) AS templates FROM d GROUP BY severity""")
def _stats(spark, sf_dir):
    return E.statistics(_frames(spark, sf_dir), _A, _B).withColumn("avg_s", r6(F.col("avg_s")))


@register("correlation_links", f"""WITH {_FRAMES_SQL}, j AS (SELECT x.id AS a, y.id AS b, greatest(0.0::DOUBLE, 1 - greatest(0, y.start_us - coalesce(x.end_us, x.start_us)) / {30 * DAY}) AS temporal, x.template = y.template AS st, x.severity = y.severity AS ss
FROM f x JOIN f y ON x.tag_id = y.tag_id AND (x.start_us < y.start_us OR x.start_us = y.start_us AND x.id < y.id) AND y.start_us - x.start_us <= {30 * DAY})
SELECT a, b, round(0.35::DOUBLE * temporal + 0.25::DOUBLE * st::INT + CASE WHEN ss THEN 0.075::DOUBLE ELSE 0.0::DOUBLE END, 6) + 0.0 AS strength, temporal > 0.7 AS causal FROM j""")
def _links(spark, sf_dir):
    return E.correlation_links(_frames(spark, sf_dir), 30 * DAY, 0.0).withColumn("strength", r6(F.col("strength")))


@register("granger_pairs", f"""WITH {_FRAMES_SQL} SELECT x.tag_id, count(*) AS pairs FROM f x JOIN f y ON x.tag_id = y.tag_id AND x.template LIKE '1%' AND y.template LIKE '2%' AND y.start_us BETWEEN x.start_us AND x.start_us + {90 * DAY} GROUP BY x.tag_id""")
def _granger(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("template", F.substring("template", 1, 1))
    return E.lagged_pairs(f, "1", "2", 90 * DAY)


@register("retention_age", f"WITH {_FRAMES_SQL} SELECT id FROM f WHERE start_us >= {_A}")
def _age(spark, sf_dir):
    return E.retain_by_age(_frames(spark, sf_dir), _B, _B - _A).select("id")


@register("retention_count", f"WITH {_FRAMES_SQL} SELECT id, tag_id FROM f QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY start_us DESC, id DESC) <= 3")
def _count(spark, sf_dir):
    return E.retain_by_count(_frames(spark, sf_dir), 3).select("id", "tag_id")


@register("rule_match", f"""WITH {_FRAMES_SQL}, r AS (SELECT * FROM (VALUES (1, 3, NULL, ['ops', 'lead']), (2, 2, '2-HIGH', ['lab'])) AS v(rule_id, min_severity, rule_template, recipients))
SELECT id, rule_id, unnest(recipients) AS recipient FROM f JOIN r ON severity >= min_severity AND (rule_template IS NULL OR rule_template = template)""")
def _rules(spark, sf_dir):
    rules = spark.createDataFrame([(1, 3, None, ["ops", "lead"], True), (2, 2, "2-HIGH", ["lab"], True), (3, 1, None, ["off"], False)], "rule_id int, min_severity int, rule_template string, recipients array<string>, enabled boolean")
    return E.match_rules(_frames(spark, sf_dir), rules)


@register("frames_from_points", f"""WITH {POINTS_SQL}, n AS (SELECT *, lead(us) OVER (PARTITION BY tag_id ORDER BY us, seq) AS nu, value > 70 AS f FROM p),
s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY tag_id ORDER BY us, seq), false) THEN 1 ELSE 0 END AS st FROM n),
i AS (SELECT *, CAST(sum(st) OVER (PARTITION BY tag_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)
SELECT tag_id, island, min(us) AS start_us, max(coalesce(nu, us)) AS end_us, count(*) AS n, max(value) AS peak FROM i WHERE f GROUP BY tag_id, island""")
def _from_points(spark, sf_dir):
    return E.from_condition(from_events(spark, sf_dir), F.col("value") > 70)


@register("formula_if", f"WITH {POINTS_SQL} SELECT seq, round(CASE WHEN value > 50 AND NOT (quality = 0) THEN sqrt(value) * 2 ^ 2 ELSE greatest(value, 10) % 7 END, 6) + 0.0 AS result FROM p")
def _formula_if(spark, sf_dir):
    from tidemark.plans.expression import compile_formula

    return from_events(spark, sf_dir).select("seq", r6(compile_formula("If(|value > 50 && !(|quality == 0), Sqrt(|value) * 2 ^ 2, Max(|value, 10) % 7)")).alias("result"))


@register("formula_temp_f", f"WITH {POINTS_SQL} SELECT seq, round(value * 9 / 5 + 32, 6) + 0.0 AS result FROM p")
def _formula_f(spark, sf_dir):
    from tidemark.plans.expression import compile_formula

    return from_events(spark, sf_dir).select("seq", r6(compile_formula("'value' * 9 / 5 + 32")).alias("result"))
