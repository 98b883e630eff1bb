"""Registered queries: typed values, hashes and type maps, instances, unions, enumerations, updates, statistics, displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import quality as Q
from tidemark.functions import scalar as S
from tidemark.functions import values as V
from tidemark.operators import admin as M
from tidemark.operators import compress as C
from tidemark.operators import figures as G
from tidemark.operators import interpolate as I
from tidemark.operators import windows as W
from tidemark.plans.expression import compile_formula
from tidemark.plans.q_series import _ASOF, _LINE
from tidemark.plans.query_spec import QuerySpec
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, POINTS_SQL, from_events, r6

_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"
_KINDS = ["FLOAT64", "INT32", "BOOLEAN", "DIGITAL", "STRING"]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("typed_values", f"""WITH {POINTS_SQL}, k AS (SELECT p.*, {_KINDS}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1] AS kind FROM p JOIN events ON event_id = seq)
SELECT seq, kind, CASE WHEN kind = 'FLOAT64' THEN value ELSE 0 END AS as_float, CASE WHEN kind = 'INT32' THEN CAST(trunc(value) AS INTEGER) ELSE 0 END AS as_int, CASE WHEN kind = 'DIGITAL' THEN CAST(trunc(value) AS INTEGER) ELSE 0 END AS as_digital,
CASE WHEN quality = 0 THEN 'BAD' WHEN kind = 'FLOAT64' THEN rtrim(rtrim(printf('%.6f', value), '0'), '.') WHEN kind = 'INT32' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) WHEN kind = 'BOOLEAN' THEN CASE WHEN value <> 0 THEN 'true' ELSE 'false' END
  WHEN kind = 'DIGITAL' THEN 'enum(' || CAST(trunc(value) AS BIGINT) || ')' ELSE CAST(value AS VARCHAR) END AS text,
CASE WHEN quality = 0 THEN -1 WHEN kind IN ('INT32', 'DIGITAL') THEN trunc(value) WHEN kind = 'BOOLEAN' THEN CASE WHEN value <> 0 THEN 1 ELSE 0 END ELSE value END AS back FROM k""")
def _typed(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.get_json_object("props", "$.k").cast("int") % 5)
    p = from_events(spark, sf_dir).join(_t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind")), "seq")
    v, k = F.col("value"), F.col("kind")
    p = p.select("seq", "kind", V.as_float(v, k).alias("as_float"), V.as_int(v, k).alias("as_int"), V.as_digital(v, k).alias("as_digital"), V.to_text(v, k, ~Q.is_bad(F.col("quality"))).alias("text"))
    return p.withColumn("back", F.coalesce(V.from_text(F.col("text"), F.col("kind")), F.lit(-1.0)))


@register("value_changes", f"WITH {POINTS_SQL} SELECT seq, value IS DISTINCT FROM lag(value) {_O} AS value_changed, quality IS DISTINCT FROM lag(quality) {_O} AS quality_changed, row_number() {_O} = 1 OR value IS DISTINCT FROM lag(value) {_O} OR quality IS DISTINCT FROM lag(quality) {_O} AS any_changed FROM p")
def _changes(spark, sf_dir):
    from tidemark.points import ordered

    w, both = ordered(), F.struct("value", "quality")
    p = from_events(spark, sf_dir)
    return p.select("seq", V.changed(F.col("value"), F.lag("value").over(w)).alias("value_changed"), V.changed(F.col("quality"), F.lag("quality").over(w)).alias("quality_changed"), V.changed(both, F.lag(both).over(w)).alias("any_changed"))


_CODES = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS HUGEINT))"


@register("name_hashes", f"""WITH n AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS s FROM part UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier)
SELECT id, CAST(list_reduce(list_prepend(2166136261::HUGEINT, {_CODES}), lambda h, b: xor(h, b) * 16777619 % 4294967296) AS BIGINT) AS h32,
lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, {_CODES}), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616) AS UBIGINT))), 16, '0') AS h64 FROM n""")
def _hashes(spark, sf_dir):
    p, s = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    names = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("s")).unionByName(s.select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("s")))
    return names.select("id", V.fnv32(F.col("s")).alias("h32"), V.fnv64(F.col("s")).alias("h64"))


_TYPES = [*V.OTHER_TYPES, "BLOB"]
_MAPS = ", ".join(f"('{k}', {a}, {b}, {str(c).lower()})" for k, (a, b, c) in V.OTHER_TYPES.items())


@register("type_maps", f"""WITH k AS (SELECT p_partkey, {_TYPES}[p_size % {len(_TYPES)} + 1] AS kind FROM part), m AS (SELECT * FROM (VALUES {_MAPS}) AS v(kind, server, broker, lossless))
SELECT p_partkey, k.kind, coalesce(server, -1) AS server, coalesce(broker, -1) AS broker, coalesce(lossless, false) AS lossless FROM k LEFT JOIN m ON m.kind = k.kind""")
def _maps(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _TYPES)), F.col("p_size") % len(_TYPES))
    return _t(spark, sf_dir, "part").select("p_partkey", kind.alias("kind")).withColumn("m", V.other_types(F.col("kind"))).select("p_partkey", "kind", "m.*")


@register("rate_alarms", f"WITH {POINTS_SQL}, d AS (SELECT *, abs(value - lag(value) {_O}) / nullif((us - lag(us) {_O}) / 1e6, 0) AS rate FROM p) SELECT tag_id, us, seq, value, round(rate, 9) + 0.0 AS rate FROM d WHERE rate > 0.01")
def _rate_alarms(spark, sf_dir):
    return W.rate_alarms(from_events(spark, sf_dir), 0.01).withColumn("rate", r6(F.col("rate"), 9))


@register("template_instances", """WITH f AS (SELECT o_orderkey AS id, o_orderpriority AS template FROM orders), d AS (SELECT DISTINCT o_orderpriority AS template, unnest(['flag', 'status', 'owner']) AS name FROM orders),
e AS (SELECT template, name, CASE WHEN name = 'status' AND template LIKE '1%' THEN 'new' END AS dflt, name <> 'owner' OR template LIKE '2%' AS required FROM d),
w AS (SELECT l_orderkey AS id, 'flag' AS name, min(l_returnflag) AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT o_orderkey, 'status', 'open' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'note', 'x' FROM orders)
SELECT f.id, f.template, e.name, coalesce(w.value, dflt, '') AS value, coalesce(w.value, dflt) IS NOT NULL AS is_set, required AND coalesce(w.value, dflt) IS NULL AS missing FROM f JOIN e ON e.template = f.template LEFT JOIN w ON w.id = f.id AND w.name = e.name""")
def _instances(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    f = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("template"))
    d = f.select("template").distinct().select("template", F.explode(F.array(F.lit("flag"), F.lit("status"), F.lit("owner"))).alias("name"))
    first = F.substring("template", 1, 1)
    d = d.withColumn("default", F.when((F.col("name") == "status") & (first == "1"), "new")).withColumn("required", (F.col("name") != "owner") | (first == "2"))
    own = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("flag").alias("name"), F.min("l_returnflag").alias("value"))
    own = own.unionByName(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.lit("status").alias("name"), F.lit("open").alias("value"))).unionByName(o.select(F.col("o_orderkey").alias("id"), F.lit("note").alias("name"), F.lit("x").alias("value")))
    return M.instances(f, d, own).withColumn("value", F.coalesce("value", F.lit("")))


@register("result_union", f"""WITH {POINTS_SQL}, a AS (SELECT tag_id, us, seq, value, quality FROM p WHERE value > 50), b AS (SELECT tag_id, us, seq, value + 1000 AS value, quality FROM p WHERE quality = 192), c AS (SELECT tag_id, us, seq, value + 2000 AS value, quality FROM p WHERE us < 1704500000000000)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE seq NOT IN (SELECT seq FROM a) UNION ALL SELECT * FROM c WHERE seq NOT IN (SELECT seq FROM a) AND seq NOT IN (SELECT seq FROM b)""")
def _union(spark, sf_dir):
    p = from_events(spark, sf_dir)
    later = lambda by: p.withColumn("value", F.col("value") + by)
    return M.union_results(QuerySpec(min_value=50.000001).retrieve(p), later(1000).where("quality = 192"), later(2000).where("us < 1704500000000000"))


_ENUM_SQL = "n AS (SELECT p_brand AS set, p_size AS code, p_type AS name, bool_and(p_retailprice < 1000) AS retired FROM part GROUP BY ALL)"


def _enum(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("set"), F.col("p_size").alias("code"), F.col("p_type").alias("name")).agg(F.bool_and(F.col("p_retailprice") < 1000).alias("retired"))


@register("enum_sets", f"WITH {_ENUM_SQL} SELECT set, CAST(count_if(NOT retired) AS BIGINT) AS active, CAST(count_if(retired) AS BIGINT) AS retired FROM n GROUP BY set")
def _sets(spark, sf_dir):
    return M.enum_sets(_enum(spark, sf_dir))


@register("enum_codes", f"WITH {_ENUM_SQL}, a AS (SELECT set, name, min(code) AS code FROM n WHERE NOT retired GROUP BY set, name) SELECT p_partkey, p_brand AS set, p_type AS name, coalesce(code, -1) AS code, code IS NOT NULL AS valid FROM part LEFT JOIN a ON a.set = p_brand AND a.name = p_type")
def _codes(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("set"), F.col("p_type").alias("name"))
    return M.enum_codes(names, _enum(spark, sf_dir)).withColumn("code", F.coalesce("code", F.lit(-1)))


@register("point_updates", """SELECT s_suppkey AS point_id, CASE WHEN s_acctbal < 0 THEN 'closed ' || s_name ELSE s_name END AS tag, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS span FROM supplier WHERE s_acctbal < 9000""")
def _updates(spark, sf_dir):
    """Points of suppliers: those in debt changed, the richest deleted."""
    s = _t(spark, sf_dir, "supplier")
    db = s.select(F.col("s_suppkey").alias("point_id"), F.col("s_name").alias("tag"), F.col("s_acctbal").alias("span"))
    changes = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("point_id"), F.concat(F.lit("closed "), "s_name").alias("tag"), F.lit(0.0).alias("span"))
    return M.delete_rows(M.update_rows(db, changes, "point_id"), s.where("s_acctbal >= 9000").select(F.col("s_suppkey").alias("point_id")), "point_id")


@register("point_errors", """SELECT p_partkey, regexp_full_match(replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN '-' ELSE '_' END) || '.' || p_partkey, '[A-Za-z][A-Za-z0-9_.]*') AS tag_ok,
CAST(CASE WHEN p_retailprice - 1000 <= 0 THEN 1 WHEN p_size - 3 < 0 THEN 2 WHEN p_size % 7 - 1 < 0 THEN 3 WHEN p_size > 40 THEN 4 ELSE 0 END AS INTEGER) AS code FROM part""")
def _errors(spark, sf_dir):
    size = F.col("p_size")
    tag = F.concat(F.replace("p_name", F.lit(" "), F.when(size % 3 == 0, "-").otherwise("_")), F.lit("."), F.col("p_partkey").cast("string"))
    code = M.validate_point(F.col("p_retailprice") - 1000, size - 3, size % 7 - 1, size, F.lit(40))
    return _t(spark, sf_dir, "part").select("p_partkey", M.validate_tag(tag).alias("tag_ok"), code.alias("code"))


@register("size_figures", f"""WITH {POINTS_SQL}, d AS (SELECT tag_id, count(*) AS n FROM p GROUP BY tag_id), k AS (SELECT tag_id, count(*) AS kept FROM (SELECT *, abs(value - lag(value) {_O}) AS c FROM p) WHERE c IS NULL OR c > 20 GROUP BY tag_id),
r AS (SELECT tag_id, CAST(sum(CASE WHEN q IS DISTINCT FROM b OR first THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT tag_id, quality AS q, lag(quality) {_O} AS b, row_number() {_O} = 1 AS first FROM p) GROUP BY tag_id)
SELECT tag_id, n, kept, runs, round(n / kept, 6) + 0.0 AS ratio, round((1 - kept / n) * 100, 6) + 0.0 AS percent_saved, (n - kept) * 24 AS bytes_saved, round(n * 8 / (runs * 16), 6) + 0.0 AS run_ratio FROM d JOIN k USING (tag_id) JOIN r USING (tag_id)""")
def _sizes(spark, sf_dir):
    p = from_events(spark, sf_dir)
    out = G.size_figures(p, C.deadband_previous(p, 20.0), C.runs(p.withColumn("value", F.col("quality").cast("double"))))
    return out.withColumns({c: r6(F.col(c)) for c in ("ratio", "percent_saved", "run_ratio")})


@register("delivery_stats", """WITH d AS (SELECT o_orderpriority AS rule, CASE o_custkey % 6 WHEN 0 THEN 'DELIVERED' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'PENDING' ELSE 'SENT' END AS status FROM orders)
SELECT rule, CAST(count_if(status IN ('DELIVERED', 'ACKNOWLEDGED')) AS BIGINT) AS delivered, CAST(count_if(status IN ('FAILED', 'EXPIRED')) AS BIGINT) AS failed, CAST(count_if(status IN ('PENDING', 'SENT')) AS BIGINT) AS pending,
round(count_if(status IN ('FAILED', 'EXPIRED')) / count_if(status NOT IN ('PENDING', 'SENT')), 6) + 0.0 AS failure_rate FROM d GROUP BY rule""")
def _deliveries(spark, sf_dir):
    names = F.array(*map(F.lit, ["DELIVERED", "ACKNOWLEDGED", "FAILED", "EXPIRED", "PENDING", "SENT"]))
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule"), F.get(names, (F.col("o_custkey") % 6).cast("int")).alias("status"))
    return M.delivery_stats(d, "rule").withColumn("failure_rate", r6(F.col("failure_rate")))


@register("counts_by_level", "SELECT r_name AS board, c_mktsegment AS kind, CAST(CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 3000 THEN 2 WHEN c_acctbal < 6000 THEN 3 ELSE 4 END AS INTEGER) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _levels(spark, sf_dir):
    c, n, r = (_t(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    b = F.col("c_acctbal")
    level = F.when(b < 0, 1).when(b < 3000, 2).when(b < 6000, 3).otherwise(4)
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("board"), F.col("c_mktsegment").alias("kind"), level.alias("level")).agg(F.count("*").alias("n"))


@register("spec_as_sql", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, value, quality FROM p WHERE tag_id IN (1, 2, 3, 5, 8, 13) AND us >= 1704240000000000 AND us <= 1705500000000000 AND value >= 5 AND value <= 90 AND (quality & 192) = 192 ORDER BY us DESC, seq DESC LIMIT 200 OFFSET 5")
def _spec(spark, sf_dir):
    """A specification run as the SQL text and parameters that it makes."""
    spec = QuerySpec(tag_ids=(1, 2, 3, 5, 8, 13), start_us=1704240000000000, end_us=1705500000000000, end_inclusive=True, min_value=5.0, max_value=90.0, good_only=True, descending=True, limit=200, offset=5)
    text, args = spec.sql("{points}")
    return spark.sql(text, args, points=from_events(spark, sf_dir))


@register("percent_values", f"WITH {POINTS_SQL} SELECT seq, round((value - 10) / 80 * 100, 6) + 0.0 AS percent, round(10 + (value - 10) / 80 * 100 / 100 * 80, 6) + 0.0 AS back, round(CASE WHEN value > 50 OR quality = 0 THEN 1 ELSE 0 END, 6) + 0.0 AS either FROM p")
def _percent(spark, sf_dir):
    v, n = F.col("value"), F.lit
    pc = S.to_percent(v, n(10.0), n(80.0))
    return from_events(spark, sf_dir).select("seq", r6(pc).alias("percent"), r6(S.from_percent(pc, n(10.0), n(80.0))).alias("back"), r6(compile_formula("|value > 50 || |quality == 0")).alias("either"))


_L0 = "v0 * ((q_us - t1) / (t0 - t1)) * ((q_us - t2) / (t0 - t2)) + v1 * ((q_us - t0) / (t1 - t0)) * ((q_us - t2) / (t1 - t2)) + v2 * ((q_us - t0) / (t2 - t0)) * ((q_us - t1) / (t2 - t1))"
_L1 = "v1 * ((q_us - t2) / (t1 - t2)) * ((q_us - t3) / (t1 - t3)) + v2 * ((q_us - t1) / (t2 - t1)) * ((q_us - t3) / (t2 - t3)) + v3 * ((q_us - t1) / (t3 - t1)) * ((q_us - t2) / (t3 - t2))"


@register("interp_quadratic", f"{_ASOF} SELECT tag_id, q_us, round(CASE WHEN t2 IS NOT NULL AND t0 IS NOT NULL AND (t3 IS NULL OR q_us - t0 <= t3 - q_us) THEN {_L0} WHEN t2 IS NOT NULL AND t3 IS NOT NULL THEN {_L1} WHEN t2 IS NOT NULL THEN {_LINE} WHEN q_us = t1 THEN v1 ELSE coalesce(v0 + (v1 - v0) * (q_us - t0) / (t1 - t0), v1) END, 4) + 0.0 AS value FROM j")
def _quadratic(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return I.interpolate(p, I.grid(p, 6 * HOUR), "quadratic").withColumn("value", r6(F.col("value"), 4))


@register("quality_words", f"WITH {POINTS_SQL}, w AS (SELECT seq, quality, quality | (CASE WHEN value > 50 THEN 3 ELSE 0 END) AS marked, lag(quality) {_O} AS b FROM p) SELECT seq, CAST(marked AS INTEGER) AS marked, (marked & 192) IN (0, 64, 192) AS valid, CAST(CASE WHEN b IS NULL OR (quality & 192) < (b & 192) THEN quality ELSE b END AS INTEGER) AS worst FROM w")
def _words(spark, sf_dir):
    from tidemark.points import ordered

    q = F.col("quality")
    p = from_events(spark, sf_dir).withColumn("before", F.coalesce(F.lag("quality").over(ordered()), q))
    marked = Q.set_bits(q, F.when(F.col("value") > 50, 3).otherwise(0))
    return p.select("seq", marked.alias("marked"), Q.is_valid(marked).alias("valid"), Q.worst(q, F.col("before")).alias("worst"))


@register("display_values", f"""WITH {POINTS_SQL}, h AS (SELECT seq, us, value, value * 3.6::DOUBLE AS hue FROM p WHERE value BETWEEN 0 AND 100),
c AS (SELECT *, (5 + hue / 60) % 6 AS k5, (3 + hue / 60) % 6 AS k3, (1 + hue / 60) % 6 AS k1 FROM h)
SELECT seq, round((least(greatest((value * 3.6::DOUBLE - 30) / 300, 0), 1)) * 200, 6) + 0.0 AS gauge, CAST(round(50 + least(greatest((us - 1704067200000000) / {30 * DAY}, 0), 1) * 800) AS INTEGER) AS x,
CAST(round((1 - greatest(0, least(k5, 4 - k5, 1))) * 255) AS INTEGER) AS r, CAST(round((1 - greatest(0, least(k3, 4 - k3, 1))) * 255) AS INTEGER) AS g, CAST(round((1 - greatest(0, least(k1, 4 - k1, 1))) * 255) AS INTEGER) AS b,
CASE WHEN value * 1000 / 500 < 1 THEN 'RAW' WHEN value * 1000 / 500 < 60 THEN 'SECOND' ELSE 'MINUTE' END AS resolution FROM c""")
def _display(spark, sf_dir):
    v, n = F.col("value"), F.lit
    p = from_events(spark, sf_dir).where("value between 0 and 100")
    rgb = D.hsv_to_rgb(v * 3.6, n(1.0), n(1.0))
    return p.select("seq", r6(D.gauge_value(v * 3.6, n(0.0), n(200.0), 30.0, 300.0)).alias("gauge"), D.pixel_x(F.col("us"), n(1704067200000000), n(1704067200000000 + 30 * DAY), 50, 800).alias("x"), rgb.alias("c"), D.resolution(v * 1_000_000_000, 500).alias("resolution")).select("seq", "gauge", "x", "c.*", "resolution")


@register("system_health", """SELECT s_nationkey AS node, round(greatest(0, 100 * count_if(s_acctbal >= 0) / count(*) - CASE WHEN max(s_acctbal) / 100 > 90 THEN 20 ELSE 0 END - CASE WHEN sum(greatest(s_acctbal, 0)) > 16000 THEN 10 ELSE 0 END), 6) + 0.0 AS health FROM supplier GROUP BY s_nationkey""")
def _health(spark, sf_dir):
    b = F.col("s_acctbal")
    g = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count_if(b >= 0).alias("up"), F.count("*").alias("n"), (F.max(b) / 100).alias("cpu"), F.sum(F.greatest(b, F.lit(0.0))).alias("mb"))
    return g.select("node", r6(M.system_health(F.col("up"), F.col("n"), F.col("cpu"), F.col("mb"))).alias("health"))
