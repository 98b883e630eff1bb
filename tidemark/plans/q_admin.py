"""Registered queries: dimension tables, messages, displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import quality as Q
from tidemark.functions import scalar as S
from tidemark.operators import admin as M
from tidemark.operators import aggregates as A
from tidemark.plans.registry import register
from tidemark.points import DAY, POINTS_SQL, from_events, r6


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("gauge_and_pixels", f"""WITH {POINTS_SQL} SELECT seq, round(-120 + least(greatest(value / 100, 0), 1) * 240, 6) + 0.0 AS angle, CAST(round(10 + (1 - least(greatest(value / 100, 0), 1)) * 200) AS INTEGER) AS y,
round(10 ^ floor(log10((abs(value) + 1) / 7)) * CASE WHEN (abs(value) + 1) / 7 / 10 ^ floor(log10((abs(value) + 1) / 7)) <= 1 THEN 1 WHEN (abs(value) + 1) / 7 / 10 ^ floor(log10((abs(value) + 1) / 7)) <= 2 THEN 2 WHEN (abs(value) + 1) / 7 / 10 ^ floor(log10((abs(value) + 1) / 7)) <= 5 THEN 5 ELSE 10 END, 6) + 0.0 AS step,
CASE WHEN value <= 5 OR value >= 95 THEN 'alarm' WHEN value <= 10 OR value >= 80 THEN 'warn' ELSE 'normal' END AS color FROM p""")
def _gauge(spark, sf_dir):
    v, n = F.col("value"), F.lit
    p = from_events(spark, sf_dir)
    return p.select("seq", r6(D.gauge_angle(v, n(0.0), n(100.0), -120.0, 240.0)).alias("angle"), D.pixel_y(v, n(0.0), n(100.0), 10, 200).alias("y"), r6(S.nice_step(F.abs(v) + 1, 7)).alias("step"), D.limit_color(v, 10.0, 80.0, 5.0, 95.0).alias("color"))


@register("auto_scale", f"""WITH {POINTS_SQL}, m AS (SELECT tag_id, min(value) AS a, max(value) AS b FROM p GROUP BY tag_id)
SELECT tag_id, round(a - CASE WHEN b > a THEN (b - a) * 0.1::DOUBLE WHEN a <> 0 THEN abs(a) * 0.1::DOUBLE ELSE 10 END, 6) + 0.0 AS low, round(b + CASE WHEN b > a THEN (b - a) * 0.1::DOUBLE WHEN a <> 0 THEN abs(a) * 0.1::DOUBLE ELSE 10 END, 6) + 0.0 AS high FROM m""")
def _scale(spark, sf_dir):
    m = from_events(spark, sf_dir).groupBy("tag_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    low, high = D.auto_scale(F.col("a"), F.col("b"))
    return m.select("tag_id", r6(low).alias("low"), r6(high).alias("high"))


@register("rects", """SELECT l_orderkey, l_linenumber, l_quantity < 25 + 10 AND 25 < l_quantity + 10 AND l_tax * 100 < 4 + 2 AND 4 < l_tax * 100 + 2 AS overlap, l_quantity BETWEEN 10 AND 30 AND l_tax * 100 BETWEEN 2 AND 6 AS inside FROM lineitem""")
def _rects(spark, sf_dir):
    x, y, n = F.col("l_quantity"), F.col("l_tax") * 100, F.lit
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.rects_overlap(x, y, n(10), n(2), n(25), n(4), n(10), n(2)).alias("overlap"), D.rect_contains(n(10), n(2), n(20), n(4), x, y).alias("inside"))


@register("color_blend", "SELECT p_partkey, CAST(floor((p_size * 200 + 90 * 55) / 255) AS INTEGER) AS channel, round((0.2126::DOUBLE * p_size + 0.7152::DOUBLE * 40 + 0.0722::DOUBLE * 10) / 255, 6) + 0.0 AS luminance FROM part")
def _blend(spark, sf_dir):
    s, n = F.col("p_size"), F.lit
    return _t(spark, sf_dir, "part").select("p_partkey", D.blend(s, n(90), n(200)).alias("channel"), r6(D.luminance(s, n(40), n(10))).alias("luminance"))


@register("enum_lookup", """WITH e AS (SELECT * FROM (VALUES (0, 'STOPPED', false), (64, 'IDLE', true), (192, 'RUNNING', false)) AS v(code, n, retired))
SELECT event_id, coalesce(n, 'UNKNOWN') AS name FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 64 WHEN 'click' THEN 7 ELSE 192 END AS code FROM events) LEFT JOIN e USING (code)""")
def _enum(spark, sf_dir):
    e = spark.createDataFrame([(0, "STOPPED", False), (64, "IDLE", True), (192, "RUNNING", False)], "code int, name string, retired boolean")
    t = F.col("event_type")
    v = _t(spark, sf_dir, "events").select("event_id", F.when(t == "error", 0).when(t == "view", 64).when(t == "click", 7).otherwise(192).alias("code"))
    return M.enum_names(v, e).select("event_id", "name")


@register("template_attributes", """WITH t AS (SELECT 'T:' || p_type AS id, NULL AS parent FROM part GROUP BY p_type UNION ALL SELECT 'B:' || p_brand, 'T:' || min(p_type) FROM part GROUP BY p_brand UNION ALL SELECT 'S:' || p_brand || ':' || p_size, 'B:' || p_brand FROM part GROUP BY p_brand, p_size),
a AS (SELECT 'T:' || p_type AS t, 'label' AS name, max(p_name) AS uom FROM part GROUP BY p_type UNION ALL SELECT 'T:' || p_type, 'price', min(p_name) FROM part GROUP BY p_type UNION ALL SELECT 'B:' || p_brand, 'label', min(p_name) FROM part GROUP BY p_brand HAVING min(p_size) <= 1
  UNION ALL SELECT 'S:' || p_brand || ':' || p_size, 'size ' || p_size % 3, max(p_name) FROM part GROUP BY p_brand, p_size UNION ALL SELECT 'S:' || p_brand || ':' || p_size, 'price', max(p_name) FROM part WHERE p_retailprice > 1000 GROUP BY p_brand, p_size),
c AS (SELECT id AS template, id AS t, 0 AS d FROM t UNION ALL SELECT id, parent, 1 FROM t WHERE parent IS NOT NULL UNION ALL SELECT x.id, y.parent, 2 FROM t x JOIN t y ON x.parent = y.id WHERE y.parent IS NOT NULL)
SELECT template, name, uom FROM c JOIN a USING (t) QUALIFY row_number() OVER (PARTITION BY template, name ORDER BY d) = 1""")
def _templates(spark, sf_dir):
    """Templates of part types, of brands derived from a type, and of sizes derived from a brand."""
    p = _t(spark, sf_dir, "part")
    of_type, of_brand, of_size = F.concat(F.lit("T:"), "p_type").alias("id"), F.concat(F.lit("B:"), "p_brand").alias("id"), F.concat(F.lit("S:"), "p_brand", F.lit(":"), F.col("p_size").cast("string")).alias("id")
    t = (
        p.groupBy(of_type).agg(F.lit(None).cast("string").alias("parent")).unionByName(p.groupBy(of_brand).agg(F.concat(F.lit("T:"), F.min("p_type")).alias("parent")))
        .unionByName(p.groupBy(of_size).agg(F.first(F.concat(F.lit("B:"), "p_brand")).alias("parent"))))
    attr = lambda df, key, name, uom: df.groupBy(key).agg(name.alias("name"), uom.alias("uom")).withColumnRenamed("id", "template")
    low, high = F.min("p_name"), F.max("p_name")
    brands = p.groupBy(of_brand).agg(F.lit("label").alias("name"), low.alias("uom"), F.min("p_size").alias("_s")).where("_s <= 1").drop("_s").withColumnRenamed("id", "template")
    a = (
        attr(p, of_type, F.lit("label"), high).unionByName(attr(p, of_type, F.lit("price"), low)).unionByName(brands)
        .unionByName(attr(p, of_size, F.concat(F.lit("size "), (F.first("p_size") % 3).cast("string")), high)).unionByName(attr(p.where("p_retailprice > 1000"), of_size, F.lit("price"), high)))
    return M.effective_attributes(t, a)


@register("access_levels", """SELECT c_custkey AS identity, l_partkey AS point_id, CAST(max(l_linenumber) AS INTEGER) AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL""")
def _access(spark, sf_dir):
    li, o, c = (_t(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    m = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("identity"), F.col("l_partkey").alias("point_id"), F.col("l_linenumber").alias("level"))
    return M.granted_access(m, c.select(F.col("c_custkey").alias("identity"), (F.col("c_acctbal") > 0).alias("enabled")))


@register("audit_recent", f"WITH {POINTS_SQL} SELECT seq AS entry_id, us, tag_id FROM p ORDER BY us DESC, seq DESC LIMIT 50")
def _audit(spark, sf_dir):
    return M.audit_recent(from_events(spark, sf_dir).select(F.col("seq").alias("entry_id"), "us", "tag_id"), 50)


@register("elect_primary", """WITH m AS (SELECT s_nationkey AS collective, s_suppkey AS member, CAST(floor(s_acctbal) AS INTEGER) % 10 AS priority, CASE WHEN s_acctbal < 0 THEN 'OFFLINE' WHEN s_suppkey % 3 = 0 THEN 'PRIMARY' WHEN s_suppkey % 3 = 1 THEN 'SECONDARY' ELSE 'WITNESS' END AS state FROM supplier)
SELECT collective, coalesce(arg_max(member, struct_pack(p := priority, m := -member)) FILTER (WHERE state IN ('PRIMARY', 'SECONDARY')), -1) AS primary, count(*) FILTER (WHERE state <> 'OFFLINE') AS healthy, count(*) FILTER (WHERE state <> 'OFFLINE') > floor(count(*) / 2) AS quorum FROM m GROUP BY collective""")
def _elect(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    state = F.when(F.col("s_acctbal") < 0, "OFFLINE").when(k == 0, "PRIMARY").when(k == 1, "SECONDARY").otherwise("WITNESS")
    m = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("collective"), F.col("s_suppkey").alias("member"), (F.floor("s_acctbal").cast("int") % 10).alias("priority"), state.alias("state"))
    return M.elect_primary(m).withColumn("primary", F.coalesce("primary", F.lit(-1).cast("long")))


@register("format_message", "SELECT o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderstatus || ' at {level}' AS message FROM orders")
def _message(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", M.format_message(F.lit("Order {id} is {status} at {level}"), {"id": F.col("o_orderkey"), "status": F.col("o_orderstatus")}).alias("message"))


@register("kpi_rollup", """SELECT n_regionkey AS parent, round(avg(c_acctbal), 6) + 0.0 AS value, max(CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal < 1000 THEN 1 ELSE 0 END) AS status FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def _kpi_rollup(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    b = F.col("c_acctbal")
    k = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("parent"), b.alias("value"), F.when(b < 0, 2).when(b < 1000, 1).otherwise(0).alias("status"))
    return M.kpi_rollup(k).withColumn("value", r6(F.col("value")))


@register("kpi_trend", f"""WITH {POINTS_SQL}, x AS (SELECT *, (us - min(us) OVER (PARTITION BY tag_id)) / 1e6 AS x FROM p), s AS (SELECT tag_id, regr_slope(value, x) AS slope, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY tag_id)
SELECT tag_id, CASE WHEN n < 3 OR slope IS NULL THEN 'UNDEFINED' WHEN abs(slope) <= 1e-6 THEN 'STABLE' WHEN slope > 0 THEN 'IMPROVING' ELSE 'DETERIORATING' END AS trend FROM s""")
def _trend(spark, sf_dir):
    return M.trend(A.regression(from_events(spark, sf_dir)), 1e-6).select("tag_id", "trend")


@register("weighted_score", "SELECT n_regionkey, round(sum(greatest(c_acctbal, 0) * length(c_name)) / nullif(sum(greatest(c_acctbal, 0)), 0), 6) + 0.0 AS composite FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def _score(spark, sf_dir):
    j = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.weighted_score(j, "n_regionkey", F.length("c_name"), F.col("c_acctbal")).withColumn("composite", r6(F.col("composite")))


@register("filetime", "SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000 + 11644473600) * 10000000 AS ticks, epoch_us(o_orderdate) // 1000000 AS back FROM orders")
def _filetime(spark, sf_dir):
    from tidemark.points import micros

    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.floor(micros(F.col("o_orderdate"), spark) / 1_000_000).cast("long").alias("s"))
    t = S.unix_to_filetime(F.col("s"))
    return o.select("o_orderkey", t.alias("ticks"), S.filetime_to_unix(t).alias("back"))


@register("time_overlap", f"SELECT o_orderkey, a <= b AND a <= {820454400000000} AND {788918400000000} <= b AS meets FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + o_custkey % 90 * {DAY} AS b FROM orders)")
def _overlap(spark, sf_dir):
    from tidemark.points import micros

    o = _t(spark, sf_dir, "orders").withColumn("a", micros(F.col("o_orderdate"), spark))
    return o.select("o_orderkey", S.overlaps(F.col("a"), F.col("a") + F.col("o_custkey") % 90 * DAY, F.lit(788918400000000), F.lit(820454400000000)).alias("meets"))


@register("staleness_quality", f"WITH {POINTS_SQL} SELECT seq, CASE WHEN 1706000000000000 - us <= {DAY} THEN 192 WHEN 1706000000000000 - us <= {10 * DAY} THEN 64 ELSE 0 END AS q FROM p")
def _stale(spark, sf_dir):
    return from_events(spark, sf_dir).select("seq", Q.from_staleness(F.lit(1706000000000000) - F.col("us"), F.lit(10 * DAY)).alias("q"))


@register("severity_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _severity(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@register("insert_points", """WITH d AS (SELECT s_suppkey AS point_id, s_name AS tag FROM supplier WHERE s_suppkey <= 50), f AS (SELECT DISTINCT s_name AS tag FROM supplier WHERE s_name NOT IN (SELECT tag FROM d))
SELECT count(*) AS n, count(DISTINCT point_id) AS ids, max(point_id) AS top FROM (SELECT point_id, tag FROM d UNION ALL SELECT (SELECT max(point_id) FROM d) + row_number() OVER (ORDER BY tag), tag FROM f)""")
def _insert(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    db = s.where("s_suppkey <= 50").select(F.col("s_suppkey").alias("point_id"), F.col("s_name").alias("tag"))
    return M.insert_points(db, s.select(F.col("s_name").alias("tag"))).agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.max("point_id").alias("top"))
