"""Registered queries: further filters and codecs, orders and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codecs as X
from tidemark.operators import compress as C
from tidemark.operators import interpolate as I
from tidemark.operators import order as G
from tidemark.operators import spectral as W
from tidemark.plans import sql_series as Y
from tidemark.plans.q_series import _FRAMES_SQL, _frames
from tidemark.plans.q_state import band_sql
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, POINTS_SQL, from_events, r6

_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"


@register("rate_filter", f"WITH {POINTS_SQL}, n AS (SELECT *, abs((value - lag(value) {_O}) / nullif((us - lag(us) {_O}) / 1e6, 0)) AS r FROM p) SELECT tag_id, us, seq, value FROM n WHERE r > 0.005")
def _rate(spark, sf_dir):
    return C.rate_filter(from_events(spark, sf_dir), 0.005)


@register("estimated_ratio", f"WITH {POINTS_SQL} SELECT tag_id, round(CASE WHEN stddev_pop(value) > 0 THEN greatest(1.0::DOUBLE, least(10000.0::DOUBLE, 5 * (stddev_pop(value) / 10) ^ (-0.7) + 1)) ELSE 1000.0::DOUBLE END, 6) + 0.0 AS ratio FROM p GROUP BY tag_id")
def _estimate(spark, sf_dir):
    return C.estimated_ratio(from_events(spark, sf_dir), 10.0).withColumn("ratio", r6(F.col("ratio")))


@register("noise_ratio", f"WITH {POINTS_SQL}, d AS (SELECT *, value - lag(value) {_O} AS d FROM p) SELECT tag_id, round(coalesce(10 * log10(var_pop(value) / nullif(avg(d * d), 0)), 100.0), 6) + 0.0 AS snr_db FROM d GROUP BY tag_id")
def _noise(spark, sf_dir):
    return C.noise_ratio(from_events(spark, sf_dir)).withColumn("snr_db", r6(F.col("snr_db")))


@register("rle_expand", "SELECT user_id AS tag_id, count(*) AS n, CAST(sum(CASE event_type WHEN 'error' THEN 0 ELSE 1 END) AS BIGINT) AS ones FROM events GROUP BY user_id")
def _expand(spark, sf_dir):
    p = from_events(spark, sf_dir).withColumn("value", F.when(F.col("quality") == 0, 0.0).otherwise(1.0))
    return C.expand_runs(C.runs(p)).groupBy("tag_id").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("ones"))


@register("pla_bottom_up", Y.BOTTOM)
def _bottom_up(spark, sf_dir):
    return C.bottom_up(from_events(spark, sf_dir), 20.0)


@register("deadband_timeout", band_sql("(abs(n.value - d.last) > 20 OR n.us - d.at >= 21600000000)"))
def _timeout(spark, sf_dir):
    return C.deadband_or_timeout(from_events(spark, sf_dir), 20.0, 6 * HOUR / 1e6)


@register("window_shapes", f"""WITH {POINTS_SQL}, n AS (SELECT tag_id, seq, row_number() {_O} - 1 AS i, count(*) OVER (PARTITION BY tag_id) - 1 AS top FROM p WHERE value IS NOT NULL),
k AS (SELECT * FROM (VALUES ('hann', 0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE), ('hamming', 0.54::DOUBLE, 0.46::DOUBLE, 0.0::DOUBLE), ('blackman', 0.42::DOUBLE, 0.5::DOUBLE, 0.08::DOUBLE)) AS v(kind, a, b, c))
SELECT kind, tag_id, seq, round(CASE WHEN top = 0 THEN 1 ELSE a - b * cos(2 * pi() * i / nullif(top, 0)) + c * cos(4 * pi() * i / nullif(top, 0)) END, 6) + 0.0 AS weight FROM k, n""")
def _shapes(spark, sf_dir):
    """The weights of each series' points in a window as long as the series."""
    ones = from_events(spark, sf_dir).where("value is not null").withColumn("value", F.lit(1.0))
    rows = [W.weighted(ones, k, 1 << 40).select(F.lit(k).alias("kind"), "tag_id", "seq", r6(F.col("value")).alias("weight")) for k in ("hann", "hamming", "blackman")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@register("hard_threshold", "SELECT vec_id, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.1::DOUBLE)) AS kept FROM embeddings")
def _hard(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.size(F.filter(X.hard_threshold(F.col("v"), 0.1), lambda x: x != 0)).cast("long").alias("kept"))


@register("word_pack_roundtrip")
def _words(spark, sf_dir):
    s = from_events(spark, sf_dir).groupBy("tag_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq"))), lambda x: x["us"]).alias("t"))
    s = s.withColumn("d", F.transform("t", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.floor((x - F.col("t")[i - 1]) / 1000)).cast("long")))
    s = s.withColumn("b", X.arrow(X.words_encode, "binary")("d"))
    return s.select("tag_id", F.length("b").alias("bytes"), (X.arrow(X.words_decode, "array<bigint>")("b") == F.col("d")).alias("same"))


@register("build_levels", "WITH RECURSIVE l AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey % 50 = 1 OR p_partkey = 0 UNION ALL SELECT id + 1, level + 1 FROM l WHERE (id + 1) % 50 <> 1 AND id + 1 <= (SELECT max(p_partkey) FROM part)) SELECT id, level FROM l")
def _levels(spark, sf_dir):
    """All parts, in chains of 50."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    return G.build_levels(p, p.where("id % 50 <> 1 and id > 0").select("id", (F.col("id") - 1).alias("needed")))


@register("causal_chains", Y.chains_sql(_FRAMES_SQL, 30 * DAY))
def _chains(spark, sf_dir):
    from tidemark.operators.frames import correlation_links

    return G.causal_chains(correlation_links(_frames(spark, sf_dir), 30 * DAY)).withColumn("events", F.array_join("events", ">"))


@register("frame_states", """WITH a AS (SELECT o_custkey AS frame_id, o_orderdate, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'close' WHEN 2 THEN 'acknowledge' ELSE 'cancel' END AS action FROM orders),
l AS (SELECT frame_id, list_prepend('INACTIVE', list(action ORDER BY epoch_us(o_orderdate) + o_orderkey)) AS s FROM a GROUP BY frame_id)
SELECT frame_id, list_reduce(s, lambda x, y: CASE WHEN x = 'INACTIVE' AND y = 'start' THEN 'ACTIVE' WHEN x = 'ACTIVE' AND y = 'close' THEN 'CLOSED' WHEN x = 'ACTIVE' AND y = 'cancel' THEN 'CANCELLED'
WHEN x IN ('ACTIVE', 'CLOSED') AND y = 'acknowledge' THEN 'ACKNOWLEDGED' ELSE x END) AS state FROM l""")
def _states(spark, sf_dir):
    from tidemark.points import micros

    k = F.col("o_orderkey") % 4
    action = F.when(k == 0, "start").when(k == 1, "close").when(k == 2, "acknowledge").otherwise("cancel")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return G.frame_states(o.select(F.col("o_custkey").alias("frame_id"), (micros(F.col("o_orderdate"), spark) + F.col("o_orderkey")).alias("us"), action.alias("action")))


@register("table_lookup", f"WITH {POINTS_SQL} SELECT seq, round(CASE WHEN value < 10 THEN 1.0::DOUBLE WHEN value < 50 THEN 1 + 4 * (value - 10) / 40 WHEN value < 90 THEN 5 + 15 * (value - 50) / 40 ELSE 20 END, 6) + 0.0 AS looked_up FROM p")
def _lookup(spark, sf_dir):
    t = spark.createDataFrame([(10.0, 1.0), (50.0, 5.0), (90.0, 20.0)], "x double, y double")
    return G.table_lookup(from_events(spark, sf_dir).select("seq", "value"), t, "value").select("seq", r6(F.col("looked_up")).alias("looked_up"))


@register("data_references", f"""WITH {POINTS_SQL}, l AS (SELECT tag_id, value FROM p QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY us DESC, seq DESC) = 1)
SELECT 'e' || tag_id AS element, 'live' AS name, 'PI_POINT' AS kind, value FROM l UNION ALL SELECT 'e' || tag_id, 'fixed', 'CONSTANT', 7.5::DOUBLE FROM l UNION ALL SELECT 'e' || tag_id, 'ref', 'ATTR_REF', value FROM l UNION ALL SELECT 'e' || tag_id, 'none', 'NONE', 1.0::DOUBLE FROM l""")
def _references(spark, sf_dir):
    latest = I.snapshot(from_events(spark, sf_dir))
    e = F.concat(F.lit("e"), "tag_id")
    row = lambda name, kind, config, default: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), config.alias("config"), F.lit(default).alias("default"))
    point, other = F.to_json(F.struct(F.col("tag_id").alias("tag"))), F.to_json(F.struct(e.alias("element"), F.lit("live").alias("attribute")))
    rows = F.explode(F.array(row("live", "PI_POINT", point, 0.0), row("fixed", "CONSTANT", F.lit('{"value": 7.5}'), 0.0), row("ref", "ATTR_REF", other, 0.0), row("none", "NONE", F.lit("{}"), 1.0))).alias("r")
    return G.resolve_references(latest.select(e.alias("element"), rows).select("element", "r.*"), latest)


@register("frame_lifecycle", """WITH RECURSIVE a AS (SELECT o_custkey AS frame_id, epoch_us(o_orderdate) + o_orderkey AS us, CASE o_orderkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'close' WHEN 2 THEN 'acknowledge' ELSE 'cancel' END AS action, 'user' || o_orderkey % 3 AS actor FROM orders),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY us, action, actor) AS r, count(*) OVER (PARTITION BY frame_id) AS m FROM a),
w AS (SELECT DISTINCT frame_id, 0::BIGINT AS r, 'INACTIVE' AS state, -1::BIGINT AS started, -1::BIGINT AS ended, -1::BIGINT AS acknowledged, '' AS by_whom, 0 AS refused FROM n
UNION ALL SELECT frame_id, r, CASE WHEN NOT ok THEN state WHEN action = 'start' THEN 'ACTIVE' WHEN action = 'close' THEN 'CLOSED' WHEN action = 'cancel' THEN 'CANCELLED' ELSE 'ACKNOWLEDGED' END, CASE WHEN ok AND action = 'start' THEN us ELSE started END,
  CASE WHEN ok AND action IN ('close', 'cancel') THEN us ELSE ended END, CASE WHEN ok AND action = 'acknowledge' THEN us ELSE acknowledged END, CASE WHEN ok AND action = 'acknowledge' THEN actor ELSE by_whom END, refused + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT n.frame_id, n.r, n.us, n.action, n.actor, w.state, w.started, w.ended, w.acknowledged, w.by_whom, w.refused, CASE n.action WHEN 'start' THEN state = 'INACTIVE' WHEN 'acknowledge' THEN state IN ('ACTIVE', 'CLOSED') ELSE state = 'ACTIVE' END AS ok FROM w JOIN n ON n.frame_id = w.frame_id AND n.r = w.r + 1))
SELECT w.frame_id, state, started, ended, acknowledged, by_whom, refused FROM w JOIN (SELECT DISTINCT frame_id, m FROM n) l ON l.frame_id = w.frame_id AND l.m = w.r""")
def _lifecycle(spark, sf_dir):
    from tidemark.points import micros

    k = F.col("o_orderkey")
    action = F.when(k % 4 == 0, "start").when(k % 4 == 1, "close").when(k % 4 == 2, "acknowledge").otherwise("cancel")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    done = G.frame_lifecycle(o.select(F.col("o_custkey").alias("frame_id"), (micros(F.col("o_orderdate"), spark) + k).alias("us"), action.alias("action"), F.concat(F.lit("user"), (k % 3).cast("string")).alias("actor")))
    return done.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("started", "ended", "acknowledged")}).withColumn("by_whom", F.coalesce("by_whom", F.lit("")))


@register("retry_schedule", """WITH m AS (SELECT event_id AS message_id, epoch_us(ts) AS us, 1 + event_id % 7 AS good FROM events), a AS (SELECT message_id, us, good, unnest(range(1, least(good, 5) + 1)) AS attempt FROM m),
t AS (SELECT *, CAST(coalesce(sum(least(60000000::DOUBLE, 7000000 * 2.5::DOUBLE ^ (attempt - 2))::BIGINT) FILTER (WHERE attempt > 1) OVER (PARTITION BY message_id ORDER BY attempt), 0) AS BIGINT) AS waited FROM a)
SELECT message_id, CAST(attempt AS INTEGER) AS attempt, us + waited AS at_us, attempt = good AS delivered FROM t""")
def _retries(spark, sf_dir):
    """All attempts of a message for each event; its first good attempt is the rest of its id by 7, and five are made."""
    from tidemark.streaming.outbox import schedule

    e = from_events(spark, sf_dir)
    return schedule(e.select(F.col("seq").alias("message_id"), "us", (1 + F.col("seq") % 7).alias("good")), 7_000_000, 2.5, 60_000_000, 5)
