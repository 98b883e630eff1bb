"""Registered queries: lossy compression, sequential rules, codecs, payloads, archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codecs as X
from tidemark.operators import compress as C
from tidemark.operators import interpolate as I
from tidemark.operators import state as T
from tidemark.plans import sql_series as Y
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, POINTS_SQL, from_events, r6
from tidemark.sources import archive, payload, simulated

_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"


@register("deadband_predicates", f"WITH {POINTS_SQL}, n AS (SELECT *, lag(value) {_O} AS b FROM p) SELECT tag_id, us, seq, value FROM n WHERE b IS NULL OR abs(value - b) > 20")
def _deadband_previous(spark, sf_dir):
    return C.deadband_previous(from_events(spark, sf_dir), 20.0)


@register("rle_runs", f"""WITH e AS (SELECT user_id AS tag_id, epoch_us(ts) AS us, event_id AS seq, CASE event_type WHEN 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM events),
c AS (SELECT *, CASE WHEN value IS DISTINCT FROM lag(value) {_O} OR row_number() {_O} = 1 THEN 1 ELSE 0 END AS c FROM e), r AS (SELECT *, CAST(sum(c) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT tag_id, run, any_value(value) AS value, min(us) AS start_us, count(*) AS length FROM r GROUP BY tag_id, run""")
def _runs(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return C.runs(p.withColumn("value", F.when(F.col("quality") == 0, 0.0).otherwise(1.0)))


@register("mad_autotune", f"""WITH {POINTS_SQL}, d AS (SELECT tag_id, value - lag(value) {_O} AS d FROM p), f AS (SELECT * FROM d WHERE d IS NOT NULL), m AS (SELECT tag_id, median(d) AS m FROM f GROUP BY tag_id)
SELECT f.tag_id, round(3.0::DOUBLE * 1.4826::DOUBLE * median(abs(d - m)), 6) + 0.0 AS band FROM f JOIN m ON f.tag_id = m.tag_id GROUP BY f.tag_id""")
def _mad(spark, sf_dir):
    return C.noise_band(from_events(spark, sf_dir)).withColumn("band", r6(F.col("band")))


@register("compression_errors", f"""WITH {POINTS_SQL}, n AS (SELECT *, row_number() {_O} AS r FROM p), k AS (SELECT tag_id, us AS t, value AS v FROM n WHERE (r - 1) % 5 = 0),
j AS (SELECT p.tag_id, p.value AS a, k.v AS b FROM p ASOF JOIN k ON p.tag_id = k.tag_id AND p.us >= k.t), c AS (SELECT tag_id, count(*) AS kept FROM k GROUP BY tag_id)
SELECT j.tag_id, count(*) AS n, kept, round(max(abs(a - b)), 6) + 0.0 AS max_error, round(sqrt(avg((a - b) * (a - b))), 6) + 0.0 AS rmse, round(sqrt(avg((a - b) * (a - b))) / nullif(max(a) - min(a), 0), 6) + 0.0 AS nrmse,
round(CASE WHEN sum((a - b) * (a - b)) > 0 THEN 10 * log10(sum(a * a) / sum((a - b) * (a - b))) END, 6) + 0.0 AS snr_db, round(count(*) / kept, 6) + 0.0 AS ratio FROM j JOIN c ON j.tag_id = c.tag_id GROUP BY j.tag_id, kept""")
def _errors(spark, sf_dir):
    from tidemark.operators.windows import every_kth

    p = from_events(spark, sf_dir)
    e = C.errors(p, every_kth(p, 5), "step")
    return e.withColumns({c: r6(F.col(c)) for c in ("max_error", "rmse", "nrmse", "snr_db", "ratio")})


#: Points with a value and their number r in the series; rules walk over r in recursive SQL.
_N = f"WITH RECURSIVE {POINTS_SQL}, n AS MATERIALIZED (SELECT tag_id, us, seq, value, row_number() {_O} AS r FROM p WHERE value IS NOT NULL)"
_NEXT = "FROM d JOIN n ON n.tag_id = d.tag_id AND n.r = d.r + 1"


def band_sql(leaves: str) -> str:
    """SQL of a rule that keeps a point when it leaves the last kept one, d.last at d.at."""
    return f"""{_N}, d AS (SELECT tag_id, us, seq, value, r, value AS last, us AS at, true AS keep FROM n WHERE r = 1
UNION ALL SELECT n.tag_id, n.us, n.seq, n.value, n.r, CASE WHEN {leaves} THEN n.value ELSE d.last END, CASE WHEN {leaves} THEN n.us ELSE d.at END, {leaves} {_NEXT})
SELECT tag_id, us, seq, value FROM d WHERE keep"""


_DOOR = f"""{_N}, d AS (SELECT tag_id, us, r, value, us AS bt, value AS bv, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, true AS based, false AS emits FROM n WHERE r = 1
UNION ALL SELECT tag_id, us, r, value, bt2, bv2,
  CASE WHEN out THEN CASE WHEN us > bt2 THEN (value - 20 - bv2) / ((us - bt2) / 1e6) ELSE '-inf'::DOUBLE END WHEN us > bt THEN greatest(lo, (value - 20 - bv) / ((us - bt) / 1e6)) ELSE lo END,
  CASE WHEN out THEN CASE WHEN us > bt2 THEN (value + 20 - bv2) / ((us - bt2) / 1e6) ELSE 'inf'::DOUBLE END WHEN us > bt THEN least(hi, (value + 20 - bv) / ((us - bt) / 1e6)) ELSE hi END, false, moves
FROM (SELECT *, CASE WHEN moves THEN pt ELSE bt END AS bt2, CASE WHEN moves THEN pv ELSE bv END AS bv2
FROM (SELECT *, out AND NOT based AS moves FROM (SELECT n.tag_id, n.us, n.r, n.value, d.bt, d.bv, d.lo, d.hi, d.based, d.us AS pt, d.value AS pv,
  n.us > d.bt AND NOT (d.lo <= (n.value - d.bv) / ((n.us - d.bt) / 1e6) AND (n.value - d.bv) / ((n.us - d.bt) / 1e6) <= d.hi) AS out {_NEXT}))))
SELECT n.tag_id, n.us, n.seq, n.value FROM n LEFT JOIN d ON d.tag_id = n.tag_id AND d.r = n.r + 1 WHERE n.r = 1 OR d.r IS NULL OR d.emits"""

_LATCH = f"""{_N}, d AS (SELECT tag_id, us, seq, value, r, value >= 95 AS hh, value >= 80 AS h, value <= 2 AS ll, value <= 5 AS l FROM n WHERE r = 1
UNION ALL SELECT n.tag_id, n.us, n.seq, n.value, n.r, n.value >= 95 OR (d.hh AND n.value > 90), n.value >= 80 OR (d.h AND n.value > 75), n.value <= 2 OR (d.ll AND n.value < 7), n.value <= 5 OR (d.l AND n.value < 10) {_NEXT})
SELECT tag_id, us, seq, value, CASE WHEN hh THEN 'HIHI' WHEN h THEN 'HI' WHEN ll THEN 'LOLO' WHEN l THEN 'LO' ELSE 'NONE' END AS alarm FROM d"""

_SCHMITT = f"""{_N}, d AS (SELECT tag_id, us, seq, value, r, true AS armed, CASE WHEN value >= 45 THEN 1 ELSE 0 END AS seen, NULL::BIGINT AS last, false AS fire FROM n WHERE r = 1
UNION ALL SELECT tag_id, us, seq, value, r, ready AND NOT fires, more, CASE WHEN fires THEN us ELSE last END, fires
FROM (SELECT *, ready AND more >= 2 AND (last IS NULL OR us - last >= 5000000) AS fires FROM (SELECT n.tag_id, n.us, n.seq, n.value, n.r, d.last, d.armed OR n.value <= 35 AS ready, CASE WHEN n.value >= 45 THEN d.seen + 1 ELSE 0 END AS more {_NEXT})))
SELECT tag_id, us, seq, value FROM d WHERE fire"""

_WINTERS = f"""{_N}, d AS (SELECT tag_id, us, seq, r, value AS level, 0.0::DOUBLE AS trend, [1.0::DOUBLE, 1.0, 1.0, 1.0] AS s FROM n WHERE r = 1
UNION ALL SELECT tag_id, us, seq, r, level2, trend2, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = k THEN 0.1::DOUBLE * (CASE WHEN level2 <> 0 THEN value / level2 ELSE 1.0 END) + (1 - 0.1::DOUBLE) * s[i] ELSE s[i] END)
FROM (SELECT *, 0.1::DOUBLE * (level2 - level) + (1 - 0.1::DOUBLE) * trend AS trend2 FROM (SELECT *, 0.2::DOUBLE * (CASE WHEN s[k] <> 0 THEN value / s[k] ELSE value END) + (1 - 0.2::DOUBLE) * (level + trend) AS level2
FROM (SELECT n.tag_id, n.us, n.seq, n.r, n.value, d.level, d.trend, d.s, CAST((n.r - 1) % 4 + 1 AS INTEGER) AS k {_NEXT}))))
SELECT tag_id, us, seq, round(level, 6) + 0.0 AS level, round(trend, 6) + 0.0 AS trend, round((level + trend) * s[CAST(r % 4 + 1 AS INTEGER)], 6) + 0.0 AS forecast FROM d"""

EMA_SQL = f"""{_N}, d AS (SELECT tag_id, us, seq, r, value AS ema FROM n WHERE r = 1
UNION ALL SELECT n.tag_id, n.us, n.seq, n.r, 0.3::DOUBLE * n.value + (1 - 0.3::DOUBLE) * d.ema {_NEXT})
SELECT tag_id, us, seq, round(ema, 6) + 0.0 AS ema FROM d"""


def _kept(name: str, f, sql: str | None = None) -> None:
    @register(*([name, sql] if sql else [name]))
    def query(spark, sf_dir):
        return f(from_events(spark, sf_dir))


_kept("deadband_compress", lambda p: C.deadband(p, 20.0), band_sql("abs(n.value - d.last) > 20"))
_kept("percent_deadband", lambda p: C.percent_deadband(p, 10.0, 200.0), band_sql("abs(n.value - d.last) > 20"))
_kept("swinging_door", lambda p: C.swinging_door(p, 20.0), _DOOR)
_kept("pla_top_down", lambda p: C.piecewise_linear(p, 20.0), Y.split_sql(False))
_kept("line_simplify", lambda p: C.line_simplify(p, 20.0), Y.split_sql(True))
_kept("largest_triangle", lambda p: C.largest_triangle(p, 20), Y.TRIANGLE)
_kept("alarm_latch", lambda p: T.latched_alarms(p, 2.0, 5.0, 80.0, 95.0, 5.0), _LATCH)
_kept("schmitt_debounce", lambda p: T.debounced_trigger(p, 40.0, 5.0, samples=2), _SCHMITT)
_kept("holt_winters", lambda p: T.holt_winters(p, 0.2, 0.1, 0.1, 4).withColumns({c: r6(F.col(c)) for c in ("level", "trend", "forecast")}), _WINTERS)
_kept("time_clusters", lambda p: T.time_clusters(p, 6 * HOUR, 3).withColumn("cluster", F.coalesce("cluster", F.lit(0))), Y.CLUSTERS)


def _series(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("us", "seq", "value")))
    p = from_events(spark, sf_dir).where("value is not null").groupBy("tag_id").agg(s.alias("s"))
    return p.select("tag_id", F.transform("s", lambda x: x["value"]).alias("values"), F.transform("s", lambda x: x["us"]).alias("times"))


@register("gorilla_roundtrip")
def _gorilla(spark, sf_dir):
    p = _series(spark, sf_dir)
    p = p.withColumn("v", X.arrow(X.xor_encode, "binary")("values")).withColumn("t", X.arrow(X.times_encode, "binary")("times"))
    same = (X.arrow(X.xor_decode, "array<double>")("v") == F.col("values")) & (X.arrow(X.times_decode, "array<bigint>")("t") == F.col("times"))
    return p.select("tag_id", F.size("values").alias("n"), F.length("v").alias("value_bytes"), F.length("t").alias("time_bytes"), same.alias("same"))


@register("varint_roundtrip")
def _varint(spark, sf_dir):
    p = _series(spark, sf_dir).withColumn("d", F.transform("times", lambda x, i: F.when(i == 0, x).otherwise(x - F.col("times")[i - 1])))
    p = p.withColumn("b", X.arrow(X.varint_encode, "binary")("d"))
    return p.select("tag_id", F.length("b").alias("bytes"), (X.arrow(X.varint_decode, "array<bigint>")("b") == F.col("d")).alias("same"))


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@register("dct_roundtrip")
def _dct(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("c", X.arrow(lambda x: X.dct(x).tolist(), "array<double>")("v"))
    back = X.arrow(lambda x: X.inverse_dct(x).tolist(), "array<double>")("c")
    return v.select("vec_id", r6(F.col("c")[0]).alias("c0"), F.forall(F.zip_with(back, "v", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x).alias("same"))


@register("soft_threshold", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: sign(x::DOUBLE) * greatest(abs(x::DOUBLE) - 0.1, 0.0))), 6) + 0.0 AS total FROM embeddings""")
def _soft(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", r6(F.aggregate(X.soft_threshold(F.col("v"), 0.1), F.lit(0.0), lambda a, b: a + b)).alias("total"))


@register("topk_coefficients", """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS index, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT vec_id, CAST(index AS INTEGER) AS index, round(value, 6) + 0.0 AS value FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, index) <= 5""")
def _topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.explode(X.top_coefficients(F.col("v"), 5)).alias("c")).select("vec_id", F.col("c.index").alias("index"), r6(F.col("c.value")).alias("value"))


@register("zigzag", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 * event_id ELSE 2 * event_id - 1 END AS folded, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS unfolded FROM events""")
def _zigzag(spark, sf_dir):
    from tidemark.functions.scalar import unzigzag, zigzag

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id")).alias("n"))
    return e.select("event_id", zigzag(F.col("n")).alias("folded"), unzigzag(zigzag(F.col("n"))).alias("unfolded"))


@register("payload_roundtrip", f"WITH {POINTS_SQL} SELECT seq, 'tag' || tag_id AS tag, us AS timestamp, value, quality, true AS same FROM p")
def _payload(spark, sf_dir):
    p = from_events(spark, sf_dir).withColumn("tag", F.concat(F.lit("tag"), "tag_id"))
    c = [F.col(x) for x in ("tag", "us", "value", "quality")]
    p = p.withColumn("b", payload.from_binary(payload.to_binary(*c))).withColumn("j", payload.from_json(payload.to_json(c[0], c[2], c[1], c[3])))
    return p.select("seq", "b.tag", "b.timestamp", "b.value", "b.quality", ((F.col("b.value") == F.col("j.value")) & (F.col("b.timestamp") == F.col("j.timestamp"))).alias("same"))


@register("csv_lines", f"WITH {POINTS_SQL} SELECT seq, 'tag' || tag_id || ',' || us || ',' || printf('%.6f', value) || ',' || CASE WHEN (quality & 192) = 192 THEN '0' ELSE '1' END AS line FROM p")
def _csv(spark, sf_dir):
    return from_events(spark, sf_dir).select("seq", payload.to_csv_line(F.concat(F.lit("tag"), "tag_id"), F.col("us"), F.col("value"), F.col("quality")).alias("line"))


@register("archive_figures", f"WITH {POINTS_SQL} SELECT count(*) AS events, min(us) AS oldest_us, max(us) AS newest_us, count(*) * 24 AS bytes FROM p")
def _figures(spark, sf_dir):
    return archive.figures(from_events(spark, sf_dir))


@register("archive_find_value", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, value FROM p WHERE abs(value - 50) <= 0.5")
def _find(spark, sf_dir):
    return archive.find_value(from_events(spark, sf_dir), 50.0, 0.5).select("tag_id", "us", "seq", "value")


@register("snapshot_diff", f"WITH {POINTS_SQL}, l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY us DESC, seq DESC) = 1) SELECT round(a.value - b.value, 6) + 0.0 AS difference FROM l a JOIN l b ON a.tag_id = 3 AND b.tag_id = 7")
def _difference(spark, sf_dir):
    return archive.snapshot_difference(I.snapshot(from_events(spark, sf_dir)), 3, 7).withColumn("difference", r6(F.col("difference")))


@register("buffer_expire", f"WITH {POINTS_SQL} SELECT tag_id, us, seq FROM p WHERE 1705000000000000 - us <= {3 * DAY}")
def _expire(spark, sf_dir):
    return archive.expire(from_events(spark, sf_dir), 1705000000000000, 3 * DAY).select("tag_id", "us", "seq")


@register("simulated_points", f"WITH {POINTS_SQL} SELECT tag_id, us, seq, round(100 * sin(0.1::DOUBLE * (row_number() {_O} - 1)), 6) + 0.0 AS value, 192 AS quality FROM p")
def _simulated(spark, sf_dir):
    return simulated.wave(from_events(spark, sf_dir)).withColumn("value", r6(F.col("value")))
