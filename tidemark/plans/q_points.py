"""Registered queries over points: aggregates, row windows, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import windows as W
from tidemark.plans.q_state import EMA_SQL
from tidemark.plans.registry import register
from tidemark.points import DAY, HOUR, MINUTE, POINTS_SQL, from_events, r6

_W = f"WITH {POINTS_SQL}"
_O = "OVER (PARTITION BY tag_id ORDER BY us, seq)"
_NEXT = f"n AS (SELECT *, lead(us) {_O} AS nu, lead(value) {_O} AS nv FROM p)"


def _round(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _agg(name: str, kind: str, sql: str, rounded: bool = True, **kw) -> None:
    body = f"round({sql}, 6) + 0.0" if rounded else sql
    text = f"{_W}, {_NEXT} SELECT tag_id, {body} AS {kind} FROM n GROUP BY tag_id"

    def query(spark, sf_dir):
        out = A.aggregate(from_events(spark, sf_dir), [kind], **kw)
        return _round(out, kind) if rounded else out

    register(name, text)(query)


_AREA, _DT = "(value + nv) * 0.5 * ((nu - us) / 1e6)", "(nu - us) / 1e6"
_FIRST, _LAST = "arg_min(value, struct_pack(us := us, seq := seq))", "arg_max(value, struct_pack(us := us, seq := seq))"
_GOOD = "(quality & 192) = 192"
_agg("agg_average", "average", "avg(value)")
_agg("agg_time_average", "time_average", f"coalesce(sum({_AREA}) / nullif(sum(CASE WHEN {_AREA} IS NOT NULL THEN {_DT} END), 0), {_FIRST})")
_agg("agg_min", "minimum", "min(value)")
_agg("agg_max", "maximum", "max(value)")
_agg("agg_range", "range", "max(value) - min(value)")
_agg("agg_sum", "sum", "coalesce(sum(value), 0.0)")
_agg("agg_count", "count", "count(*)", rounded=False)
_agg("agg_stddev_pop", "stddev_pop", "stddev_pop(value)")
_agg("agg_stddev_samp", "stddev_samp", "stddev_samp(value)")
_agg("agg_var_pop", "var_pop", "var_pop(value)")
_agg("agg_var_samp", "var_samp", "var_samp(value)")
_agg("agg_percentile_90", "percentile", "quantile_cont(value, 0.9)", percentile=0.9)
_agg("agg_median", "median", "median(value)")
_agg("agg_duration_good", "duration_good", f"coalesce(sum(CASE WHEN {_GOOD} THEN {_DT} END), 0.0)")
_agg("agg_duration_bad", "duration_bad", f"coalesce(sum(CASE WHEN NOT ({_GOOD}) THEN {_DT} END), 0.0)")
_agg("agg_first", "first", _FIRST)
_agg("agg_last", "last", _LAST)
_agg("agg_delta", "delta", f"CASE WHEN count(*) > 1 THEN {_LAST} - {_FIRST} END")
_agg("agg_rate", "rate", f"({_LAST} - {_FIRST}) / nullif((max(us) - min(us)) / 1e6, 0)")
_agg("agg_integral", "integral", f"coalesce(sum({_AREA}), 0.0)")
_agg("agg_percent_good", "percent_good", f"avg(CASE WHEN {_GOOD} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)")

_ALL = ["average", "time_average", "minimum", "maximum", "sum", "stddev_pop", "first", "last", "percent_good"]


@register("bucket_aggregates", f"""{_W}, b AS (SELECT *, us - us % {HOUR} AS bucket FROM p),
n AS (SELECT *, lead(us) OVER (PARTITION BY tag_id, bucket ORDER BY us, seq) AS nu, lead(value) OVER (PARTITION BY tag_id, bucket ORDER BY us, seq) AS nv FROM b)
SELECT tag_id, bucket, bucket + {HOUR} AS bucket_end, count(*) AS sample_count, round(avg(value), 6) + 0.0 AS average,
round(coalesce(sum({_AREA}) / nullif(sum(CASE WHEN {_AREA} IS NOT NULL THEN {_DT} END), 0), {_FIRST}), 6) + 0.0 AS time_average,
round(min(value), 6) + 0.0 AS minimum, round(max(value), 6) + 0.0 AS maximum, round(coalesce(sum(value), 0.0), 6) + 0.0 AS sum, round(stddev_pop(value), 6) + 0.0 AS stddev_pop,
round({_FIRST}, 6) + 0.0 AS first, round({_LAST}, 6) + 0.0 AS last, round(avg(CASE WHEN {_GOOD} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS percent_good
FROM n GROUP BY tag_id, bucket""")
def _bucket_aggregates(spark, sf_dir):
    return _round(A.bucketed(from_events(spark, sf_dir), HOUR, _ALL), *_ALL)


@register("bucketed_day_twa", f"""{_W}, b AS (SELECT *, us - us % {DAY} AS bucket FROM p),
n AS (SELECT *, lead(us) OVER (PARTITION BY tag_id, bucket ORDER BY us, seq) AS nu, lead(value) OVER (PARTITION BY tag_id, bucket ORDER BY us, seq) AS nv FROM b)
SELECT tag_id, bucket, bucket + {DAY} AS bucket_end, count(*) AS sample_count,
round(coalesce(sum({_AREA}) / nullif(sum(CASE WHEN {_AREA} IS NOT NULL THEN {_DT} END), 0), {_FIRST}), 6) + 0.0 AS time_average,
round(avg(CASE WHEN {_GOOD} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS percent_good FROM n GROUP BY tag_id, bucket""")
def _day_twa(spark, sf_dir):
    return _round(A.bucketed(from_events(spark, sf_dir), DAY, ["time_average", "percent_good"]), "time_average", "percent_good")


@register("bucketed_dense", f"""{_W}, a AS (SELECT tag_id, us - us % {DAY} AS bucket, count(*) AS c, avg(value) AS v FROM p GROUP BY ALL),
g AS (SELECT tag_id, unnest(range(min(bucket), max(bucket) + 1, {DAY})) AS bucket FROM a GROUP BY tag_id)
SELECT g.tag_id, g.bucket, g.bucket + {DAY} AS bucket_end, coalesce(c, 0) AS sample_count, round(v, 6) + 0.0 AS average FROM g LEFT JOIN a ON g.tag_id = a.tag_id AND g.bucket = a.bucket""")
def _dense(spark, sf_dir):
    return _round(A.bucketed(from_events(spark, sf_dir), DAY, ["average"], dense=True), "average")


@register("bucketed_offset", f"""{_W}, b AS (SELECT tag_id, us - ((us - {6 * HOUR}) % {DAY} + {DAY}) % {DAY} AS bucket, value FROM p)
SELECT tag_id, bucket, bucket + {DAY} AS bucket_end, count(*) AS sample_count, round(max(value), 6) + 0.0 AS maximum FROM b GROUP BY tag_id, bucket""")
def _offset(spark, sf_dir):
    return _round(A.bucketed(from_events(spark, sf_dir), DAY, ["maximum"], origin=6 * HOUR), "maximum")


@register("running_stats", f"""{_W} SELECT tag_id, us, seq, count(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS run_count, round(sum(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS run_sum,
round(avg(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS run_avg, min(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS run_min, max(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS run_max,
round(stddev_pop(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS run_stddev FROM p""")
def _running(spark, sf_dir):
    return _round(A.running(from_events(spark, sf_dir)).withColumn("run_avg", r6(F.col("run_avg"), 9)), "run_sum", "run_stddev")


@register("distribution_stats", f"""{_W} SELECT tag_id, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS stddev, round(skewness(value), 6) + 0.0 AS skewness,
round(kurtosis(value), 6) + 0.0 AS kurtosis, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.1), 6) + 0.0 AS p10, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50,
round(quantile_cont(value, 0.9), 6) + 0.0 AS p90, round((max(us) - min(us)) / 3.6e9, 6) + 0.0 AS hours FROM p GROUP BY tag_id""")
def _distribution(spark, sf_dir):
    return _round(A.distribution(from_events(spark, sf_dir)), "mean", "stddev", "skewness", "kurtosis", "p10", "p50", "p90", "hours")


@register("regression", f"""{_W}, x AS (SELECT *, (us - min(us) OVER (PARTITION BY tag_id)) / 1e6 AS x FROM p)
SELECT tag_id, round(regr_slope(value, x), 9) + 0.0 AS slope, round(regr_intercept(value, x), 6) + 0.0 AS intercept, round(regr_r2(value, x), 6) + 0.0 AS r2, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY tag_id""")
def _regression(spark, sf_dir):
    out = A.regression(from_events(spark, sf_dir))
    return out.withColumn("slope", r6(F.col("slope"), 9)).withColumn("intercept", r6(F.col("intercept"))).withColumn("r2", r6(F.col("r2")))


_S, _E = 1_704_240_000_000_000, 1_705_000_000_000_000


@register("good_fraction", f"""{_W}, n AS (SELECT *, lead(us) {_O} AS nu, (CASE WHEN {_GOOD} THEN 1 ELSE 0 END + lead(CASE WHEN {_GOOD} THEN 1 ELSE 0 END) {_O}) / 2.0::DOUBLE AS g FROM p)
SELECT tag_id, round(coalesce(sum(greatest(0, least(nu, {_E}) - greatest(us, {_S})) * g), 0.0) / ({_E} - {_S}), 6) + 0.0 AS good_fraction FROM n GROUP BY tag_id""")
def _good_fraction(spark, sf_dir):
    return _round(A.good_fraction(from_events(spark, sf_dir), _S, _E), "good_fraction")


@register("zscore", f"""{_W} SELECT tag_id, us, seq, round(coalesce((value - avg(value) OVER (PARTITION BY tag_id)) / nullif(stddev_samp(value) OVER (PARTITION BY tag_id), 0), 0.0), 6) + 0.0 AS z FROM p""")
def _zscore(spark, sf_dir):
    return _round(A.zscores(from_events(spark, sf_dir)), "z")


@register("outlier_iqr", f"""{_W}, q AS (SELECT tag_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM p GROUP BY tag_id HAVING count(value) >= 4)
SELECT p.tag_id, us, seq, value FROM p JOIN q ON p.tag_id = q.tag_id WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def _outlier(spark, sf_dir):
    return A.tukey_outliers(from_events(spark, sf_dir))


@register("cross_correlation", f"{_W}, l AS (SELECT *, lead(value, 3) {_O} AS y FROM p) SELECT tag_id, round(avg(value * y), 6) + 0.0 AS cross_correlation FROM l GROUP BY tag_id")
def _xcorr(spark, sf_dir):
    return _round(A.cross_correlation(from_events(spark, sf_dir), 3), "cross_correlation")


@register("signal_energy", f"{_W} SELECT tag_id, round(sum(value * value), 6) + 0.0 AS energy FROM p GROUP BY tag_id")
def _energy(spark, sf_dir):
    return _round(A.signal_energy(from_events(spark, sf_dir)), "energy")


@register("symbol_entropy", """WITH c AS (SELECT user_id AS tag_id, event_type, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT tag_id, sum(c) AS n FROM c GROUP BY tag_id)
SELECT c.tag_id, round(-sum((c / n) * log2(c / n)), 6) + 0.0 AS entropy, count(*) AS symbols FROM c JOIN t ON c.tag_id = t.tag_id GROUP BY c.tag_id""")
def _entropy(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("tag_id"), "event_type")
    return _round(A.entropy(e, ("tag_id",), "event_type"), "entropy")


@register("lag_lead", f"{_W} SELECT tag_id, us, seq, lag(value, 2) {_O} AS lag_value, lead(value, 2) {_O} AS lead_value FROM p")
def _lag(spark, sf_dir):
    return W.lag_lead(from_events(spark, sf_dir), 2)


@register("moving_avg_trailing", f"{_W} SELECT tag_id, us, seq, round(avg(value) {_O[:-1]} ROWS 4 PRECEDING), 6) + 0.0 AS average FROM p")
def _trailing(spark, sf_dir):
    return _round(W.moving_average(from_events(spark, sf_dir), 5), "average")


@register("moving_avg_centered", f"{_W} SELECT tag_id, us, seq, round(avg(value) {_O[:-1]} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS average FROM p")
def _centered(spark, sf_dir):
    return _round(W.moving_average(from_events(spark, sf_dir), 5, "centered"), "average")


@register("cumulative_sum", f"{_W} SELECT tag_id, us, seq, round(sum(value) {_O[:-1]} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS total FROM p")
def _cumulative(spark, sf_dir):
    return _round(W.cumulative_sum(from_events(spark, sf_dir)), "total")


@register("roc_central", f"""{_W}, n AS (SELECT *, coalesce(lag(value) {_O}, value) AS v0, coalesce(lag(us) {_O}, us) AS t0, coalesce(lead(value) {_O}, value) AS v1, coalesce(lead(us) {_O}, us) AS t1 FROM p)
SELECT tag_id, us, seq, round((v1 - v0) / nullif((t1 - t0) / 1e6, 0), 9) + 0.0 AS rate FROM n""")
def _roc(spark, sf_dir):
    return W.rate_of_change(from_events(spark, sf_dir)).withColumn("rate", r6(F.col("rate"), 9))


@register("gaps", f"{_W}, n AS (SELECT tag_id, lag(us) {_O} AS gap_start, us AS gap_end FROM p) SELECT *, gap_end - gap_start AS gap FROM n WHERE gap_end - gap_start > {6 * HOUR}")
def _gaps(spark, sf_dir):
    return W.gaps(from_events(spark, sf_dir), 6 * HOUR)


@register("roc_events", f"""{_W}, a AS (SELECT *, (value - lag(value) {_O}) / nullif((us - lag(us) {_O}) / 1e6, 0) AS roc FROM p), f AS (SELECT *, coalesce(abs(roc) > 0.01, false) AS f FROM a),
s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) {_O}, false) THEN 1 ELSE 0 END AS st FROM f), i AS (SELECT *, CAST(sum(st) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)
SELECT tag_id, island, min(us) AS start_us, max(us) AS end_us, count(*) AS n, round(max(abs(roc)), 6) + 0.0 AS peak FROM i WHERE f GROUP BY tag_id, island""")
def _roc_events(spark, sf_dir):
    return _round(W.roc_events(from_events(spark, sf_dir), 0.01), "peak")


@register("crossings_up", f"{_W}, n AS (SELECT *, lag(value) {_O} AS b FROM p) SELECT tag_id, us, seq, value FROM n WHERE b <= 50 AND value > 50")
def _up(spark, sf_dir):
    return W.crossings(from_events(spark, sf_dir), 50.0)


@register("peaks", f"{_W}, n AS (SELECT *, lag(value) {_O} AS a, lead(value) {_O} AS b FROM p) SELECT tag_id, us, seq, value FROM n WHERE value > a AND value > b AND value > 60")
def _peaks(spark, sf_dir):
    return W.peaks(from_events(spark, sf_dir), 60.0)


@register("cusum", f"""{_W}, s AS (SELECT *, sum(value - 45 - 5) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS u, sum(45 - value - 5) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS d FROM p),
c AS (SELECT *, u - least(0.0, min(u) {_O[:-1]} ROWS UNBOUNDED PRECEDING)) AS h, d - least(0.0, min(d) {_O[:-1]} ROWS UNBOUNDED PRECEDING)) AS l FROM s)
SELECT tag_id, us, seq, round(h, 6) + 0.0 AS high, round(l, 6) + 0.0 AS low, h > 100 OR l > 100 AS alarm FROM c""")
def _cusum(spark, sf_dir):
    return _round(W.cusum(from_events(spark, sf_dir), 45.0, 5.0, 100.0), "high", "low")


@register("ema", f"""{_W}, l AS (SELECT tag_id, list(value ORDER BY us, seq) AS v FROM p WHERE value IS NOT NULL GROUP BY tag_id)
SELECT tag_id, round(list_reduce(v, lambda a, x : 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) + 0.0 AS ema FROM l""")
def _ema(spark, sf_dir):
    return _round(W.ema_last(from_events(spark, sf_dir), 0.3), "ema")


@register("ema_series", EMA_SQL)
def _ema_series(spark, sf_dir):
    return _round(W.ema(from_events(spark, sf_dir), 0.3), "ema")


@register("exception_events", f"""{_W}, n AS (SELECT *, lag(quality) {_O} AS pq, lag(value) {_O} AS pv, lag(us) {_O} AS pt FROM p),
k AS (SELECT *, CASE WHEN (quality & 192) = 0 AND (pq & 192) <> 0 THEN 'BAD_QUALITY' WHEN (pq & 192) = 0 AND (quality & 192) <> 0 THEN 'RECOVERED' WHEN (quality & 192) <> (pq & 192) THEN 'QUALITY_CHANGE'
WHEN abs(value - pv) >= 60 THEN 'STEP' WHEN abs(value - pv) / nullif((us - pt) / 1e6, 0) >= 0.5 THEN 'RATE' WHEN value < 5 THEN 'LOW' WHEN value > 90 THEN 'HIGH' END AS kind FROM n)
SELECT tag_id, us, seq, value, kind FROM k WHERE kind IS NOT NULL""")
def _exceptions(spark, sf_dir):
    return W.exceptions(from_events(spark, sf_dir), 60.0, 0.5, 5.0, 90.0)


@register("threshold_trigger", f"{_W}, n AS (SELECT *, lag(value) {_O} AS b FROM p) SELECT tag_id, us, seq, value FROM n WHERE b <= 45 AND value >= 55")
def _trigger(spark, sf_dir):
    return W.threshold_trigger(from_events(spark, sf_dir), 50.0, 5.0)


@register("digital_held", f"""{_W}, s AS (SELECT *, (quality & 192) = 192 AS s FROM p), c AS (SELECT *, CASE WHEN coalesce(s <> lag(s) {_O}, true) THEN 1 ELSE 0 END AS ch FROM s),
r AS (SELECT *, CAST(sum(ch) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c), h AS (SELECT *, min(us) OVER (PARTITION BY tag_id, run) AS start_us FROM r)
SELECT tag_id, run, min(us) AS fired_us, any_value(start_us) AS start_us, any_value(s) AS state FROM h WHERE us >= start_us + {HOUR} GROUP BY tag_id, run""")
def _held(spark, sf_dir):
    return W.state_held(from_events(spark, sf_dir), F.col("quality").bitwiseAND(F.lit(192)) == 192, HOUR)


_SUM = "count(*) AS n, round(avg(value), 6) + 0.0 AS average, coalesce(arg_max(quality, CASE WHEN quality < 192 THEN struct_pack(us := us, seq := seq) END), 192) AS window_quality"


@register("tumbling_first_origin", f"""{_W}, o AS (SELECT *, min(us) OVER (PARTITION BY tag_id) AS o FROM p), w AS (SELECT *, us - (us - o) % {DAY} AS start_us FROM o)
SELECT tag_id, start_us, {_SUM}, start_us + {DAY} AS end_us FROM w GROUP BY tag_id, start_us""")
def _tumbling(spark, sf_dir):
    return _round(W.tumbling(from_events(spark, sf_dir), DAY), "average")


@register("tumbling_epoch", f"{_W}, w AS (SELECT *, us - us % {12 * HOUR} AS start_us FROM p) SELECT tag_id, start_us, {_SUM}, start_us + {12 * HOUR} AS end_us FROM w GROUP BY tag_id, start_us")
def _tumbling_epoch(spark, sf_dir):
    return _round(W.calendar(from_events(spark, sf_dir), 12 * HOUR), "average")


@register("calendar_offset", f"{_W}, w AS (SELECT *, us - (us - {6 * HOUR}) % {DAY} AS start_us FROM p) SELECT tag_id, start_us, {_SUM}, start_us + {DAY} AS end_us FROM w GROUP BY tag_id, start_us")
def _calendar(spark, sf_dir):
    return _round(W.calendar(from_events(spark, sf_dir), DAY, 6 * HOUR), "average")


@register("sliding", f"""{_W}, o AS (SELECT *, min(us) OVER (PARTITION BY tag_id) AS o FROM p),
w AS (SELECT *, o + unnest(range(greatest(0, CAST(floor((us - o - {DAY}) / {6 * HOUR}) AS BIGINT) + 1), (us - o) // {6 * HOUR} + 1)) * {6 * HOUR} AS start_us FROM o)
SELECT tag_id, start_us, {_SUM}, start_us + {DAY} AS end_us FROM w GROUP BY tag_id, start_us""")
def _sliding(spark, sf_dir):
    return _round(W.sliding(from_events(spark, sf_dir), DAY, 6 * HOUR), "average")


@register("session", f"""{_W}, f AS (SELECT *, CASE WHEN coalesce(us - lag(us) {_O} > {6 * HOUR}, true) THEN 1 ELSE 0 END AS f FROM p), s AS (SELECT *, CAST(sum(f) {_O[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)
SELECT tag_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n, round(avg(value), 6) + 0.0 AS average FROM s GROUP BY tag_id, session""")
def _session(spark, sf_dir):
    return _round(W.sessions(from_events(spark, sf_dir), 6 * HOUR), "average")


@register("row_blocks", f"""{_W}, b AS (SELECT *, (row_number() {_O} - 1) // 10 AS block FROM p)
SELECT tag_id, block, round(avg(value), 6) + 0.0 AS average, min(value) AS low, max(value) AS high FROM b GROUP BY tag_id, block HAVING count(*) = 10""")
def _blocks(spark, sf_dir):
    return _round(W.row_blocks(from_events(spark, sf_dir), 10), "average")


@register("every_kth", f"{_W}, b AS (SELECT *, row_number() {_O} AS r FROM p) SELECT tag_id, us, seq, value FROM b WHERE (r - 1) % 7 = 0")
def _kth(spark, sf_dir):
    return W.every_kth(from_events(spark, sf_dir), 7)


@register("envelope", f"""{_W}, b AS (SELECT *, min(us) OVER (PARTITION BY tag_id) AS lo, max(us) OVER (PARTITION BY tag_id) AS hi FROM p)
SELECT tag_id, CAST(floor((us - lo) * 20 / (hi - lo)) AS BIGINT) AS part, min(value) AS lower, max(value) AS upper FROM b WHERE us < hi GROUP BY ALL""")
def _envelope(spark, sf_dir):
    return W.envelope(from_events(spark, sf_dir), 20)


@register("alarm_rate", f"{_W} SELECT us - us % {10 * MINUTE} AS start_us, count(*) AS alarms, count(*) <= 1 AS acceptable FROM p WHERE value > 80 GROUP BY 1")
def _alarm_rate(spark, sf_dir):
    return W.alarm_rate(from_events(spark, sf_dir), 80.0, 10 * MINUTE, 1)
