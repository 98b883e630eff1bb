"""Registered queries: times, status words, topics, point types, attribute sets, formula functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.plans.expression import compile_formula
from tidemark.plans.registry import register
from tidemark.points import DAY, POINTS_SQL, from_events, micros, ordered, r6


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Quality names by an event's k, an unknown one among them.
_KINDS = [*R.STATUS_WORDS, "OTHER"]
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_WORDS = ", ".join(f"('{n}', {w})" for n, w in R.STATUS_WORDS.items())


@register("status_words", f"""WITH k AS (SELECT event_id, {_KINDS}[{_K} % {len(_KINDS)} + 1] AS quality FROM events), v AS (SELECT * FROM (VALUES {_WORDS}) AS t(quality, word)),
w AS (SELECT event_id, k.quality, CAST(coalesce(word, (SELECT word FROM v WHERE quality = 'BAD')) AS BIGINT) AS word FROM k LEFT JOIN v ON v.quality = k.quality)
SELECT event_id, quality, word, CASE WHEN word = 0 THEN 'GOOD' WHEN (word & 2147483648) <> 0 THEN 'BAD' WHEN (word & 1073741824) <> 0 THEN 'UNCERTAIN' ELSE 'QUESTIONABLE' END AS back FROM w""")
def _status(spark, sf_dir):
    names, k = F.array(*map(F.lit, _KINDS)), F.get_json_object("props", "$.k").cast("int")
    w = _t(spark, sf_dir, "events").select("event_id", F.get(names, k % len(_KINDS)).alias("quality")).withColumn("word", R.status_word(F.col("quality")))
    return w.withColumn("back", R.status_quality(F.col("word")))


@register("iso_parse", """SELECT event_id, epoch_us(ts) AS utc, epoch_us(ts) // 1000 * 1000 - 19800000000 AS shifted, true AS refused FROM events""")
def _iso(spark, sf_dir):
    us = micros(F.col("ts"), spark)
    wall = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))
    text = lambda pattern: F.date_format(wall, pattern)
    return _t(spark, sf_dir, "events").select(
        "event_id", R.iso_micros(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("utc"), R.iso_micros(text("yyyy-MM-dd HH:mm:ss.SSS'+05:30'")).alias("shifted"), R.iso_micros(text("dd.MM.yyyy")).isNull().alias("refused"))


@register("time_arithmetic", f"""WITH {POINTS_SQL} SELECT seq, CAST(CASE WHEN us < b THEN -1 WHEN us > b THEN 1 WHEN us = b THEN 0 END AS INTEGER) AS cmp, round((us - b) / 1000, 6) + 0.0 AS diff_ms, us - 1500000 AS moved, us // 1000 AS unix_ms
FROM p JOIN (SELECT seq + 1 AS seq, us AS b FROM p) USING (seq)""")
def _times(spark, sf_dir):
    p = from_events(spark, sf_dir)
    # The event with the id before, by an equi-join: a window over all rows would be one task.
    before = p.select((F.col("seq") + 1).alias("seq"), F.col("us").alias("b"))
    j = p.join(before, "seq")
    us, b = F.col("us"), F.col("b")
    return j.select("seq", R.compare(us, b).alias("cmp"), r6((us - b) / 1000).alias("diff_ms"), R.add_seconds(us, F.lit(-1.5)).alias("moved"), F.floor(us / 1000).cast("long").alias("unix_ms"))


@register("range_meet", """WITH r AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS s1, epoch_us(l_shipdate) + 864000000000 AS e1, epoch_us(l_shipdate) + (l_linenumber * 5 - 15) * 86400000000 AS s2, epoch_us(l_shipdate) + (l_linenumber * 5 - 13) * 86400000000 AS e2 FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN greatest(s1, s2) <= least(e1, e2) THEN greatest(s1, s2) END, -1) AS first, coalesce(CASE WHEN greatest(s1, s2) <= least(e1, e2) THEN least(e1, e2) END, -1) AS last FROM r""")
def _meet(spark, sf_dir):
    s1 = micros(F.col("l_shipdate"), spark)
    s2 = s1 + (F.col("l_linenumber") * 5 - 15) * DAY
    first, last = (F.coalesce(c, F.lit(-1)) for c in R.range_meet(s1, s1 + 10 * DAY, s2, s2 + 2 * DAY))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


_TOPIC_SQL = f"""CASE {_K} % 8 WHEN 0 THEN '' WHEN 1 THEN event_type || '/+/' || user_id WHEN 2 THEN event_type || '/#' WHEN 3 THEN '#/' || event_type WHEN 4 THEN event_type || '+/' || user_id WHEN 5 THEN event_type || '//' || user_id
WHEN 6 THEN '/' || user_id || '#' ELSE event_type || '/' || user_id || '/' || event_id END"""


@register("topic_rules", f"""WITH t AS (SELECT event_id, {_TOPIC_SQL} AS topic FROM events), l AS (SELECT event_id, topic, string_split(topic, '/') AS s FROM t)
SELECT event_id, topic, topic <> '' AND NOT contains(topic, '+') AND NOT contains(topic, '#') AS is_topic,
topic <> '' AND len(list_filter(s, lambda x: contains(x, '+') AND x <> '+')) = 0 AND len(list_filter(s, lambda x: contains(x, '#') AND x <> '#')) = 0 AND NOT list_contains(s[:len(s) - 1], '#') AS is_filter FROM l""")
def _topics(spark, sf_dir):
    k, e, u = F.get_json_object("props", "$.k").cast("int") % 8, F.col("event_type"), F.col("user_id").cast("string")
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    made = [F.lit(""), join(e, "/+/", u), join(e, "/#"), join("#/", e), join(e, "+/", u), join(e, "//", u), join("/", u, "#"), join(e, "/", u, "/", F.col("event_id").cast("string"))]
    t = _t(spark, sf_dir, "events").select("event_id", F.get(F.array(*made), k).alias("topic"))
    return t.select("event_id", "topic", R.topic_valid(F.col("topic")).alias("is_topic"), R.topic_filter_valid(F.col("topic")).alias("is_filter"))


_TYPES = [*R.TYPE_BYTES, "OTHER"]
_BYTES = ", ".join(f"('{n}', {b}, {str(n in R.NUMERIC_TYPES).lower()})" for n, b in R.TYPE_BYTES.items())


@register("point_types", f"""WITH k AS (SELECT p_partkey, {_TYPES}[p_size % {len(_TYPES)} + 1] AS kind FROM part), v AS (SELECT * FROM (VALUES {_BYTES}) AS t(kind, bytes, numeric))
SELECT p_partkey, k.kind, CAST(coalesce(bytes, 0) AS INTEGER) AS bytes, coalesce(numeric, false) AS numeric FROM k LEFT JOIN v ON v.kind = k.kind""")
def _types(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _TYPES)), F.col("p_size") % len(_TYPES))
    return _t(spark, sf_dir, "part").select("p_partkey", kind.alias("kind")).select("p_partkey", "kind", R.type_bytes(F.col("kind")).alias("bytes"), R.type_is_numeric(F.col("kind")).alias("numeric"))


@register("attribute_jaccard", """WITH o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), s AS (SELECT DISTINCT l_orderkey, l_suppkey % 7 AS a FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1), k AS (SELECT o_orderkey, b, count(*) AS k FROM o JOIN s x ON x.l_orderkey = o_orderkey JOIN s y ON y.l_orderkey = b AND y.a = x.a GROUP BY ALL)
SELECT o.o_orderkey, o.b AS other, round(coalesce(k.k / (na.n + nb.n - k.k), 0), 6) + 0.0 AS jaccard FROM o JOIN n na ON na.l_orderkey = o.o_orderkey JOIN n nb ON nb.l_orderkey = o.b LEFT JOIN k ON k.o_orderkey = o.o_orderkey AND k.b = o.b""")
def _jaccard(spark, sf_dir):
    attrs = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("names"))
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(attrs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = o.select("o_orderkey", "names", F.lag("o_orderkey").over(w).alias("other"), F.lag("names").over(w).alias("before")).where("names is not null and before is not null")
    return pairs.select("o_orderkey", "other", r6(R.jaccard(F.col("names"), F.col("before"))).alias("jaccard"))


@register("string_builder", "SELECT s_suppkey, s_name || ' (' || s_nationkey || ') {9} ' || s_name AS text FROM supplier")
def _builder(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", R.build_text("{0} ({1}) {9} {0}{2}", [F.col("s_name"), F.col("s_nationkey"), F.lit(None)]).alias("text"))


@register("metadata_errors", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 9 = 0 THEN -2 WHEN p_partkey % 7 = 0 THEN -3 WHEN p_size = 1 THEN -4 WHEN p_size = 2 THEN -5 WHEN p_size % 12 >= 10 THEN -6 WHEN p_retailprice < 950 THEN -7
WHEN p_size > 40 THEN -8 WHEN p_partkey % 5 = 0 THEN -9 ELSE 0 END AS INTEGER) AS code FROM part""")
def _metadata(spark, sf_dir):
    k, size, n = F.col("p_partkey"), F.col("p_size"), F.lit
    code = R.metadata_error(F.when(k % 9 == 0, -5).otherwise(k), F.when(k % 7 != 0, F.col("p_name")), (n(1.0), size.cast("double")), (n(2.0), size.cast("double")), size % 12, 10, F.col("p_retailprice") - 950, (size, n(40)), k % 5)
    return _t(spark, sf_dir, "part").select("p_partkey", code.cast("int").alias("code"))


@register("eu_values", "SELECT p_partkey, CAST(abs(p_size - 20) AS DOUBLE) AS range, (p_size + 20) / 2 AS midpoint, round(greatest(0.5, 5.0 * abs(p_size - 20) / 100), 6) + 0.0 AS deadband FROM part")
def _eu(spark, sf_dir):
    s, z = F.col("p_size").cast("double"), F.lit(20.0)
    return _t(spark, sf_dir, "part").select("p_partkey", F.abs(s - z).alias("range"), ((z + s) / 2).alias("midpoint"), r6(R.eu_deadband(z, s, F.lit(0.5), F.lit(5.0))).alias("deadband"))


@register("roc_per_minute", f"""WITH {POINTS_SQL}, x AS (SELECT *, lag(us) OVER w AS u0, lag(value) OVER w AS v0 FROM p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY tag_id ORDER BY us, seq))
SELECT seq, round((value - v0) / ((us - u0) / 6e7), 6) + 0.0 AS per_minute FROM x WHERE us > u0""")
def _roc(spark, sf_dir):
    w, us, v = ordered(), F.col("us"), F.col("value")
    p = from_events(spark, sf_dir).where("value is not null").select("seq", "us", "value", F.lag("us").over(w).alias("u0"), F.lag("value").over(w).alias("v0")).where("us > u0")
    return p.select("seq", r6((v - F.col("v0")) / ((us - F.col("u0")) / F.lit(6e7))).alias("per_minute"))


_FORMULAS = {
    "f_abs": "Abs(|value - 50)", "f_sqrt": "Sqrt(|value)", "f_ln": "Ln(|value + 1)", "f_exp": "Exp(|value / 100)", "f_sin": "Sin(|value)", "f_cos": "Cos(|value)", "f_tan": "Tan(|value / 1000)",
    "f_pow": "Pow(|value, 2)", "f_min": "Min(|value, 50, |quality)", "f_max": "Max(|value, 50, |quality)", "f_ceil": "Ceil(|value)", "f_floor": "Floor(|value)", "f_round": "Round(|value * 3)",
    "f_tagavg": "TagAvg(|value, |quality)", "f_tagmin": "TagMin(|value, |quality)", "f_tagmax": "TagMax(|value, |quality)",
}
_FORMULA_SQL = {
    "f_abs": "abs(value - 50)", "f_sqrt": "CASE WHEN value >= 0 THEN sqrt(value) END", "f_ln": "CASE WHEN value > -1 THEN ln(value + 1) END", "f_exp": "CASE WHEN value / 100 <= 700 THEN exp(value / 100) END", "f_sin": "sin(value)", "f_cos": "cos(value)",
    "f_tan": "tan(value / 1000)", "f_pow": "value * value", "f_min": "least(value, 50, quality)", "f_max": "greatest(value, 50, quality)", "f_ceil": "ceil(value)", "f_floor": "floor(value)", "f_round": "round(value * 3)",
    "f_tagavg": "(value + quality) / 2", "f_tagmin": "least(value, quality)", "f_tagmax": "greatest(value, quality)",
}


@register("formula_functions", f"WITH {POINTS_SQL} SELECT seq, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in _FORMULA_SQL.items()) + " FROM p WHERE value IS NOT NULL")
def _formulas(spark, sf_dir):
    return from_events(spark, sf_dir).where("value is not null").select("seq", *[r6(compile_formula(f)).alias(k) for k, f in _FORMULAS.items()])
