"""Registered queries: frames by triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import triggers as R
from tidemark.operators.triggers import FrameTemplate, Trigger
from tidemark.plans.registry import register
from tidemark.points import DAY, POINTS_SQL, from_events

TEMPLATES = [
    FrameTemplate("high", (Trigger("up", 60.0, 5.0),), (Trigger("down", 40.0, 5.0),), 5 * DAY),
    FrameTemplate("low", (Trigger("down", 30.0, 2.0), Trigger("expression", signal="|value < 1")), (Trigger("up", 30.0),), 2 * DAY),
    FrameTemplate("spare", (Trigger("on", signal="Floor(|value / 50)"),), (Trigger("off", signal="Floor(|value / 50)"), Trigger("expression", signal="|value > 95"))),
]


@register("frames_by_triggers", f"""WITH RECURSIVE {POINTS_SQL}, s AS (SELECT tag_id, us, seq, value AS v, lag(value) OVER (PARTITION BY tag_id ORDER BY us, seq) AS b FROM p WHERE value IS NOT NULL),
f AS (SELECT tag_id, us, seq, 'high' AS template, {5 * DAY} AS lim, coalesce(b <= 55 AND v >= 65, false) AS st, coalesce(b >= 45 AND v <= 35, false) AS en FROM s
UNION ALL SELECT tag_id, us, seq, 'low', {2 * DAY}, coalesce(b >= 32 AND v <= 28, false) OR v < 1, coalesce(b <= 30 AND v >= 30, false) FROM s
UNION ALL SELECT tag_id, us, seq, 'spare', NULL, coalesce(floor(b / 50) = 0 AND floor(v / 50) <> 0, false), coalesce(floor(b / 50) <> 0 AND floor(v / 50) = 0, false) OR v > 95 FROM s),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tag_id, template ORDER BY us, seq) AS r FROM f WHERE st OR en),
w AS (SELECT tag_id, template, r, CASE WHEN st THEN us END AS o_us, CASE WHEN st THEN seq END AS o_seq, NULL::BIGINT AS c_us, NULL::BIGINT AS c_seq, NULL::BIGINT AS e_us, NULL::VARCHAR AS reason FROM n WHERE r = 1
UNION ALL SELECT n.tag_id, n.template, n.r,
  CASE WHEN o_us IS NULL OR n.us > o_us + lim OR n.en THEN CASE WHEN n.st THEN n.us END ELSE o_us END, CASE WHEN o_us IS NULL OR n.us > o_us + lim OR n.en THEN CASE WHEN n.st THEN n.seq END ELSE o_seq END,
  CASE WHEN n.us > o_us + lim OR n.en THEN o_us END, CASE WHEN n.us > o_us + lim OR n.en THEN o_seq END,
  CASE WHEN n.us > o_us + lim THEN o_us + lim WHEN n.en AND o_us IS NOT NULL THEN n.us END, CASE WHEN n.us > o_us + lim THEN 'limit' WHEN n.en AND o_us IS NOT NULL THEN 'end' END
  FROM w JOIN n ON n.tag_id = w.tag_id AND n.template = w.template AND n.r = w.r + 1)
SELECT tag_id, template, c_us AS start_us, c_seq AS start_seq, e_us AS end_us, reason FROM w WHERE c_us IS NOT NULL
UNION ALL SELECT tag_id, template, o_us, o_seq, -1, 'open' FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tag_id, template ORDER BY r DESC) = 1) WHERE o_us IS NOT NULL""")
def _frames(spark, sf_dir):
    return R.frames(from_events(spark, sf_dir), TEMPLATES).withColumn("end_us", F.coalesce("end_us", F.lit(-1)))
