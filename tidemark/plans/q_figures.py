"""Registered queries: reconstruction figures, thresholds, block transforms, regions, tombstones, template checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import figures as G
from tidemark.plans.registry import register
from tidemark.points import POINTS_SQL, from_events, r6


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("reconstruction_figures", f"""WITH {POINTS_SQL}, s AS (SELECT tag_id, avg((value - floor(value)) * (value - floor(value))) AS mse, max(abs(value - floor(value))) AS largest, max(value) - min(value) AS r FROM p WHERE value IS NOT NULL GROUP BY tag_id)
SELECT tag_id, round(mse, 6) + 0.0 AS mse, round(largest, 6) + 0.0 AS largest, CASE WHEN mse = 0 THEN 200 WHEN r > 0 THEN round(10 * log10(r * r / mse), 6) + 0.0 END AS psnr FROM s""")
def _figures(spark, sf_dir):
    s = G.reconstruction(from_events(spark, sf_dir), F.floor("value").cast("double"))
    return s.select("tag_id", *[r6(F.col(c)).alias(c) for c in ("mse", "largest", "psnr")])


@register("universal_threshold", f"WITH {POINTS_SQL} SELECT tag_id, round(median(abs(value)) / 0.6745::DOUBLE * sqrt(2 * ln(count(*))), 6) + 0.0 AS threshold FROM p WHERE value IS NOT NULL GROUP BY tag_id")
def _universal(spark, sf_dir):
    return G.universal_threshold(from_events(spark, sf_dir)).withColumn("threshold", r6(F.col("threshold")))


@register("deadband_estimate", f"""WITH {POINTS_SQL}, z AS (SELECT seq, (value - 20) / 200 AS z FROM p), t AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911::DOUBLE * (abs(z) / sqrt(2))) AS t FROM z), u AS (SELECT seq, z, ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x) AS tail FROM t)
SELECT seq, round(1 / CASE WHEN z >= 0 THEN tail ELSE 2 - tail END, 4) + 0.0 AS ratio FROM u""")
def _estimate(spark, sf_dir):
    return from_events(spark, sf_dir).select("seq", r6(G.deadband_estimate((F.col("value") - 20) / 200), 4).alias("ratio"))


_BLOCKS = f"""{POINTS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY us, seq) - 1 AS r FROM p WHERE value IS NOT NULL), b AS (SELECT tag_id, r // 8 AS block, r % 8 AS i, value FROM q QUALIFY count(*) OVER (PARTITION BY tag_id, r // 8) = 8)"""


@register("dft_blocks", f"""WITH {_BLOCKS} SELECT tag_id, block, CAST(k AS INTEGER) AS k, round(sum(value * cos(-2 * pi() / 8 * ((i * k) % 8))), 4) + 0.0 AS re, round(sum(value * sin(-2 * pi() / 8 * ((i * k) % 8))), 4) + 0.0 AS im FROM b, range(8) f(k) GROUP BY ALL""")
def _dft(spark, sf_dir):
    return G.dft(G.blocks(from_events(spark, sf_dir), 8), 8).select("tag_id", "block", "k", r6(F.col("re"), 4).alias("re"), r6(F.col("im"), 4).alias("im"))


@register("dft_inverse", f"WITH {_BLOCKS} SELECT tag_id, block, CAST(i AS INTEGER) AS i, round(value, 6) + 0.0 AS value FROM b")
def _inverse(spark, sf_dir):
    return G.inverse_dft(G.dft(G.blocks(from_events(spark, sf_dir), 8), 8), 8).withColumn("value", r6(F.col("value")))


@register("region_boxes", """SELECT l_orderkey, min(l_partkey) AS x, min(l_suppkey) AS y, max(l_partkey + l_linenumber - 1) - min(l_partkey) AS w, max(l_suppkey + 5) - min(l_suppkey) AS h FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey""")
def _boxes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), (F.col("l_linenumber") - 1).alias("w"), F.lit(5).alias("h"))
    return G.bounding_boxes(li, "l_orderkey")


@register("compact_records", f"""WITH {POINTS_SQL}, d AS (SELECT tag_id, max(us) AS dead FROM p WHERE quality = 0 GROUP BY tag_id) SELECT seq, tag_id, us FROM p LEFT JOIN d USING (tag_id) WHERE dead IS NULL OR us > dead""")
def _compact(spark, sf_dir):
    p = from_events(spark, sf_dir)
    return G.compact(p, p.where("quality = 0"), "tag_id").select("seq", "tag_id", "us")


@register("template_errors", """SELECT p_size AS template, CAST(count_if(p_partkey % 10 = 0) AS BIGINT) AS unnamed, CAST(count_if(p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_retailprice < 1200) AS BIGINT) AS unset FROM part GROUP BY p_size""")
def _templates(spark, sf_dir):
    k = F.col("p_partkey")
    a = _t(spark, sf_dir, "part").select(F.col("p_size").alias("template"), F.when(k % 10 != 0, F.col("p_name")).alias("name"), (k % 2 == 0).alias("required"), F.when(k % 3 == 0, "0").otherwise("").alias("default_value"), F.when(F.col("p_retailprice") >= 1200, "tag").alias("reference"))
    return G.template_errors(a)
