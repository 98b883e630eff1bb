"""Simulated series over the times of real ones, for trying queries without a plant's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.points import ordered


def wave(points: DataFrame, height: float = 100.0, step: float = 0.1) -> DataFrame:
    """A sine wave at the times of points: height * sin(step * i) at the i-th point of each series, all good."""
    i = F.row_number().over(ordered()) - 1
    return points.select("tag_id", "us", "seq", (height * F.sin(step * i)).alias("value"), F.lit(192).alias("quality"))


def ramp(spark: SparkSession, rows: int, end_us: int) -> DataFrame:
    """One series that rises by 1.5 a second and ends at a given time."""
    return spark.range(rows).selectExpr("1L AS tag_id", f"{end_us}L - ({rows}L - 1 - id) * 1000000L AS us", "id AS seq", "id * 1.5D AS value", "192 AS quality")
