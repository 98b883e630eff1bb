"""The point archive: Parquet by day, with appends, range scans and figures from metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.points import DAY

RECORD_BYTES = 24


def append(points: DataFrame, path: str) -> None:
    """Append points, in folders by day and sorted by series and time, so that scans prune both."""
    day = F.floor(F.col("us") / DAY).cast("int")
    rows = points.withColumn("day", day).repartition("day", F.pmod(F.hash("tag_id"), F.lit(8))).sortWithinPartitions("day", "tag_id", "us", "seq")
    rows.write.mode("append").partitionBy("day").parquet(path)


def scan(spark: SparkSession, path: str, tag_ids: tuple[int, ...] = (), start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Points of some series in [start, end]; days outside are not listed, other columns not read."""
    p = spark.read.parquet(path)
    if start_us is not None:
        p = p.where((F.col("day") >= start_us // DAY) & (F.col("us") >= start_us))
    if end_us is not None:
        p = p.where((F.col("day") <= end_us // DAY) & (F.col("us") <= end_us))
    return p.where(F.col("tag_id").isin(*tag_ids)) if tag_ids else p


def figures(points: DataFrame) -> DataFrame:
    """Count, oldest and newest time and estimated bytes of an archive."""
    return points.agg(F.count("*").alias("events"), F.min("us").alias("oldest_us"), F.max("us").alias("newest_us"), (F.count("*") * RECORD_BYTES).alias("bytes"))


def find_value(points: DataFrame, target: float, tolerance: float) -> DataFrame:
    return points.where(F.abs(F.col("value") - target) <= tolerance)


def snapshot_difference(latest: DataFrame, a: int, b: int) -> DataFrame:
    """Difference of the latest values of two series."""
    x, y = latest.where(F.col("tag_id") == a).select(F.col("value").alias("x")), latest.where(F.col("tag_id") == b).select(F.col("value").alias("y"))
    return x.join(y).select((F.col("x") - F.col("y")).alias("difference"))


def expire(points: DataFrame, now_us: int, max_age_us: int) -> DataFrame:
    return points.where(F.lit(now_us) - F.col("us") <= max_age_us)
