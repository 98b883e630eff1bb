"""The one schema of time-series points, and adapters onto it.

tag_id BIGINT, us BIGINT (microseconds since 1970, UTC), seq BIGINT (order of equal
times), value DOUBLE (null where it is not finite), quality INT (OPC DA bits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column, spark: SparkSession) -> Column:
    """Microseconds of a time without zone, read as UTC."""
    t = ts.cast("timestamp")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        t = F.from_utc_timestamp(t, F.current_timezone())
    return F.unix_micros(t)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the events table: one tag for each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    quality = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 64).otherwise(192)
    return e.select(F.col("user_id").alias("tag_id"), micros(F.col("ts"), spark).alias("us"), F.col("event_id").alias("seq"), finite(F.col("value")).alias("value"), quality.alias("quality"))


def ordered(*keys: str) -> Window:
    """Points of a series in time order."""
    return Window.partitionBy(*(keys or ("tag_id",))).orderBy("us", "seq")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


#: The same points in DuckDB SQL, as the first member of a WITH list.
POINTS_SQL = """p AS (SELECT user_id AS tag_id, epoch_us(ts) AS us, event_id AS seq,
  CASE WHEN isfinite(value) THEN value END AS value,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 64 ELSE 192 END AS quality FROM events)"""
