"""Streaming forms: windowed aggregates with watermarks, and per-series state.

Windowed aggregates are built-in streaming aggregation. Rules that carry state from
point to point (deadband, alarm latch, latest value) run in
applyInPandasWithState, keyed by series; a batch of a series is put in time order
before it is applied, and rows older than a series' state take no part. State ends when a
series has been idle for long enough by event time, if that is asked for; the series then
begins anew. Rules that must wait for late points instead are in `frames`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark, path: str, schema, max_files: int = 1) -> DataFrame:
    """Points of a growing folder of Parquet files with the events schema, with their time as `ts`."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    quality = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 64).otherwise(192)
    t = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("tag_id"), t.alias("ts"), F.unix_micros(t).alias("us"), F.col("event_id").alias("seq"), "value", quality.alias("quality"))


def windowed(points: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, mean and extremes by series and window; rows later than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = points.withWatermark("ts", late).groupBy("tag_id", w.alias("w"))
    out = g.agg(F.count("*").alias("n"), F.avg("value").alias("average"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("tag_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "average", "low", "high")


def sessions(points: DataFrame, gap: str, late: str) -> DataFrame:
    g = points.withWatermark("ts", late).groupBy("tag_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("tag_id", F.col("w.start").alias("start"), "last", "n")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["us", "seq"])


_POINT = "tag_id long, us long, seq long, value double"


def _carried(points: DataFrame, rule, begin: tuple, schema: str, state: str, idle_us: int | None) -> DataFrame:
    """Rows that rule(carried, us, seq, value) gives: (carried, row or None) point by point, from `begin` on.

    idle_us needs points with a watermark on ts.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        *carried, at = held.get if held.exists else (*begin, None)
        p, out = _in_order(batches).dropna(subset=["value"]), []
        for us, seq, v in zip(p["us"].tolist(), p["seq"].tolist(), p["value"].tolist(), strict=True):
            if at is None or us >= at:
                carried, row = rule(carried, us, seq, v)
                at = us
                out += [(key[0], *row)] if row else []
        if at is not None:
            held.update((*carried, at))
            if idle_us is not None:
                held.setTimeoutTimestamp(max(at // 1000, held.getCurrentWatermarkMs()) + idle_us // 1000 + 1)
        yield pd.DataFrame(out, columns=names)

    ends = GroupStateTimeout.NoTimeout if idle_us is None else GroupStateTimeout.EventTimeTimeout
    return points.groupBy("tag_id").applyInPandasWithState(step, schema, f"{state}, at long", "append", ends)


def deadband(points: DataFrame, width: float, idle_us: int | None = None) -> DataFrame:
    """Points that leave the band around the last kept value of their series."""

    def rule(carried: list, us: int, seq: int, v: float) -> tuple:
        (last,) = carried
        return ([v], (us, seq, v)) if last is None or abs(v - last) > width else (carried, None)

    return _carried(points, rule, (None,), _POINT, "last double", idle_us)


def latched_alarms(points: DataFrame, high: float, deadband: float, idle_us: int | None = None) -> DataFrame:
    """Changes of a high alarm that holds until the value is back by the deadband."""

    def rule(carried: list, us: int, seq: int, v: float) -> tuple:
        (on,) = carried
        now = v >= high or (on and v > high - deadband)
        return [now], ((us, seq, v, now) if now != on else None)

    return _carried(points, rule, (False,), _POINT + ", active boolean", "on boolean", idle_us)


def latest(points: DataFrame) -> DataFrame:
    """The latest point of each series, given again whenever it changes."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (-(1 << 62), -1, None)
        p = _in_order(batches).iloc[-1]
        if (int(p["us"]), int(p["seq"])) > at[:2]:
            state.update((int(p["us"]), int(p["seq"]), float(p["value"])))
            yield pd.DataFrame({"tag_id": [key[0]], "us": [int(p["us"])], "seq": [int(p["seq"])], "value": [float(p["value"])]})

    return points.groupBy("tag_id").applyInPandasWithState(step, _POINT, "us long, seq long, value double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now as a table, by one triggered run into memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def append_to_archive(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends points to a Parquet archive by day; a batch written twice is written once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date("ts").alias("day")
        batch.select("*", day, F.lit(batch_id).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
