"""Streams over the events table give what the batch operators give."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import compress as C
from tidemark.points import DAY, from_events
from tidemark.streaming import stateful as T


def _folder(spark, sf, tmp_path):
    """Six files, one after the other in time; a stream reads one a micro-batch."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    for k, f in enumerate(sorted((tmp_path / "events").glob("part-*.parquet"))):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(tmp_path / "events"), e.schema


def _batches(checkpoint):
    return len([f for f in (checkpoint / "commits").iterdir() if f.name.isdigit()])


def test_windowed(spark, sf, tmp_path):
    path, schema = _folder(spark, sf, tmp_path)
    out = T.run_once(T.windowed(T.event_stream(spark, path, schema), "1 day", "1 hour"), "w", str(tmp_path / "c"), "append")
    batch = from_events(spark, sf).groupBy("tag_id", (F.col("us") - F.pmod("us", F.lit(DAY))).alias("b")).agg(F.count("*").alias("n"))
    got = {(r["tag_id"], r["start"].timestamp() // 86400): r["n"] for r in out.collect()}
    want = {(r["tag_id"], r["b"] // DAY): r["n"] for r in batch.collect()}
    assert _batches(tmp_path / "c") >= 6 and len(got) > len(want) / 2 and all(want[k] == n for k, n in got.items())


def test_deadband_matches_batch(spark, sf, tmp_path):
    path, schema = _folder(spark, sf, tmp_path)
    stream = T.deadband(T.event_stream(spark, path, schema), 20.0)
    got = {r["seq"] for r in T.run_once(stream, "d", str(tmp_path / "c")).collect()}
    want = {r["seq"] for r in C.deadband(from_events(spark, sf), 20.0).collect()}
    assert got == want and _batches(tmp_path / "c") >= 6


def test_state_ends_with_idleness(spark, sf, tmp_path):
    """A series that was idle for longer than a day and whose state is gone begins anew: its next point is kept."""
    path, schema = _folder(spark, sf, tmp_path)
    stream = T.deadband(T.event_stream(spark, path, schema).withWatermark("ts", "1 hour"), 1e9, DAY)
    got = T.run_once(stream, "idle", str(tmp_path / "c")).groupBy("tag_id").count()
    assert got.count() == from_events(spark, sf).select("tag_id").distinct().count()
    # every further kept point follows a pause of over a day
    kept = spark.table("idle")
    w = Window.partitionBy("tag_id").orderBy("us")
    pause = from_events(spark, sf).withColumn("pause", F.col("us") - F.lag("us").over(w))
    assert kept.join(pause.where(F.col("pause") <= DAY), "seq").isEmpty()


def test_latest_and_alarms(spark, sf, tmp_path):
    path, schema = _folder(spark, sf, tmp_path)
    out = T.run_once(T.latest(T.event_stream(spark, path, schema)), "l", str(tmp_path / "c"), "update")
    best = out.groupBy("tag_id").agg(F.max("us").alias("us"))
    want = from_events(spark, sf).groupBy("tag_id").agg(F.max("us").alias("us"))
    assert best.exceptAll(want).isEmpty() and want.exceptAll(best).isEmpty()
    alarms = T.run_once(T.latched_alarms(T.event_stream(spark, path, schema), 80.0, 5.0), "a", str(tmp_path / "c2"))
    assert alarms.where("active and value < 80").isEmpty() and _batches(tmp_path / "c2") >= 6
    got, on = {}, {}
    for r in from_events(spark, sf).where("value is not null").orderBy("us", "seq").collect():
        now = r["value"] >= 80 or (on.get(r["tag_id"], False) and r["value"] > 75)
        if now != on.get(r["tag_id"], False):
            got[r["seq"]] = now
        on[r["tag_id"]] = now
    assert got and {r["seq"]: r["active"] for r in alarms.collect()} == got


def test_archive_sink(spark, sf, tmp_path):
    path, schema = _folder(spark, sf, tmp_path)
    T.append_to_archive(T.event_stream(spark, path, schema, 2), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(path).count()
