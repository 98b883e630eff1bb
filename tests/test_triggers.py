"""Event frames by triggers: by hand, at edges, and in a stream of many micro-batches."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import triggers as R
from tidemark.operators.triggers import FrameTemplate, Trigger
from tidemark.plans.q_triggers import TEMPLATES
from tidemark.points import from_events
from tidemark.streaming import frames as S
from tidemark.streaming import stateful as T


def points_of(spark, values, tag=1):
    return spark.createDataFrame([(tag, i * 10, i, v, 192) for i, v in enumerate(values)], "tag_id long, us long, seq long, value double, quality int")


def got(df):
    return sorted(tuple(r[c] for c in ("template", "start_us", "end_us", "reason")) for r in df.collect())


def test_thresholds_with_hysteresis_and_limits(spark):
    up = FrameTemplate("up", (Trigger("up", 5.0, 1.0),), (Trigger("down", 5.0, 1.0),))
    # 4.5 and 5.5 lie inside the band, so nothing fires there
    p = points_of(spark, [0.0, 7.0, 4.5, 5.5, 3.0, 9.0, 9.0, 1.0, 6.0])
    assert got(R.frames(p, [up])) == [("up", 10, 70, "end"), ("up", 80, None, "open")]
    sharp = FrameTemplate("sharp", (Trigger("up", 5.0),), (Trigger("down", 5.0),))
    assert got(R.frames(p, [sharp])) == [("sharp", 10, 20, "end"), ("sharp", 30, 40, "end"), ("sharp", 50, 70, "end"), ("sharp", 80, None, "open")]
    limited = FrameTemplate("limited", (Trigger("up", 5.0),), (), 25)
    assert got(R.frames(p, [limited])) == [("limited", 10, 35, "limit"), ("limited", 50, 75, "limit"), ("limited", 80, None, "open")]
    both = got(R.frames(p, [sharp, limited]))
    assert both == sorted(got(R.frames(p, [sharp])) + got(R.frames(p, [limited])))


def test_digital_and_expression_triggers(spark):
    p = points_of(spark, [0.0, 1.0, 1.0, None, 0.0, 2.0])
    on = FrameTemplate("on", (Trigger("on"),), (Trigger("off"),))
    assert got(R.frames(p, [on])) == [("on", 10, 40, "end"), ("on", 50, None, "open")]
    # an end and a start at one point: the frame ends and the next begins
    each = FrameTemplate("each", (Trigger("expression", signal="|value >= 1"),), (Trigger("expression", signal="|value >= 1"),))
    assert got(R.frames(p, [each])) == [("each", 10, 20, "end"), ("each", 20, 50, "end"), ("each", 50, None, "open")]
    assert R.frames(p.limit(0), [on]).count() == 0
    with pytest.raises(ValueError):
        Trigger("sometimes")


def test_column_and_number_agree(spark):
    rows = [(b, n) for b in (None, 0.0, 4.0, 5.0, 6.0) for n in (None, 0.0, 4.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "b double, n double")
    for t in (Trigger(k, 5.0, h) for k in ("up", "down", "on", "off", "expression") for h in (0.0, 1.0)):
        assert [r["x"] for r in df.select(t.column(F.col("b"), F.col("n")).alias("x")).collect()] == [t.fires(b, n) for b, n in rows]


def batches_of(spark, sf, path, late_share):
    """Events in eight files, a tenth of them (by number) a day late, one file with rows far too late, one that ends all."""
    e = spark.read.parquet(f"{sf}/events.parquet").cache()
    end = e.agg(F.max("ts")).first()[0]
    e = e.withColumn("_in", F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr("interval 20 hours")).otherwise(F.expr("interval 0 hours")))
    ranges = e.withColumn("_k", F.ntile(8).over(Window.orderBy("_in")))
    top = e.agg(F.max("event_id")).first()[0]
    kept = [ranges.where(F.col("_k") == k + 1).drop("_k", "_in") for k in range(8)]
    too_late = kept[0].limit(late_share).withColumn("event_id", F.col("event_id") + top + 1)
    last = kept[7].limit(1).withColumn("ts", F.lit(end + dt.timedelta(days=400)).cast(e.schema["ts"].dataType)).withColumn("event_id", F.lit(top + 100_000)).withColumn("user_id", F.lit(-1).cast(e.schema["user_id"].dataType))
    for k, part in enumerate([*kept, too_late, last, last]):
        part.coalesce(1).write.parquet(f"{path}/in/k={k}")
    return e.drop("_in").schema


def test_stream_equals_batch(spark, sf, tmp_path):
    """Eleven files, one a micro-batch; the query stops after five of them and goes on from its checkpoint."""
    schema = batches_of(spark, sf, str(tmp_path), 7)
    (tmp_path / "feed").mkdir()
    spark.conf.set(S.PROVIDER, S.ROCKS)
    late, n = 0, 0
    try:
        for files in (range(5), range(5, 11)):
            for k in files:
                for f in sorted((tmp_path / "in" / f"k={k}").glob("*.parquet")):
                    to = shutil.copy(f, tmp_path / "feed" / f"{k:02d}-{f.name}")
                    os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
            stream = S.frames(T.event_stream(spark, str(tmp_path / "feed"), schema), TEMPLATES, "1 day")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            late += S.late_rows(q)
            n += len([p for p in q.recentProgress if p.numInputRows])
    finally:
        spark.conf.unset(S.PROVIDER)
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*[c.split()[0] for c in R.FRAME.split(", ")]).collect()]
    assert n == 11 and late == 7
    closed = [tuple(r) for r in R.frames(from_events(spark, sf), TEMPLATES).where("reason <> 'open'").collect()]
    # the stream also ends frames at their limit that lie open at the end of the batch
    limits = {t.name: t.limit_us for t in TEMPLATES}
    still = [(r["tag_id"], r["template"], r["start_us"], r["start_seq"], r["start_us"] + limits[r["template"]], "limit") for r in R.frames(from_events(spark, sf), TEMPLATES).where("reason = 'open'").collect() if limits[r["template"]]]
    assert len(closed) > 50 and sorted(rows) == sorted(closed + still)


def test_stream_needs_its_state_store(spark, sf, tmp_path):
    with pytest.raises(ValueError):
        S.frames(T.event_stream(spark, str(tmp_path), spark.read.parquet(f"{sf}/events.parquet").schema), TEMPLATES, "1 day")
