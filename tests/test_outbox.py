"""Store and forward: back-off, giving up, and nothing sent twice when a batch is done again."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.outbox import Outbox, forward


class Receiver:
    """Keeps what it gets in a folder, overwriting by run; refuses an id as often as it was told to; can break off after the write."""

    def __init__(self, spark, folder, refusals=None, broken=()):
        self.spark, self.folder, self.refusals, self.broken = spark, folder, refusals or {}, set(broken)

    def __call__(self, messages, run):
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in self.refusals.items() for x in kv]), F.col("message_id")), F.lit(0)) if self.refusals else F.lit(0)
        told = messages.withColumn("delivered", F.col("attempt") > least)
        told.write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        if run in self.broken:
            self.broken.discard(run)
            raise ConnectionError("the line broke")
        return self.spark.read.parquet(f"{self.folder}/run={run}").select("message_id", "delivered")

    def got(self):
        return sorted(r["message_id"] for r in self.spark.read.parquet(self.folder).where("delivered").collect())


def batch_of(spark, *ids):
    return spark.createDataFrame([(i, "t", f"payload {i}") for i in ids], "message_id string, topic string, payload string")


def status(box):
    return {r["message_id"]: (r["status"], r["attempts"]) for r in box.state().collect()}


def test_back_off_and_giving_up(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), base_us=100, factor=2.0, longest_us=250, most=4)
    to = Receiver(spark, str(tmp_path / "to"), {"b": 2, "c": 99})
    assert status(box) == {} and box.drain(0, 0, to) == 0
    box.enqueue(batch_of(spark, "a", "b", "c"), 1, 10)
    assert box.drain(1, 10, to) == 1 and status(box) == {"a": ("sent", 1), "b": ("waiting", 1), "c": ("waiting", 1)}
    assert box.drain(2, 109, to) == 0 and status(box)["b"] == ("waiting", 1)  # not due before 110
    box.drain(3, 110, to)
    assert {r["next_us"] for r in box.state().where("status = 'waiting'").collect()} == {310}
    assert box.drain(4, 310, to) == 1
    assert {r["next_us"] for r in box.state().where("status = 'waiting'").collect()} == {560}  # 250 at most
    box.drain(5, 560, to)
    assert status(box) == {"a": ("sent", 1), "b": ("sent", 3), "c": ("failed", 4)} and box.drain(6, 10**9, to) == 0
    assert to.got() == ["a", "b"]


def test_a_broken_drain_goes_on_from_its_plan(spark, tmp_path):
    box, to = Outbox(spark, str(tmp_path / "box")), Receiver(spark, str(tmp_path / "to"), broken=[1])
    box.enqueue(batch_of(spark, "a", "b"), 1, 10)
    with pytest.raises(ConnectionError):
        box.drain(1, 10, to)
    box.enqueue(batch_of(spark, "c"), 2, 20)  # what came since isn't part of the run
    assert box.drain(1, 999, to) == 2 and box.drain(1, 999, to) == 2
    assert box.drain(2, 20, to) == 1 and to.got() == ["a", "b", "c"]


def test_the_same_message_again_and_purging(spark, tmp_path):
    box, to = Outbox(spark, str(tmp_path / "box")), Receiver(spark, str(tmp_path / "to"), {"b": 1})
    box.enqueue(batch_of(spark, "a", "b"), 1, 10)
    box.enqueue(batch_of(spark, "a", "b"), 1, 10)
    box.enqueue(batch_of(spark, "a"), 2, 20)
    box.drain(1, 20, to)
    assert status(box) == {"a": ("sent", 1), "b": ("waiting", 1)}
    box.purge(2, 30)
    assert status(box)["b"] == ("purged", 1) and box.drain(3, 10**12, to) == 0 and to.got() == ["a"]


def test_a_stream_that_breaks_and_starts_again(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("topic"), "props")
    for k in range(4):
        e.where(F.col("message_id").cast("long") % 4 == k).withColumnRenamed("props", "payload").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("message_id string, topic string, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    box, to = Outbox(spark, str(tmp_path / "box"), most=3), Receiver(spark, str(tmp_path / "to"), {"5": 1, "6": 9}, broken=[1, 3])
    clock = lambda number: number * 60_000_000
    for _ in range(3):  # two runs break off, the third ends
        q = forward(stream, box, to, clock, str(tmp_path / "c"))
        try:
            q.awaitTermination()
        except Exception as broke:
            assert "the line broke" in str(broke)
    box.drain(4, clock(9), to)
    want = sorted(r["message_id"] for r in e.where("message_id <> '6'").collect())
    assert to.got() == want and status(box)["6"][0] in ("waiting", "failed")
