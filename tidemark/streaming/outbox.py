"""Store and forward: an outbox of messages as tables, drained with back-off, each message sent once.

Three tables in one folder, each written a batch at a time into a folder of its own number, so
whatever is done again is written over and not added: `messages` (what came in), `plans`
(which messages a drain is about to send, and when) and `attempts` (how that went). A drain that
was broken off is done again from its plan, not planned anew, so it sends what it was about to
send under the same number, and a receiver that overwrites by number gets nothing twice.

A message that wasn't delivered waits base * factor^(attempts - 1) microseconds, `longest` at most, and is
given up after `most` attempts. A message_id that comes again counts once, as first seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MESSAGE = "message_id string, topic string, payload string, us long"
_PLAN = "message_id string, topic string, payload string, attempt int, now_us long"
_ATTEMPT = "message_id string, attempt int, us long, delivered boolean, next_us long"

#: Takes the messages of a drain and its number; gives message_id and delivered. Done again with the same number it must overwrite.
Send = Callable[[DataFrame, int], DataFrame]


def wait_us(attempt: Column, base_us: int, factor: float, longest_us: int) -> Column:
    """How long to wait after an attempt (from 1) that failed."""
    return F.least(F.lit(float(longest_us)), base_us * F.pow(F.lit(factor), (attempt - 1).cast("double"))).cast("long")


def schedule(messages: DataFrame, base_us: int, factor: float, longest_us: int, most: int) -> DataFrame:
    """message_id, attempt, at_us and delivered of all attempts of messages (message_id, us, good: the first that succeeds)."""
    waits = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: wait_us(i, base_us, factor, longest_us))
    a = messages.select("message_id", "us", "good", F.explode(F.sequence(F.lit(1), F.least(F.col("good"), F.lit(most)).cast("int"))).alias("attempt"), waits.alias("_w"))
    waited = F.aggregate(F.slice("_w", F.lit(1), F.col("attempt") - 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return a.select("message_id", "attempt", (F.col("us") + waited).alias("at_us"), (F.col("attempt") == F.col("good")).alias("delivered"))


@dataclass
class Outbox:
    spark: SparkSession
    folder: str
    base_us: int = 1_000_000
    factor: float = 2.0
    longest_us: int = 60_000_000
    most: int = 5

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, number: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{schema}, {number} long")
        return self.spark.read.schema(f"{schema}, {number} long").parquet(path)

    def enqueue(self, batch: DataFrame, number: int, now_us: int) -> None:
        """Takes in a batch (message_id, topic, payload) under its number."""
        rows = batch.select(F.col("message_id").cast("string"), "topic", "payload", F.lit(now_us).cast("long").alias("us"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/messages/batch={number}")

    def state(self) -> DataFrame:
        """message_id, topic, payload, us, attempts, next_us and status (waiting, sent, failed, purged) of each message."""
        first = Window.partitionBy("message_id").orderBy("batch", "us", "topic", "payload")
        m = self._table("messages", "batch", _MESSAGE).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("message_id", "topic", "payload", "us")
        a = self._table("attempts", "run", _ATTEMPT).groupBy("message_id").agg(F.max("attempt").alias("attempts"), F.max("delivered").alias("_sent"), F.max_by("next_us", "attempt").alias("next_us"), F.count_if(F.col("delivered").isNull()).alias("_purged"))
        j = m.join(a, "message_id", "left")
        status = F.when(F.col("_sent"), "sent").when(F.col("_purged") > 0, "purged").when(F.col("attempts") >= self.most, "failed").otherwise("waiting")
        return j.select("message_id", "topic", "payload", "us", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("next_us", "us").alias("next_us"), status.alias("status"))

    def drain(self, run: int, now_us: int, send: Send) -> int:
        """Sends what is due under a number, and writes down how it went; how many it delivered.

        A run whose attempts are written is over and isn't done again.
        """
        plan, done = f"{self.folder}/plans/run={run}", f"{self.folder}/attempts/run={run}"
        if not self._exists(f"{done}/_SUCCESS"):
            if not self._exists(f"{plan}/_SUCCESS"):
                due = self.state().where((F.col("status") == "waiting") & (F.col("next_us") <= now_us))
                due.select("message_id", "topic", "payload", (F.col("attempts") + 1).cast("int").alias("attempt"), F.lit(now_us).cast("long").alias("now_us")).write.mode("overwrite").parquet(plan)
            planned = self.spark.read.schema(_PLAN).parquet(plan)
            told = send(planned.select("message_id", "topic", "payload", "attempt"), run).groupBy("message_id").agg(F.max("delivered").alias("delivered"))
            rows = planned.join(told, "message_id", "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))
            again = F.when(~F.col("delivered"), F.col("now_us") + wait_us(F.col("attempt"), self.base_us, self.factor, self.longest_us))
            rows.select("message_id", "attempt", F.col("now_us").alias("us"), "delivered", again.alias("next_us")).write.mode("overwrite").parquet(done)
        return self.spark.read.schema(_ATTEMPT).parquet(done).where("delivered").count()

    def purge(self, run: int, now_us: int) -> None:
        """Gives up all that wait, under a number of the same row as drains."""
        waiting = self.state().where("status = 'waiting'")
        rows = waiting.select("message_id", F.col("attempts").cast("int").alias("attempt"), F.lit(now_us).cast("long").alias("us"), F.lit(None).cast("boolean").alias("delivered"), F.lit(None).cast("long").alias("next_us"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/attempts/run={run}")


def forward(stream: DataFrame, outbox: Outbox, send: Send, clock: Callable[[int], int], checkpoint: str):
    """Start a query that takes each micro-batch into the outbox and drains what is due, at the time that clock gives for the batch."""

    def step(batch: DataFrame, number: int) -> None:
        outbox.enqueue(batch, number, clock(number))
        outbox.drain(number, clock(number), send)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
