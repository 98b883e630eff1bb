"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to its least neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u and m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every larger end occurs once, and never as a smaller end."""
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("low")).union(edges.select("b", F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("low").alias("lows"), F.min("low").alias("least"))
    return seen.where((F.col("lows") > 1) | ((F.col("lows") > 0) & (F.col("least") == 0))).isEmpty()


def connected(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of edges (a, b); the component is its least node.

    Every step is a grouped minimum (partial sums first) and a join on the node,
    whose skew Spark splits; no neighbourhood is ever gathered in one task. A
    step's table is written to the shared folder, so lost executors cost one step.
    """
    now = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        then, now = now, scratch.save(_small_star(_large_star(now)), "edges")
        scratch.drop(then)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
