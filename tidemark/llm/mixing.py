"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in code point order with null last, get weights 5, 2, 1, repeating, and
share 100% of all words. A target stops at three times its source's size; the
excess is shared again by weight among the others until none is above. A source
then repeats all its documents floor(target / size) times, and for the rest of
its target takes a subset of them: documents are counted by exact length, every
length gives the same share of its count, and a bounded-knapsack dynamic program
over the documents left by length fills what remains of the budget as exactly
as they allow. Which documents of a length are taken follows a seeded order.

Null and empty texts have size 0 and take 0 words. A source without words has
target 0. Rows that repeat are documents of their own. Extra columns are
ignored; all results are the same on every run and partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: The dynamic program covers budgets of so many words; what is above is filled by lengths.
DP_BUDGET = 1 << 14
#: Documents of one source and length in one bucket of the seeded order.
BUCKET = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column, seed: int = 19) -> Column:
    """The seeded order of documents."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, full sources cut off.

    A source is full once the level (budget per weight) reaches 3 * size / weight.
    With sources ordered by that ratio the level is one running sum away, so no
    loop over sources runs anywhere; one row per source is sorted.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), pick.cast("int") + 1))
    w = w.withColumn("ratio", MAX_REPEATS * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = F.coalesce(F.sum(F.col("source_size") * MAX_REPEATS).over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", (F.sum("source_size").over(every) - full) / open_weight)
    # the level of the first source that isn't full holds for all that aren't
    w = w.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    return w.select("source", "source_size", F.least(F.col("final") * F.col("weight"), (MAX_REPEATS * F.col("source_size")).cast("double")).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as found.

    Every length gives its even share, and the program fits what is left of the budget over
    the documents left. Where that misses a budget within DP_BUDGET, the program chooses
    among all documents, and so as well as any choice can.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return take
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int(lengths @ take)
    for i in np.argsort(-lengths, kind="stable"):  # long ones first, down to what the program covers
        if rest <= DP_BUDGET:
            break
        more = min(int(counts[i] - take[i]), (rest - DP_BUDGET) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    for i in np.argsort(lengths, kind="stable")[::-1]:  # lengths too long for the step above
        if rest <= DP_BUDGET:
            break
        more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    take = take + _knapsack(lengths, counts - take, rest)
    if budget <= DP_BUDGET and int(lengths @ take) != budget:
        every = _knapsack(lengths, counts, budget)
        take = min(take, every, key=lambda x: abs(int(lengths @ x) - budget))
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over one bit for each sum up to twice the budget; lengths split into powers of two.

    The sum nearest the budget wins, the smaller one of two as near.
    """
    take = np.zeros(len(lengths), np.int64)
    reach, mask, steps = 1, (1 << (2 * budget + 1)) - 1, []
    for i in np.argsort(lengths, kind="stable"):
        left = min(int(counts[i]), 2 * budget // int(lengths[i]))
        part = 1
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            new = (reach | reach << part * int(lengths[i])) & mask
            if new != reach:
                steps.append((i, part, reach))
                reach = new
            left -= part
            part *= 2
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reach >> budget
    above = budget + (over & -over).bit_length() - 1 if over else None
    at = above if above is not None and above - budget < budget - below else below
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _plan(source: pd.DataFrame) -> pd.DataFrame:
    """For each length of one source, how many documents get one repeat more than the others."""
    source = source.sort_values("size")
    size, target = int(source["source_size"].iloc[0]), float(source["target"].iloc[0])
    goal = int(np.floor(target + 0.5))
    base = min(MAX_REPEATS, goal // size) if size else 0
    lengths, counts = source["size"].to_numpy(np.int64), source["n"].to_numpy(np.int64)
    extra = np.zeros(len(lengths), np.int64)
    if base < MAX_REPEATS and size:
        some = lengths > 0
        extra[some] = fill(lengths[some], counts[some], goal - base * size)
    return source.assign(base=base, extra=extra)[["source", "size", "n", "base", "extra", "source_size", "target"]]


_PLAN = "source string, size long, n long, base int, extra long, source_size long, target double"


def mix_sources(docs: DataFrame, seed: int = 19) -> DataFrame:
    """doc_id, h (the seeded order), source, size, source_size, target, repeats and taken for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    base = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text"), seed).alias("h")), "sizes")
    counts = scratch.save(base.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    plan = scratch.save(
        counts.alias("c").join(goal.alias("g"), same).select("c.source", "c.size", "c.n", "g.source_size", "g.target")
        .groupBy("source").applyInPandas(_plan, _PLAN), "plan")

    # A length's first documents in seeded order get the extra repeat. A hot length
    # is cut into buckets by the high bits of the order: only counts of buckets are
    # summed, and just the bucket at the boundary is ranked row by row.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    p = plan.withColumn("buckets", buckets).withColumnRenamed("source", "p_source").withColumnRenamed("size", "p_size")
    dealt = base.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    dealt = dealt.withColumn("k", F.floor((F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53)) * F.col("buckets")))
    settled = F.col("extra").isin(0) | (F.col("extra") >= F.col("n")) | (F.col("size") == 0)
    partly = dealt.where(~settled)
    by_bucket = partly.groupBy("source", "size", "k").agg(F.count("*").alias("m"), F.first("extra").alias("x"))
    up = Window.partitionBy("source", "size").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    border = by_bucket.withColumn("above", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("left", F.greatest(F.lit(0), F.least(F.col("m"), F.col("x") - F.col("above"))))
    edge = border.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("k").alias("e_k"), "left", "m")
    ranked = partly.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")) & (F.col("k") == F.col("e_k")))
    w = Window.partitionBy("source", "size", "k").orderBy("h", "doc_id")
    one = F.row_number().over(w) <= F.col("left")
    chosen = ranked.withColumn("more", one.cast("int"))
    cols = ["doc_id", "h", "source", "size", "source_size", "target", "base"]
    sure = dealt.where(settled).withColumn("more", ((F.col("extra") >= F.col("n")) & (F.col("extra") > 0)).cast("int"))
    out = sure.select(*cols, "more").unionByName(chosen.select(*cols, "more"))
    repeats = F.when(F.col("size") > 0, F.least(F.lit(MAX_REPEATS), F.col("base") + F.col("more"))).otherwise(0)
    return out.select("doc_id", "h", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
