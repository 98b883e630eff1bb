"""Trigger rules over several tags, evaluated whenever one of their tags changes.

A rule names its tags by role, tag('inlet') > tag('outlet') + 5, and a table of bindings says
which tag plays a role at which element, so one rule serves any number of elements. All tags
of a rule at an element are aligned as of each other: at each time at which one of them has a new
value, the others have their last one. All rules are evaluated in one plan.

Alignment is a running last value within chunks of time. What the chunks before left over is
carried in by a window over one row per chunk, so an element with very many points is
spread over its chunks, and no series is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.expression import compile_formula, references
from tidemark.points import DAY

_KEYS = ("rule", "element")


def evaluate(points: DataFrame, rules: dict[str, str], bindings: DataFrame, chunk_us: int = DAY) -> DataFrame:
    """rule, element, us, result, fired (result above a half), rises (fired, and not at the time before).

    bindings: rule, element, name, tag_id. Nothing is given before all tags of a rule have a value. Of
    points with equal time the last counts. A tag can be bound at many elements and under several names.
    """
    names = {rule: references(text) for rule, text in rules.items()}
    if not all(names.values()):
        raise ValueError("a rule without a tag never changes")
    width = max(map(len, names.values()))
    slots = bindings.sparkSession.createDataFrame([(r, n, i) for r, ns in names.items() for i, n in enumerate(ns)], "rule string, name string, slot int")
    bound = bindings.join(slots, ["rule", "name"]).select(*_KEYS, "slot", "tag_id").distinct()
    p = points.where(F.col("value").isNotNull()).select("tag_id", "us", "seq", "value").join(bound, "tag_id").withColumn("chunk", F.floor(F.col("us") / chunk_us))

    at = F.struct("us", "seq")
    of_slot = lambda i: F.when(F.col("slot") == i, F.col("value"))
    ends = p.groupBy(*_KEYS, "chunk").agg(*[F.max_by("value", F.when(F.col("slot") == i, at)).alias(f"_e{i}") for i in range(width)])
    earlier = Window.partitionBy(*_KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*_KEYS, "chunk", *[F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_c{i}") for i in range(width)])

    in_chunk = Window.partitionBy(*_KEYS, "chunk").orderBy("us", "seq", "slot")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    j = p.join(carried, [*_KEYS, "chunk"])
    j = j.select(*_KEYS, "chunk", "us", "seq", "slot", *[f"_c{i}" for i in range(width)], *[F.coalesce(F.last(of_slot(i), ignorenulls=True).over(so_far), F.col(f"_c{i}")).alias(f"_v{i}") for i in range(width)], F.lead("us").over(in_chunk).alias("_next"))
    j = j.where(F.col("_next").isNull() | (F.col("_next") != F.col("us")))

    def result(prefix: str) -> Column:
        out = F.lit(None).cast("double")
        for rule, text in rules.items():
            slot = {n: f"{prefix}{i}" for i, n in enumerate(names[rule])}
            ready = F.lit(True)
            for c in slot.values():
                ready = ready & F.col(c).isNotNull()
            out = F.when(F.col("rule") == rule, F.when(ready, compile_formula(text, lambda n, s=slot: F.col(s[n]), rule=True))).otherwise(out)
        return out

    j = j.select(*_KEYS, "chunk", "us", result("_v").alias("result"), result("_c").alias("_before"))
    before = F.coalesce(F.lag("result").over(Window.partitionBy(*_KEYS, "chunk").orderBy("us")), "_before")
    fired = F.col("result") > 0.5
    return j.withColumn("_was", before).where("result is not null").select(*_KEYS, "us", "result", fired.alias("fired"), (fired & ~F.coalesce(F.col("_was") > 0.5, F.lit(False))).alias("rises"))
