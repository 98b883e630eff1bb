"""Trees of elements: closure, paths, ancestors and roll-ups.

A tree is a table (id, parent) with a null parent at the roots. Closures grow by one
join per level, as many as the tree is deep; rows that a level adds are bounded by the
nodes that lie so deep. A cycle is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cut import cut

#: Levels whose rows are held apart before they are put together.
_LEVELS_APART = 64


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, id, distance) for every node and each of its ancestors, itself included."""
    up = tree.select(F.col("id").alias("_c"), F.col("parent").alias("_p")).where("_p is not null")
    out = level = tree.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("distance"))
    d = 0
    while True:
        d += 1
        level = cut(level.join(up, F.col("ancestor") == F.col("_c")).select(F.col("_p").alias("ancestor"), "id", F.lit(d).alias("distance")))
        if level.isEmpty():
            return out
        if not level.where("ancestor = id").isEmpty():
            raise ValueError("the tree has a cycle")
        out = out.unionByName(level)
        if d % _LEVELS_APART == 0:
            out = cut(out)


def depths(tree: DataFrame) -> DataFrame:
    return closure(tree).groupBy("id").agg(F.max("distance").alias("depth"))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent").alias("_p")).where("_p is not null").distinct(), F.col("id") == F.col("_p"), "left_anti").select("id")


def descendants(tree: DataFrame) -> DataFrame:
    """Number of nodes under each node."""
    return closure(tree).groupBy(F.col("ancestor").alias("id")).agg((F.count("*") - 1).alias("descendants"))


def paths(tree: DataFrame, name: str = "name", separator: str = "\\") -> DataFrame:
    """Names from the root to each node."""
    names = tree.select(F.col("id").alias("ancestor"), F.col(name).alias("_n"))
    parts = closure(tree).join(names, "ancestor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "_n")), asc=False).alias("s"))
    return parts.select("id", F.concat_ws(separator, F.transform("s", lambda x: x["_n"])).alias("path"))


def lowest_common_ancestors(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, lca) for pairs (x, y); pairs of different trees have none."""
    c = closure(tree)
    a = c.select(F.col("id").alias("x"), "ancestor", F.col("distance").alias("dx"))
    b = c.select(F.col("id").alias("y"), "ancestor", F.col("distance").alias("dy"))
    return pairs.join(a, "x").join(b, ["y", "ancestor"]).groupBy("x", "y").agg(F.min_by("ancestor", F.struct(F.col("dx") + F.col("dy"), "ancestor")).alias("lca"))


def rollup(tree: DataFrame, values: DataFrame, method: str = "sum", weight: str | None = None) -> DataFrame:
    """Aggregate of the values (id, value) of all nodes at or below each node."""
    v = F.col("value")
    agg = {
        "sum": F.sum(v), "average": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "stddev": F.stddev_pop(v),
        "worst": F.min(F.least(F.lit(100.0), v)), "weighted": F.try_divide(F.sum(v * F.col(weight)), F.sum(F.when(v.isNotNull(), F.col(weight)))) if weight else F.avg(v),
    }[method]
    return closure(tree).join(values, "id").groupBy(F.col("ancestor").alias("id")).agg(agg.alias("rolled"))


def rollup_children(tree: DataFrame, values: DataFrame, method: str = "average") -> DataFrame:
    """Aggregate of the values of each node's direct children."""
    v = F.col("value")
    agg = {"sum": F.sum(v), "average": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "stddev": F.stddev_pop(v)}[method]
    return tree.where("parent is not null").join(values, "id").groupBy(F.col("parent").alias("id")).agg(agg.alias("rolled"))
