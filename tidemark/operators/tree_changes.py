"""Closures kept up to date: rows changed by a table of added, moved and removed nodes alone.

Only nodes below a changed one have other ancestors than before. Their rows are taken out and made
anew from the closure among themselves and the old closure of the nodes that they hang under;
all other rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cut import cut
from tidemark.operators.hierarchy import closure


def net_changes(changes: DataFrame) -> DataFrame:
    """The last change of each node (seq, id, action, parent): add and move set the parent, remove takes the node out."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", F.when(F.col("action") != "remove", F.col("parent")).alias("parent"), (F.col("action") == "remove").alias("removed"))


def changed_tree(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree (id, parent) after the changes; what lies below a removed node goes too, unless it was moved elsewhere."""
    net = cut(net_changes(changes))
    t = tree.select("id", "parent").join(net.select("id"), "id", "left_anti").unionByName(net.where("not removed").select("id", "parent"))
    gone = cut(net.where("removed").select("id"))
    while not gone.isEmpty():
        t = cut(t.join(gone, "id", "left_anti"))
        gone = cut(t.join(gone.select(F.col("id").alias("parent")), "parent", "left_semi").select("id"))
    return t


def changed_closure(tree: DataFrame, closed: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changed tree and its closure (ancestor, id, distance), from those before the changes."""
    after = cut(changed_tree(tree, changes))
    touched = cut(net_changes(changes).select("id"))
    # everything that lay below a changed node; what lies below one now but did not before was moved there, so it is changed itself
    moved = cut(closed.join(touched.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").union(touched.select("id")).distinct())
    stay = closed.join(moved, "id", "left_anti")
    part = after.join(moved, "id", "left_semi")
    inside = moved.select(F.col("id").alias("_p"))
    part = cut(part.join(inside, F.col("parent") == F.col("_p"), "left").select("id", "parent", F.col("_p").alias("within")))
    inner = closure(part.select("id", F.col("within").alias("parent")))
    tops = part.where("within is null and parent is not null").select(F.col("id").alias("ancestor"), F.col("parent").alias("_under"))
    above = stay.select(F.col("ancestor").alias("_far"), F.col("id").alias("_under"), F.col("distance").alias("_up"))
    bridge = inner.join(tops, "ancestor").join(above, "_under").select(F.col("_far").alias("ancestor"), "id", (F.col("distance") + F.col("_up") + 1).cast("int").alias("distance"))
    return after, stay.unionByName(inner).unionByName(bridge)
