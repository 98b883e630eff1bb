"""Trees as intervals: a node's number in depth-first order, and the last number below it.

Whatever lies below a node has its number in that node's interval, so a subtree is a range, and its
sums are the difference of two running sums; no table has a row for each pair of a node and an
ancestor. Subtree sizes, depths, numbers and paths come from pointers that double their reach
each round: as many rounds as the depth has binary digits, and one row per node in each.

A node whose parent isn't in the tree is a root. A cycle is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cut import cut


def _rooted(tree: DataFrame, *more: str) -> DataFrame:
    """id, up (null at the roots), and further columns."""
    ids = tree.select(F.col("id").alias("_p"))
    return tree.join(ids, F.col("parent") == F.col("_p"), "left").select("id", F.col("_p").alias("up"), *more)


def _rounds(nodes: DataFrame) -> int:
    """Rounds after which every pointer of a tree has left it."""
    return max(1, nodes.count()).bit_length() + 1


def climb(nodes: DataFrame, columns: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Each column of (id, up, columns) combined along the way to the root: f(of the node, of what lies above)."""
    state, left = cut(nodes), _rounds(nodes)
    while not state.where("up is not null").isEmpty():
        if not left:
            raise ValueError("the tree has a cycle")
        left -= 1
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in columns])
        joined = state.join(above, "up", "left")
        state = cut(joined.select("id", F.col("_up").alias("up"), *[F.when(F.col("up").isNotNull(), f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in columns.items()]))
    return state.drop("up")


def sizes(tree: DataFrame) -> DataFrame:
    """(id, up, size): nodes at or below each node.

    What lies within reach of a node doubles: to its own reach come the reaches of the nodes that point at it.
    """
    rooted = cut(_rooted(tree))
    state, left = rooted.select("id", "up", F.lit(1).cast("long").alias("size")), _rounds(rooted)
    while not state.where("up is not null").isEmpty():
        if not left:
            raise ValueError("the tree has a cycle")
        left -= 1
        more = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        state = cut(state.join(more, "id", "left").join(above, "up", "left").select("id", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
    return rooted.join(state.select("id", "size"), "id")


def running_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows before in the order.

    Ranges of the order go to partitions; a window runs within each, and the sums of the
    ranges before, one row per partition, are added.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(totals.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def labels(tree: DataFrame, order: str = "id") -> DataFrame:
    """(id, pre, last, depth, size): the number in depth-first order from 1, siblings by `order` and id, and the last number below.

    Sorted by pre, nodes stand as sorted by path if siblings are sorted by name.
    """
    s = sizes(tree)
    s = s if order == "id" else s.join(tree.select("id", F.col(order).alias("_order")), "id")
    keys = ["up", "id"] if order == "id" else ["up", "_order", "id"]
    run = cut(running_sums(s, keys, "size", "_run"))
    first = run.groupBy("up").agg(F.min("_run").alias("_first"))
    steps = run.alias("r").join(first.alias("f"), F.col("r.up").eqNullSafe(F.col("f.up"))).select("r.id", "r.up", "r.size", (F.col("_run") - F.col("_first") + 1).alias("pre"), F.when(F.col("r.up").isNotNull(), 1).otherwise(0).alias("depth"))
    add = lambda own, above: own + above
    done = climb(steps.select("id", "up", "pre", "depth"), {"pre": add, "depth": add})
    return done.join(s.select("id", "size"), "id").select("id", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "depth", "size")


def below(labelled: DataFrame, top: int | str) -> DataFrame:
    """The nodes at or below one node, by its interval."""
    node = labelled.where(F.col("id") == top).select("pre", "last").first()
    return labelled.where(F.col("pre").between(*node)) if node else labelled.limit(0)


def subtree_sums(labelled: DataFrame, values: DataFrame) -> DataFrame:
    """(id, n, total, average) of the values (id, value) at or below each node.

    Sums are decimals of nine places, so a difference of two running sums is exact.
    """
    each = values.groupBy("id").agg(F.sum(F.col("value").cast("decimal(28,9)")).alias("_v"), F.count("value").alias("_n"))
    zero = F.lit(0).cast("decimal(38,9)")
    rows = labelled.join(each, "id", "left").select("id", "pre", "last", F.coalesce(F.col("_v").cast("decimal(38,9)"), zero).alias("_v"), F.coalesce("_n", F.lit(0)).alias("_n"))
    run = running_sums(running_sums(rows, ["pre"], "_v", "_run_v"), ["pre"], "_n", "_run_n")
    run = cut(run.select("id", "pre", "last", F.col("_run_v").cast("decimal(38,9)").alias("_run_v"), "_run_n", "_v", "_n"))
    ends = run.select(F.col("pre").alias("last"), (F.col("_run_v") + F.col("_v")).alias("_end_v"), (F.col("_run_n") + F.col("_n")).alias("_end_n"))
    n, total = F.col("_end_n") - F.col("_run_n"), (F.col("_end_v") - F.col("_run_v")).cast("double")
    return run.join(ends, "last").select("id", n.alias("n"), F.when(n > 0, total).alias("total"), F.try_divide(total, n).alias("average"))


def paths(tree: DataFrame, name: str = "name", separator: str = "\\") -> DataFrame:
    """(id, path): names from the root to each node, joined by doubling."""
    return climb(_rooted(tree, F.col(name).alias("path")), {"path": lambda own, above: F.concat_ws(separator, above, own)})


def nearest_above(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, mark): the nearest marked node (a table of ids) at or above each node, null where there is none."""
    marked = _rooted(tree).join(marks.select(F.col("id").alias("mark")).distinct(), F.col("id") == F.col("mark"), "left").select("id", "up", "mark")
    return climb(marked, {"mark": lambda own, above: F.coalesce(own, above)})


def relative_paths(tree: DataFrame, pairs: DataFrame, name: str = "name", separator: str = "\\") -> DataFrame:
    """(base, id, path): for pairs (base, id) the names from below base down to id, led by a dot; none where id isn't below."""
    lab, path = labels(tree), cut(paths(tree, name, separator))
    both = lab.join(path, "id")
    low = both.select("id", F.col("pre").alias("_at"), F.col("path").alias("_path"))
    high = both.select(F.col("id").alias("base"), "pre", "last", F.col("path").alias("_base"))
    j = pairs.join(low, "id").join(high, "base").where(F.col("_at").between(F.col("pre"), F.col("last")))
    return j.select("base", "id", F.concat(F.lit(f".{separator}"), F.expr(f"substring(_path, length(_base) + {1 + len(separator)})")).alias("path"))


def find_paths(tree: DataFrame, wanted: DataFrame, name: str = "name", separator: str = "\\") -> DataFrame:
    """(path, id): the nodes that a table of paths from a root names; leading separators don't count.

    One join on (parent, name) for each part of the longest path.
    """
    at = _rooted(tree, F.col(name).alias("_name"))
    parts = F.filter(F.split("path", f"[{separator * 2 if separator == chr(92) else separator}]"), lambda x: x != "")
    left = wanted.select("path").distinct().withColumn("_parts", parts).where(F.size("_parts") > 0)
    here = left.join(at.where("up is null").select("id", "_name"), F.col("_parts")[0] == F.col("_name")).select("path", "_parts", "id")
    out, depth = None, 1
    while True:
        here = cut(here)
        done = here.where(F.size("_parts") == depth).select("path", "id")
        out = done if out is None else out.unionByName(done)
        here = here.where(F.size("_parts") > depth)
        if here.isEmpty():
            return out
        child = at.select(F.col("id").alias("_child"), F.col("up").alias("_up"), "_name")
        here = here.join(child, (F.col("id") == F.col("_up")) & (F.col("_parts")[depth] == F.col("_name"))).select("path", "_parts", F.col("_child").alias("id"))
        depth += 1
