"""Orders over small graphs and state machines: build order, causal chains, frame states, data references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cut import cut


#: Levels whose rows are held apart before they are put together.
_LEVELS_APART = 64


def build_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, level): every node after all that it needs (id, needed); an error for cycles.

    Each level is one join of the nodes that the level before reached with the counts of
    needs that others still wait for, so a node's level is its longest chain of needs.
    Nodes still waiting when a level reaches none are a cycle, or need what isn't there.
    """
    ids = nodes.select("id").union(needs.select("id")).distinct()
    needs = needs.select("id", "needed").distinct().join(ids.withColumnRenamed("id", "_known"), F.col("needed") == F.col("_known"), "left")
    waits = needs.groupBy("id").agg(F.greatest(F.count("_known"), F.lit(1)).alias("n"))
    needs = cut(needs.where("_known is not null").select("id", "needed"))
    state = cut(ids.join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    out, level = state.where("n = 0").select("id", F.lit(0).alias("level")), 0
    while not state.where("n = 0").isEmpty():
        level += 1
        done = needs.join(state.where("n = 0").select(F.col("id").alias("needed")), "needed").groupBy("id").agg(F.count("*").alias("_done"))
        state = cut(state.where("n > 0").join(done, "id", "left").select("id", (F.col("n") - F.coalesce("_done", F.lit(0))).alias("n")))
        out = out.unionByName(state.where("n = 0").select("id", F.lit(level).alias("level")))
        if level % _LEVELS_APART == 0:
            out = cut(out)
    if not state.isEmpty():
        raise ValueError("the needs have a cycle")
    return out


def strongest_successors(links: DataFrame) -> DataFrame:
    """The strongest causal link out of each event (a, b, strength), ties to the smaller event."""
    w = Window.partitionBy("a").orderBy(F.desc("strength"), "b")
    return links.where("causal").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("a", "b", "strength")


def causal_chains(links: DataFrame) -> DataFrame:
    """Chains along strongest links from events that no causal link enters; a chain ends before it meets itself."""
    step = cut(strongest_successors(links))
    entered = links.where("causal").select(F.col("b").alias("a")).distinct()
    chain = step.join(entered, "a", "left_anti").select(F.col("a").alias("source"), F.array("a", "b").alias("events"), F.col("b").alias("_end"))
    out, n = None, 0
    while True:
        nxt = cut(chain.join(step.select(F.col("a").alias("_end"), F.col("b").alias("_b")), "_end", "left"))
        grows = F.col("_b").isNotNull() & ~F.array_contains("events", F.col("_b"))
        done = nxt.where(~grows).select("source", "events")
        out, n = done if out is None else out.unionByName(done), n + 1
        if n % _LEVELS_APART == 0:
            out = cut(out)
        chain = nxt.where(grows).select("source", F.array_append("events", F.col("_b")).alias("events"), F.col("_b").alias("_end"))
        if chain.isEmpty():
            return out.select("source", "events", F.size("events").alias("length"))


def frame_states(actions: DataFrame) -> DataFrame:
    """The state of each frame after its actions (frame_id, us, action), those out of turn ignored.

    INACTIVE is started to ACTIVE, ACTIVE closed to CLOSED or cancelled to CANCELLED;
    ACTIVE and CLOSED can be acknowledged. A fold over a frame's few sorted actions.
    """
    s = F.array_sort(F.collect_list(F.struct("us", "action")))

    def step(acc: Column, x: Column) -> Column:
        a = x["action"]
        return (
            F.when((acc == "INACTIVE") & (a == "start"), "ACTIVE").when((acc == "ACTIVE") & (a == "close"), "CLOSED").when((acc == "ACTIVE") & (a == "cancel"), "CANCELLED")
            .when(acc.isin("ACTIVE", "CLOSED") & (a == "acknowledge"), "ACKNOWLEDGED").otherwise(acc))

    return actions.groupBy("frame_id").agg(s.alias("s")).select("frame_id", F.aggregate("s", F.lit("INACTIVE"), step).alias("state"))


def frame_lifecycle(actions: DataFrame) -> DataFrame:
    """frame_id, state, started, ended, acknowledged, by_whom and refused after a frame's actions (frame_id, us, action, actor).

    Only an inactive frame starts, only an active one is closed or cancelled, and an active or closed one
    acknowledged; other actions change nothing and count as refused. An end before the start is the start.
    Equal times go by action and actor. A fold over a frame's few sorted actions.
    """
    s = F.array_sort(F.collect_list(F.struct("us", "action", "actor")))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit("INACTIVE").alias("state"), none.alias("started"), none.alias("ended"), none.alias("acknowledged"), F.lit(None).cast("string").alias("by_whom"), F.lit(0).alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        a, state, us = x["action"], acc["state"], x["us"]
        start, end, ack = (a == "start") & (state == "INACTIVE"), a.isin("close", "cancel") & (state == "ACTIVE"), (a == "acknowledge") & state.isin("ACTIVE", "CLOSED")
        return F.struct(
            F.when(start, "ACTIVE").when(end & (a == "close"), "CLOSED").when(end, "CANCELLED").when(ack, "ACKNOWLEDGED").otherwise(state).alias("state"), F.when(start, us).otherwise(acc["started"]).alias("started"),
            F.when(end, F.greatest(us, acc["started"])).otherwise(acc["ended"]).alias("ended"), F.when(ack, us).otherwise(acc["acknowledged"]).alias("acknowledged"), F.when(ack, x["actor"]).otherwise(acc["by_whom"]).alias("by_whom"),
            (acc["refused"] + F.coalesce(~(start | end | ack), F.lit(True)).cast("int")).alias("refused"))

    return actions.groupBy("frame_id").agg(s.alias("s")).select("frame_id", F.aggregate("s", start, step).alias("f")).select("frame_id", "f.*")


def table_lookup(values: DataFrame, table: DataFrame, key: str, linear: bool = True) -> DataFrame:
    """Value of a small lookup table (x, y) at each key, held at its ends.

    The table is one row with a sorted array, so the join carries one row; it is meant
    for tables of some hundred entries.
    """
    one = table.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_t"))
    k = F.col(key)
    j = values.join(one)
    below = F.filter("_t", lambda p: p["x"] <= k)
    above = F.filter("_t", lambda p: p["x"] > k)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    y = a["y"] if not linear else a["y"] + (b["y"] - a["y"]) * (k - a["x"]) / (b["x"] - a["x"])
    return j.withColumn("looked_up", F.coalesce(y, a["y"], b["y"])).drop("_t")


def resolve_references(attributes: DataFrame, latest: DataFrame) -> DataFrame:
    """Values of attributes (element, name, kind, config, default): constants, points, other attributes, defaults.

    config is JSON: {"value": ..} of a constant, {"tag": ..} of a point, {"element": ..,
    "attribute": ..} of a reference to a constant or point attribute.
    """
    get = lambda k: F.get_json_object("config", f"$.{k}")
    a = attributes.withColumn("_tag", get("tag").cast("long")).join(latest.select(F.col("tag_id").alias("_tag"), F.col("value").alias("_latest")), "_tag", "left")
    own = F.when(F.col("kind") == "CONSTANT", get("value").cast("double")).when(F.col("kind") == "PI_POINT", F.coalesce("_latest", "default")).when(F.col("kind") == "NONE", F.col("default"))
    a = a.withColumn("_own", own)
    targets = a.select(F.col("element").alias("_e"), F.col("name").alias("_a"), F.col("_own").alias("_ref"))
    a = a.withColumn("_e", get("element")).withColumn("_a", get("attribute")).join(targets, ["_e", "_a"], "left")
    return a.select("element", "name", "kind", F.when(F.col("kind") == "ATTR_REF", F.coalesce("_ref", "default")).otherwise(F.col("_own")).alias("value"))
