"""Dimension tables: points, digital states, enumerations, templates, access, audit, alarms, members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import closure


def insert_points(db: DataFrame, new: DataFrame) -> DataFrame:
    """db with the new points whose tag it lacks, numbered on from its largest id.

    New rows are numbered inside hash partitions and offset by the counts of the
    partitions before, so no task sees all of them.
    """
    top = db.agg(F.coalesce(F.max("point_id"), F.lit(0)).alias("top"))
    fresh = new.join(db.select("tag"), "tag", "left_anti").dropDuplicates(["tag"]).withColumn("_b", F.pmod(F.xxhash64("tag"), F.lit(256)))
    counts = fresh.groupBy("_b").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_s", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_s", F.lit(0)).alias("_s"))
    numbered = fresh.join(F.broadcast(start), "_b").withColumn("point_id", F.row_number().over(Window.partitionBy("_b").orderBy("tag")) + F.col("_s"))
    numbered = numbered.join(F.broadcast(top)).withColumn("point_id", (F.col("point_id") + F.col("top")).cast(db.schema["point_id"].dataType))
    return db.unionByName(numbered.select(*db.columns))


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those of equal key."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def validate_tag(tag: Column) -> Column:
    return tag.rlike(r"^[A-Za-z][A-Za-z0-9_.]*$") & (F.length(tag) < 64)


def validate_point(span: Column, exc_dev: Column, comp_dev: Column, comp_min: Column, comp_max: Column) -> Column:
    """0, or the number of the first rule that a point breaks."""
    return F.when(span <= 0, 1).when(exc_dev < 0, 2).when(comp_dev < 0, 3).when(comp_min > comp_max, 4).otherwise(0)


def enum_names(values: DataFrame, enum: DataFrame) -> DataFrame:
    """values with the name of each code: the active one, else a retired one, else UNKNOWN."""
    n = enum.groupBy("code").agg(F.min(F.when(~F.col("retired"), F.col("name"))).alias("_a"), F.min("name").alias("_r"))
    return values.join(n, "code", "left").withColumn("name", F.coalesce("_a", "_r", F.lit("UNKNOWN"))).drop("_a", "_r")


def effective_attributes(templates: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes of each template with those of its bases; the nearest definition wins."""
    up = closure(templates).select(F.col("id").alias("template"), "ancestor", "distance")
    j = up.join(attributes.withColumnRenamed("template", "ancestor"), "ancestor")
    w = Window.partitionBy("template", "name").orderBy("distance")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "ancestor", "distance")


def missing_attributes(elements: DataFrame, own: DataFrame, effective: DataFrame) -> DataFrame:
    """Attributes that an element's template has and the element lacks."""
    return elements.join(effective, "template").join(own.select("element", "name"), ["element", "name"], "left_anti")


def granted_access(mappings: DataFrame, identities: DataFrame) -> DataFrame:
    """The highest level of each enabled identity for each point."""
    return mappings.join(identities.where("enabled").select("identity"), "identity").groupBy("identity", "point_id").agg(F.max("level").alias("level"))


def audit_recent(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.desc("us"), F.desc("entry_id")).limit(n)


def elect_primary(members: DataFrame) -> DataFrame:
    """The eligible member of highest priority of each collective, ties to the smaller id, and whether there is a quorum."""
    ok = F.col("state") != "OFFLINE"
    eligible = F.col("state").isin("PRIMARY", "SECONDARY")
    best = F.max_by(F.when(eligible, F.col("member")), F.when(eligible, F.struct("priority", (-F.col("member")).alias("m"))))
    return members.groupBy("collective").agg(best.alias("primary"), F.count_if(ok).alias("healthy"), (F.count_if(ok) > F.floor(F.count("*") / 2)).alias("quorum"))


def system_health(running: Column, total: Column, cpu: Column, memory_mb: Column) -> Column:
    """Percent of running services, less 20 for a busy processor and 10 for much memory, 0 at least."""
    base = F.coalesce(F.try_divide(100 * running, total), F.lit(0.0))
    return F.greatest(F.lit(0.0), base - F.when(cpu > 90, 20).otherwise(0) - F.when(memory_mb > 16000, 10).otherwise(0))


def format_message(template: Column, fields: dict[str, Column]) -> Column:
    """A text with {name} replaced by its value; unknown names stay."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def kpi_rollup(kpis: DataFrame, method: str = "average") -> DataFrame:
    """Value and worst status of each parent's children (status by rank, higher is worse)."""
    value = {"average": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "critical": F.count_if(F.col("status") == 2).cast("double"), "weighted": F.try_divide(F.sum(F.col("value") * F.col("score")), F.sum("score"))}[method]
    return kpis.where("parent is not null").groupBy("parent").agg(value.alias("value"), F.max("status").alias("status"))


def trend(slopes: DataFrame, sensitivity: float, higher_is_better: bool = True) -> DataFrame:
    """STABLE, IMPROVING or DETERIORATING by slope; UNDEFINED under three points."""
    good = F.col("slope") > 0 if higher_is_better else F.col("slope") < 0
    kind = F.when((F.col("n") < 3) | F.col("slope").isNull(), "UNDEFINED").when(F.abs("slope") <= sensitivity, "STABLE").when(good, "IMPROVING").otherwise("DETERIORATING")
    return slopes.withColumn("trend", kind)


def enum_sets(enum: DataFrame) -> DataFrame:
    """For each set of an enumeration (set, code, name, retired) its active and retired codes."""
    return enum.groupBy("set").agg(F.count_if(~F.col("retired")).alias("active"), F.count_if("retired").alias("retired"))


def enum_codes(names: DataFrame, enum: DataFrame) -> DataFrame:
    """names (with set and name) with the code of the active value of that name, and whether there is one; the smallest of several."""
    active = enum.where(~F.col("retired")).groupBy("set", "name").agg(F.min("code").alias("code"))
    return names.join(active, ["set", "name"], "left").withColumn("valid", F.col("code").isNotNull())


def instances(frames: DataFrame, definitions: DataFrame, own: DataFrame) -> DataFrame:
    """Attributes of frames made from templates: those that the template (template, name, default, required) defines, with a frame's own value (id, name, value) where it is set.

    is_set tells whether there is a value, and missing whether the template requires one and there is none.
    """
    d = definitions.select("template", "name", F.col("default").alias("_default"), "required")
    j = frames.select("id", "template").join(d, "template").join(own.select("id", "name", F.col("value").alias("_own")), ["id", "name"], "left")
    value = F.coalesce("_own", "_default")
    return j.select("id", "template", "name", value.alias("value"), value.isNotNull().alias("is_set"), (F.col("required") & value.isNull()).alias("missing"))


def union_results(*parts: DataFrame, keys: tuple[str, ...] = ("tag_id", "us", "seq")) -> DataFrame:
    """Rows of several results, those of equal keys once: from the first result that has them."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    columns = [c for c in parts[0].columns if c not in keys]
    kept = out.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_part").alias("_row"))
    return kept.select(*keys, "_row.*").select(*parts[0].columns)


def delivery_stats(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Deliveries by outcome: delivered or acknowledged, failed or expired, pending or sent, and the share that failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = deliveries.groupBy(*keys).agg(n("DELIVERED", "ACKNOWLEDGED").alias("delivered"), n("FAILED", "EXPIRED").alias("failed"), n("PENDING", "SENT").alias("pending"))
    return g.withColumn("failure_rate", F.coalesce(F.try_divide("failed", F.col("delivered") + F.col("failed")), F.lit(0.0)))
