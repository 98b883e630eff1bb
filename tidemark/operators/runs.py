"""Run rules of control charts, and their roll-up over a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.points import ordered

#: A point and how many of the last so many lie beyond so many deviations, on one side.
RULES = {"beyond_3": (1, 1, 3.0), "two_of_3": (2, 3, 2.0), "four_of_5": (4, 5, 1.0), "eight_in_row": (8, 8, 0.0)}


def run_rules(points: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Points with z (deviations from the centre) and a flag for each rule that they complete.

    limits: tag_id, centre, deviation of each series; without them the mean and the deviation of all its
    points. The last `of` points are those with a value; a flagged point itself lies beyond. Series
    without deviation have no z and no flags.
    """
    p = points.where("value is not null").select("tag_id", "us", "seq", "value")
    if limits is None:
        limits = p.groupBy("tag_id").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("deviation"))
    z = F.when(F.col("deviation") > 0, (F.col("value") - F.col("centre")) / F.col("deviation"))
    p = p.join(limits.select("tag_id", "centre", "deviation"), "tag_id").select("tag_id", "us", "seq", "value", z.alias("z"))

    def flag(least: int, of: int, sigma: float) -> Column:
        w = ordered().rowsBetween(1 - of, 0)
        side = lambda beyond: beyond & (F.count_if(beyond).over(w) >= least)
        return F.coalesce(side(F.col("z") > sigma) | side(F.col("z") < -sigma), F.lit(False))

    return p.withColumns({name: flag(*rule) for name, rule in RULES.items()})


def violations(flagged: DataFrame) -> DataFrame:
    """For each series its points, those flagged by each rule, and those flagged by any."""
    any_ = F.col("beyond_3") | F.col("two_of_3") | F.col("four_of_5") | F.col("eight_in_row")
    return flagged.groupBy("tag_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(r) for r in RULES], F.count_if(any_).alias("flagged"))
