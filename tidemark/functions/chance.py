"""Tails of counts as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: exact up to 20, beyond by Stirling's series, whose rest is below 1e-13 there."""
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X >= k) of a Poisson count, null unless the mean is above 0.

    Summed from the larger term outwards, upwards above the mean and downwards (for the
    complement) below it, each term from the one before; terms so many deviations out that they no longer count
    are left, so the sum has in the order of sqrt(mean) terms.
    """
    n = k.cast("long")
    reach = (40 + 12 * F.sqrt(F.greatest(mean, F.lit(1.0)))).cast("long")
    pmf = lambda i: F.exp(i.cast("double") * F.ln(mean) - mean - log_factorial(i))

    def total(first: Column, count: Column, ratio) -> Column:
        """pmf(first) and `count` further terms, each `ratio`(step) times the one before."""
        steps = F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1).cast("long")))
        start = F.struct(pmf(first).alias("term"), pmf(first).alias("sum"))

        def step(acc: Column, i: Column) -> Column:
            term = F.when(i <= count, acc["term"] * ratio(first, i)).otherwise(0.0)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(steps, start, step)["sum"]

    above = total(n, reach, lambda f, i: mean / (f + i).cast("double"))
    below = total(n - 1, F.least(n - 1, reach), lambda f, i: (f - i + 1).cast("double") / mean)
    return F.when(mean > 0, F.when(n <= 0, 1.0).when(n.cast("double") > mean, F.least(F.lit(1.0), above)).otherwise(F.greatest(F.lit(0.0), 1 - below)))
