"""Aggregates of points by series, bucket and row frame.

Every kind is one Catalyst expression, so any number of kinds is one shuffle
with partial sums. Kinds that need the next point take it from a window that is
partitioned by the same keys as the aggregate, which adds a sort and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quality import is_good
from tidemark.points import SECOND, ordered



def _dt() -> Column:
    return (F.col("_next_us") - F.col("us")) / SECOND


def _area() -> Column:
    return (F.col("value") + F.col("_next_value")) * 0.5 * _dt()


def kinds(percentile: float = 0.5) -> dict[str, Column]:
    """Aggregate expressions by name, over points with _next_us and _next_value."""
    first, last = F.min_by("value", F.struct("us", "seq")), F.max_by("value", F.struct("us", "seq"))
    span = (F.max("us") - F.min("us")) / SECOND
    area, width = F.sum(_area()), F.sum(F.when(_area().isNotNull(), _dt()))
    return {
        "average": F.avg(F.col("value")), "time_average": F.coalesce(F.try_divide(area, width), first),
        "minimum": F.min(F.col("value")), "maximum": F.max(F.col("value")), "range": F.max(F.col("value")) - F.min(F.col("value")), "sum": F.coalesce(F.sum(F.col("value")), F.lit(0.0)), "count": F.count("*"),
        "stddev_pop": F.stddev_pop(F.col("value")), "stddev_samp": F.stddev_samp(F.col("value")), "var_pop": F.var_pop(F.col("value")), "var_samp": F.var_samp(F.col("value")),
        "percentile": F.percentile(F.col("value"), F.lit(percentile)), "median": F.median(F.col("value")),
        "duration_good": F.coalesce(F.sum(F.when(is_good(F.col("quality")), _dt())), F.lit(0.0)),
        "duration_bad": F.coalesce(F.sum(F.when(~is_good(F.col("quality")), _dt())), F.lit(0.0)),
        "first": first, "last": last, "delta": F.when(F.count("*") > 1, last - first), "rate": F.try_divide(last - first, F.when(span > 0, span)),
        "integral": F.coalesce(area, F.lit(0.0)), "percent_good": F.avg(F.when(is_good(F.col("quality")), 100.0).otherwise(0.0)),
    }


_NEED_NEXT = {"time_average", "duration_good", "duration_bad", "integral"}


def with_next(points: DataFrame, *keys: str) -> DataFrame:
    w = ordered(*keys)
    return points.withColumn("_next_us", F.lead("us").over(w)).withColumn("_next_value", F.lead("value").over(w))


def aggregate(points: DataFrame, names: list[str], keys: tuple[str, ...] = ("tag_id",), percentile: float = 0.5) -> DataFrame:
    """The named aggregates of each series (or of each combination of keys)."""
    exprs = kinds(percentile)
    if _NEED_NEXT & set(names):
        points = with_next(points, *keys)
    return points.groupBy(*keys).agg(*[exprs[n].alias(n) for n in names])


def bucket(us: Column, width: int, origin: Column | int = 0) -> Column:
    """Start of the half-open bucket that holds a time; correct before the origin too."""
    o = origin if isinstance(origin, Column) else F.lit(origin).cast("long")
    return us - F.pmod(us - o, F.lit(width).cast("long"))


def bucketed(points: DataFrame, width: int, names: list[str], origin: Column | int = 0, percentile: float = 0.5, dense: bool = False) -> DataFrame:
    """Aggregates by series and time bucket, with sample_count; only pairs inside a bucket count.

    dense adds the empty buckets between a series' first and last one, with no
    values and a count of 0; their number is bounded by the series' own span.
    """
    b = points.withColumn("bucket", bucket(F.col("us"), width, origin))
    out = aggregate(b, [*names, "count"] if "count" not in names else names, ("tag_id", "bucket"), percentile)
    out = out.withColumnRenamed("count", "sample_count")
    if dense:
        span = out.groupBy("tag_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        grid = span.select("tag_id", F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("bucket"))
        out = grid.join(out, ["tag_id", "bucket"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0).cast("long")))
    return out.withColumn("bucket_end", F.col("bucket") + width)


def running(points: DataFrame) -> DataFrame:
    """Count, sum, mean, extremes and deviation of each series up to each point."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return points.select(
        "tag_id", "us", "seq", F.count("value").over(w).alias("run_count"), F.sum("value").over(w).alias("run_sum"), F.avg("value").over(w).alias("run_avg"),
        F.min("value").over(w).alias("run_min"), F.max("value").over(w).alias("run_max"), F.stddev_pop("value").over(w).alias("run_stddev"))


def distribution(points: DataFrame) -> DataFrame:
    """Moments and percentiles of each series; skewness and kurtosis adjusted for the sample, null where undefined."""
    n = F.count("value").cast("double")
    g1 = F.when((n > 2) & (F.var_pop("value") > 0), F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when((n > 3) & (F.var_pop("value") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("value") + 6))
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return points.groupBy("tag_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), g1.alias("skewness"), g2.alias("kurtosis"), F.min("value").alias("low"), F.max("value").alias("high"),
        p.alias("_p"), ((F.max("us") - F.min("us")) / (3600.0 * SECOND)).alias("hours"),
    ).select("tag_id", "n", "mean", "stddev", "skewness", "kurtosis", "low", "high", F.col("_p")[0].alias("p10"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p90"), "hours")


def regression(points: DataFrame) -> DataFrame:
    """Least-squares line of each series over seconds from its first point."""
    first = F.min("us").over(Window.partitionBy("tag_id"))
    x = points.where("value is not null").withColumn("x", (F.col("us") - first) / SECOND)
    return x.groupBy("tag_id").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"), F.count("*").alias("n"))


def good_fraction(points: DataFrame, start: int, end: int) -> DataFrame:
    """Share of [start, end] that is good: pairs with both ends good count whole, with one end half."""
    g = is_good(F.col("quality")).cast("int")
    w = ordered()
    p = points.withColumn("_n", F.lead("us").over(w)).withColumn("_g", (g + F.lead(g).over(w)) / 2)
    clipped = F.greatest(F.lit(0), F.least("_n", F.lit(end)) - F.greatest("us", F.lit(start)))
    return p.groupBy("tag_id").agg((F.coalesce(F.sum(clipped * F.col("_g")), F.lit(0.0)) / (end - start)).alias("good_fraction"))


def zscores(points: DataFrame) -> DataFrame:
    """Each point's distance from its series' mean in sample deviations; 0 where that is 0."""
    w = Window.partitionBy("tag_id")
    z = F.coalesce(F.try_divide(F.col("value") - F.avg(F.col("value")).over(w), F.nullif(F.stddev_samp(F.col("value")).over(w), F.lit(0.0))), F.lit(0.0))
    return points.select("tag_id", "us", "seq", z.alias("z"))


def tukey_outliers(points: DataFrame, k: float = 1.5) -> DataFrame:
    """Points outside the quartile fences of their series (interpolated quartiles, 4 points at least)."""
    q = points.groupBy("tag_id").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("value").alias("n")).where("n >= 4")
    j = points.join(q, "tag_id")
    iqr = F.col("q")[1] - F.col("q")[0]
    return j.where((F.col("value") < F.col("q")[0] - k * iqr) | (F.col("value") > F.col("q")[1] + k * iqr)).select("tag_id", "us", "seq", "value")


def cross_correlation(points: DataFrame, lag: int) -> DataFrame:
    """Mean product of each series with itself `lag` rows on."""
    return points.withColumn("_y", F.lead("value", lag).over(ordered())).groupBy("tag_id").agg(F.avg(F.col("value") * F.col("_y")).alias("cross_correlation"))


def signal_energy(points: DataFrame) -> DataFrame:
    return points.groupBy("tag_id").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))


def entropy(symbols: DataFrame, keys: tuple[str, ...], symbol: str) -> DataFrame:
    """Empirical entropy in bits, and the number of distinct symbols."""
    counts = symbols.groupBy(*keys, symbol).agg(F.count("*").alias("_c"))
    # sum of -p log2 p with p = c / n, as log2 n - sum(c log2 c) / n: no join back for n
    n = F.sum("_c")
    return counts.groupBy(*keys).agg((F.log2(n) - F.sum(F.col("_c") * F.log2("_c")) / n).alias("entropy"), F.count("*").alias("symbols"))


def weighted_score(df: DataFrame, key: str, score: Column, weight: Column) -> DataFrame:
    """Weighted mean by key; negative weights count 0."""
    w = F.greatest(weight, F.lit(0.0))
    return df.groupBy(key).agg(F.try_divide(F.sum(w * score), F.sum(w)).alias("composite"))
