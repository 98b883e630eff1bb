"""Transform compression of series: overlapped, windowed blocks, the largest coefficients, quantised, and back.

Rows of a series are numbered, and each lies in two blocks of n rows that overlap by half; a series ends
with a short half-filled block, so its first and last rows are in two blocks too. A block is weighted
by a sine window, transformed by an orthonormal cosine transform, and keeps its `keep` largest
coefficients as multiples of a step. Going back, blocks are weighted again and added: the squares
of the two weights of a row add up to one, so without any loss all values come back.

Each block says how far it can be off (the root of what was dropped and of half a step for each coefficient
kept), and a row is off by at most the root of the sum of squares of its two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.points import ordered


def window(n: int) -> np.ndarray:
    """Sine window: the squares of weights half a block apart add up to one."""
    return np.sin(np.pi * (np.arange(n) + 0.5) / n)


def cosines(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform (DCT-II)."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(np.where(k == 0, 1.0, 2.0) / n) * np.cos(np.pi * (i + 0.5) * k / n)


def compress(points: DataFrame, n: int = 32, keep: int = 8, step: float = 0.25) -> DataFrame:
    """tag_id, block, places and levels (coefficient = level * step) of the kept coefficients, and bound.

    Points without a value are left out. A coefficient of level 0 isn't stored.
    """
    if n % 2:
        raise ValueError("blocks overlap by half, so their length is even")
    p = points.where(F.col("value").isNotNull() & ~F.isnan("value")).select("tag_id", "value", (F.row_number().over(ordered()) - 1).alias("_r"))
    half = F.floor(F.col("_r") / (n // 2))
    p = p.select("tag_id", "value", "_r", F.explode(F.array(half, half + 1)).alias("block"))
    place = (F.col("_r") - (F.col("block") - 1) * (n // 2)).cast("int")
    b = p.groupBy("tag_id", "block").agg(F.collect_list(F.struct(place.alias("i"), "value")).alias("rows"))  # at most n rows
    base = cosines(n) * window(n)

    @F.pandas_udf("places array<int>, levels array<long>, bound double")
    def transform(rows: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(rows), n))
        for r, own in enumerate(rows):
            for e in own:
                x[r, e["i"]] = e["value"]
        c = x @ base.T
        order = np.argsort(-np.abs(c), axis=1, kind="stable")[:, :keep]
        level = np.rint(np.take_along_axis(c, order, axis=1) / step).astype(np.int64)
        lost = (c * c).sum(axis=1) - (np.take_along_axis(c, order, axis=1) ** 2).sum(axis=1)
        bound = np.sqrt(np.maximum(lost, 0) + order.shape[1] * step * step / 4)
        kept = [(o[v != 0], v[v != 0]) for o, v in zip(order, level, strict=True)]
        return pd.DataFrame({"places": [o for o, _ in kept], "levels": [v for _, v in kept], "bound": bound})

    return b.select("tag_id", "block", transform("rows").alias("t")).select("tag_id", "block", "t.*")


def decompress(blocks: DataFrame, points: DataFrame, n: int = 32, step: float = 0.25) -> DataFrame:
    """tag_id, us, seq of the points with the value that their blocks give back, and the bound of its error.

    Only the times of points are used. Spark takes the rows of blocks for as small as their compressed codes
    and would broadcast them all, so the join is told to merge.
    """
    base = cosines(n) * window(n)

    @F.pandas_udf("array<double>")
    def back(places: pd.Series, levels: pd.Series) -> pd.Series:
        c = np.zeros((len(places), n))
        for r, (o, v) in enumerate(zip(places, levels, strict=True)):
            c[r, np.asarray(o, int)] = np.asarray(v) * step
        return pd.Series(list(c @ base))

    rows = blocks.select("tag_id", "block", "bound", F.posexplode(back("places", "levels")).alias("_i", "_part"))
    parts = rows.select("tag_id", ((F.col("block") - 1) * (n // 2) + F.col("_i")).alias("_r"), "_part", "bound").groupBy("tag_id", "_r").agg(F.sum("_part").alias("value"), F.sqrt(F.sum(F.col("bound") * F.col("bound"))).alias("bound"))
    at = points.where(F.col("value").isNotNull() & ~F.isnan("value")).select("tag_id", "us", "seq", (F.row_number().over(ordered()) - 1).alias("_r"))
    return at.join(parts.hint("merge"), ["tag_id", "_r"]).select("tag_id", "us", "seq", "value", "bound")


def figures(points: DataFrame, rebuilt: DataFrame, blocks: DataFrame, bits: int = 24) -> DataFrame:
    """For each series its points, coefficients stored, ratio of 64 n to `bits` a coefficient, root mean square and largest error."""
    d = points.select("tag_id", "seq", F.col("value").alias("_a")).join(rebuilt.select("tag_id", "seq", "value"), ["tag_id", "seq"])
    e = F.col("_a") - F.col("value")
    size = blocks.groupBy("tag_id").agg(F.sum(F.size("levels")).alias("stored"))
    g = d.groupBy("tag_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("largest"))
    return g.join(size, "tag_id").select("tag_id", "n", "stored", F.try_divide(64.0 * F.col("n"), F.col("stored") * bits).alias("ratio"), "rmse", "largest")


def weighted(values: DataFrame, kind: str, n: int) -> DataFrame:
    """Each series cut into runs of n rows (the last one as long as it is), multiplied by a window of the run's length.

    kind: hann, hamming, blackman or none. A run of one row has the weight 1.
    """
    a, b, c = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08), "none": (1.0, 0.0, 0.0)}[kind]
    p = values.where("value is not null").withColumn("_r", F.row_number().over(ordered()) - 1)
    p = p.withColumn("run", F.floor(F.col("_r") / n)).withColumn("_i", F.col("_r") % n)
    top = F.count("*").over(Window.partitionBy("tag_id", "run")) - 1
    x = 2 * np.pi * F.col("_i") / F.nullif(top, F.lit(0))
    weight = F.coalesce(a - b * F.cos(x) + c * F.cos(2 * x), F.lit(1.0))
    return p.select("tag_id", "us", "seq", "run", (F.col("value") * weight).alias("value"))
