"""State machines over series: one pass in time order, with the state of one series and one batch in memory.

Partitions are sorted by series and time and read as a stream of batches, so a series of
any length runs in bounded memory and many short series cost no grouping each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "tag_id long, us long, seq long, value double"


def in_order(points: DataFrame) -> DataFrame:
    """Points with a value, each series in one partition and in time order."""
    p = points.where(F.col("value").isNotNull() & ~F.isnan("value")).select("tag_id", "us", "seq", "value")
    return p.repartition("tag_id").sortWithinPartitions("tag_id", "us", "seq")


def follow(points: DataFrame, start: Callable, schema: str = POINT) -> DataFrame:
    """The rows that a rule gives for each series.

    start() makes a rule for one series: (step, end), where step(us, seq, value) and end()
    return rows without the series' id.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = step = end = None
        for b in batches:
            out = []
            for t, us, seq, v in zip(*(b[c].tolist() for c in ("tag_id", "us", "seq", "value")), strict=True):
                if step is None or t != tag:
                    out += [(tag, *r) for r in end()] if end else []
                    tag, (step, end) = t, start()
                for r in step(us, seq, v):
                    out.append((t, *r))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(tag, *r) for r in end()] if end else [], columns=names)

    return in_order(points).mapInPandas(run, schema)


def whole(points: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The points of each series that keep(seconds, values) marks; for rules that look both ways, so a series must fit a task."""

    def chosen(parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts)
        return p[keep((p["us"].to_numpy() - p["us"].iloc[0]) / 1e6, p["value"].to_numpy())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            done = []
            edges = np.flatnonzero(np.diff(b["tag_id"].to_numpy())) + 1
            for a, z in zip([0, *edges], [*edges, len(b)], strict=True):
                part = b.iloc[a:z]
                if held and len(part) and held[0]["tag_id"].iloc[0] != part["tag_id"].iloc[0]:
                    done.append(chosen(held))
                    held = []
                held += [part] if len(part) else []
            if done:
                yield pd.concat(done)
        if held:
            yield chosen(held)

    return in_order(points).mapInPandas(run, POINT)


def nothing() -> tuple:
    return ()
