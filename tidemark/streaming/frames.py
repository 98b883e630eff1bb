"""Event frames by triggers in a stream.

State of a series: points that wait for the watermark, its last point's signals, and
the open frame of each template. Points are worked off in time order once the watermark has
passed them, so the frames don't depend on the order in which points come in, and are those
that the batch operator makes of the same points. Timers of event time wake a series when its
next point or the time limit of a frame is due, also when no point of it comes
any more. A frame is given out once, when it closes.

Points later than the watermark take no part; Spark drops them before the state and counts them
(`late_rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.triggers import FRAME, FrameTemplate, _frame_rows, advance, signals
from tidemark.plans.expression import compile_formula

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Frames(StatefulProcessor):
    def __init__(self, templates: list[FrameTemplate]):
        self.templates, self.names = templates, signals(templates)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, s array<double>")
        self.last = handle.getValueState("last", "s array<double>")
        self.opened = handle.getMapState("opened", "template int", "us long, seq long")

    def _work(self, tag: int, fresh: list[tuple], timers) -> pd.DataFrame:
        """Works off what the watermark has passed, and sets timers for what comes next."""
        now = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted([*((r[0], r[1], tuple(r[2])) for r in (self.waiting.get() if self.waiting.exists() else ())), *fresh], key=lambda r: r[:2])
        due = [r for r in rows if r[0] <= now]
        rest = rows[len(due) :]
        opened = {k[0]: (v[0], v[1]) for k, v in self.opened.iterator()} if self.opened.exists() else {}
        before = tuple(self.last.get()[0]) if self.last.exists() else (None,) * len(self.names)
        out = []
        for us, seq, s in due:
            for k, t in enumerate(self.templates):
                hit = lambda triggers: any(x.fires(before[i], s[i]) for x in triggers for i in (self.names.index(x.signal),))  # noqa: E731, B023
                left, closed = advance(t, opened.pop(k, None), us, seq, hit(t.start), hit(t.end))
                out += [(tag, t.name, *closed)] if closed else []
                opened |= {k: left} if left else {}
            before = s
        for k, (us, seq) in list(opened.items()):
            limit = self.templates[k].limit_us
            if limit is not None and us + limit < now:
                out.append((tag, self.templates[k].name, us, seq, us + limit, "limit"))
                del opened[k]
        self._keep(rest, before if due else None, opened)
        ahead = [rest[0][0]] if rest else []
        ahead += [us + limit + 1 for k, (us, _) in opened.items() if (limit := self.templates[k].limit_us) is not None]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ahead:
            self.handle.registerTimer(-(-min(ahead) // 1000))
        return _frame_rows(out)

    def _keep(self, rest: list[tuple], last: tuple | None, opened: dict) -> None:
        if rest:
            self.waiting.put([(us, seq, list(s)) for us, seq, s in rest])
        else:
            self.waiting.clear()
        if last is not None:
            self.last.update((list(last),))
        self.opened.clear()
        for k, v in opened.items():
            self.opened.updateValue((k,), v)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for b in rows:
            s = b[[f"s{i}" for i in range(len(self.names))]]
            s = s.astype(object).where(s.notna(), None)
            fresh += zip(b["us"].tolist(), b["seq"].tolist(), s.itertuples(index=False, name=None), strict=True)
        yield self._work(key[0], fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._work(key[0], [], timerValues)

    def close(self) -> None:
        pass


def frames(points: DataFrame, templates: list[FrameTemplate], late: str) -> DataFrame:
    """Frames of a stream of points (with their time as ts) as they close; points more than `late` behind are dropped."""
    spark = points.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"state with timers needs {PROVIDER} set to {ROCKS}")
    p = points.withWatermark("ts", late).where(F.col("value").isNotNull())
    p = p.select("tag_id", "ts", "us", "seq", *[compile_formula(s).alias(f"s{i}") for i, s in enumerate(signals(templates))])
    return p.groupBy("tag_id").transformWithStateInPandas(_Frames(templates), FRAME, "append", "eventTime")


def late_rows(query: StreamingQuery) -> int:
    """Points that came after the watermark had passed them, in the batches of which the query has kept the progress."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
