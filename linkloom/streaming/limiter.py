"""Sliding limit on a stream, decided in the order of event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Limiter(StatefulProcessor):
    """Per key: the accepted times of the current window, and events that wait for the watermark to pass them."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us bigint")
        self.pending = handle.getListState("pending", "us bigint, event_id bigint")

    def _rows(self, key, ids: list[int], accepted: list[bool], late: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(ids), "event_id": ids, "accepted": accepted, "late": [late] * len(ids)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for chunk in rows:
            behind = chunk["us"] < mark
            late = [int(i) for i in chunk["event_id"][behind]]
            if late:
                yield self._rows(key, late, [False] * len(late), True)
            fresh = [(int(us), int(i)) for us, i in zip(chunk["us"][~behind], chunk["event_id"][~behind])]
            if fresh:
                self.pending.appendList(fresh)
                low = min(fresh)[0]
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(us), int(i)) for us, i in self.pending.get()) if self.pending.exists() else []
        ready = [w for w in waiting if w[0] < mark]
        if not ready:
            return
        held = deque(t[0] for t in self.times.get()) if self.times.exists() else deque()
        verdicts = []
        for now, _ in ready:
            while held and now - held[0] >= self.window:
                held.popleft()
            verdicts.append(len(held) < self.limit)
            if verdicts[-1]:
                held.append(now)
        rest = waiting[len(ready):]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.pending.clear()
        # Held times are rising, so the list is written as it will be read.
        if held:
            self.times.put([(int(t),) for t in held])
        else:
            self.times.clear()
        yield self._rows(key, [i for _, i in ready], verdicts, False)

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, key: str, ts: str, limit: int, window_seconds: float, delay: str = "1 hour") -> DataFrame:
    """key, event_id, accepted, late: at most ``limit`` accepted events of a key in any window of ``window_seconds``.

    An event waits in the state of its key until the watermark, which is ``delay`` behind the latest event, has passed it;
    then events are decided in the order of time and event_id, however they arrived. So the result is that of the batch
    operator for all events that come within ``delay``. A later one would change what has been decided: it is refused at
    once and marked late, and takes no place in the window; events without a time likewise.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    # The time column is left out after the watermark is set, so late rows are not dropped before they are seen here.
    never = F.lit(-(1 << 62)).cast("bigint")
    rows = stream.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), "event_id", F.coalesce(F.unix_micros(ts), never).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, int(window_seconds * 1e6)),
        outputStructType="key string, event_id bigint, accepted boolean, late boolean", outputMode="Append", timeMode="EventTime")
