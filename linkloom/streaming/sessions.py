"""Sessions and sliding limits over event tables, safe for hot keys.

A key that holds much of the data must not end in one task, so order-dependent steps run per
(key, time bucket). What crosses a bucket border is carried by a table of one row per bucket.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from linkloom.store import attach


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def with_sessions(events: DataFrame, key: str, ts: str, gap_seconds: float, bucket_seconds: float = 86400.0) -> DataFrame:
    """Add ``session``: events of a key belong together while less than ``gap_seconds`` lie between.

    ``events`` must be a stored table (it is read three times).
    """
    gap, size = int(gap_seconds * 1e6), int(bucket_seconds * 1e6)
    at = micros(F.col(ts))
    cut = events.withColumn("_at", at).withColumn("_bucket", F.floor(at / size))
    ends = cut.groupBy(key, "_bucket").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    # Buckets with events per key: bounded by the time covered, not by the events.
    per_key = Window.partitionBy(key).orderBy("_bucket")
    before = ends.select(key, "_bucket", F.lag("_hi").over(per_key).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy("_at")
    marked = (attach(cut, before, [key, "_bucket"], "inner")
              .withColumn("_prev", F.coalesce(F.lag("_at").over(inside), F.col("_before")))
              .withColumn("_start", (F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") >= gap)).cast("int")))
    starts = marked.groupBy(key, "_bucket").agg(F.sum("_start").alias("_n"))
    done = per_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select(key, "_bucket", F.coalesce(F.sum("_n").over(done), F.lit(0)).alias("_offset"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (attach(marked.withColumn("_local", F.sum("_start").over(running)), offsets, [key, "_bucket"], "inner")
            .withColumn("session", F.col("_local") + F.col("_offset"))
            .drop("_at", "_bucket", "_before", "_prev", "_start", "_local", "_offset"))


def bursts(events: DataFrame, key: str, ts: str, quiet_seconds: float) -> DataFrame:
    """One row per burst: key, first, last, events, fires_at (``quiet_seconds`` after the last)."""
    spans = with_sessions(events.select(key, ts), key, ts, quiet_seconds).groupBy(key, "session").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))
    return spans.select(key, "first", "last", "events",
                        F.timestamp_micros(micros(F.col("last")) + int(quiet_seconds * 1e6)).alias("fires_at"))


def burst_stream(stream: DataFrame, key: str, ts: str, quiet: str, late: str) -> DataFrame:
    """The streaming twin: session windows closed by the watermark."""
    return (stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last"))
            .select(key, F.col("w.start").alias("first"), "last", "events", F.col("w.end").alias("fires_at")))


def sliding_limit(events: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float) -> DataFrame:
    """Add ``accepted``: at most ``limit`` accepted events of a key in any ``window_seconds``.

    Rejected events do not count, so acceptance depends on earlier acceptance. After a pause of
    a window nothing earlier counts any more: the events between two such pauses are decided on
    their own, in order, by a task that holds at most ``limit`` times.
    """
    cut = with_sessions(events, key, ts, window_seconds).withColumn("_us", micros(F.col(ts)))
    placed = cut.repartition(key, "session").sortWithinPartitions(key, "session", "_us", order)
    window = int(window_seconds * 1e6)
    schema = StructType([*placed.schema.fields, StructField("accepted", BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            verdicts = []
            for k, s, now in zip(batch[key], batch["session"], batch["_us"]):
                if (k, s) != current:
                    current, held = (k, s), deque()
                while held and now - held[0] >= window:
                    held.popleft()
                ok = len(held) < limit
                if ok:
                    held.append(now)
                verdicts.append(ok)
            yield batch.assign(accepted=verdicts)

    return placed.mapInPandas(decide, schema).drop("session", "_us")


def sliding_counts(events: DataFrame, key: str, ts: str, window_seconds: float) -> DataFrame:
    """Add ``in_window``: events of the key within the last ``window_seconds``, this one included."""
    cut = with_sessions(events, key, ts, window_seconds).withColumn("_us", micros(F.col(ts)))
    w = Window.partitionBy(key, "session").orderBy("_us").rangeBetween(-int(window_seconds * 1e6) + 1, 0)
    return cut.withColumn("in_window", F.count(F.lit(1)).over(w)).drop("session", "_us")
