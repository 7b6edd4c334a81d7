"""Streaming queries, run to the end of the supplied tables, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.functions.languages import ScanOptions
from linkloom.plans import oracle as O
from linkloom.plans import trees as T
from linkloom.plans import views as V
from linkloom.plans.catalog import query
from linkloom.store import scratch_root
from linkloom.streaming.churn import windowed_churn
from linkloom.streaming.limiter import limit_stream
from linkloom.streaming.refresh import GraphRefresh
from linkloom.streaming.sessions import burst_stream, bursts, sliding_counts, sliding_limit


def _instant(df):
    """The table stores UTC wall time; as an instant it does not depend on the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))))


def _events(spark, sf):
    return _instant(V.table(spark, sf, "events"))


def _stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return _instant(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


_ROCKS = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _run(spark, df, conf=None):
    """Run a stream over what is there, into a parquet table.

    A stream's state partitions are fixed when it starts and AQE does not merge them, so this
    run takes one per core. Settings are put back afterwards.
    """
    root = f"{scratch_root(spark)}/streams/{uuid.uuid4().hex}"
    wanted = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), **(conf or {})}
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        (df.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
         .format("parquet").start(f"{root}/out").awaitTermination())
    finally:
        for k, v in held.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _touches(df):
    return df.select(F.lit("events").alias("repo"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"),
                     F.col("event_type").alias("author"), "ts")


_WINDOWS = """
t AS (SELECT 'user' || user_id AS path, event_type AS author, ts, epoch_us(ts) // 86400000000 AS day FROM events),
w AS (SELECT path, author, day - k AS d FROM t, (SELECT unnest(range(0, 7)) AS k)),
g AS MATERIALIZED (SELECT path, d AS start_day, d + 7 AS end_day, count(*)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors FROM w GROUP BY 1, 2)"""


def _days(df):
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    return df.select("path", day("start").alias("start_day"), day("end").alias("end_day"), "commits", "authors")


@query("windowed_churn", "ST1", O.sql(_WINDOWS, "SELECT * FROM g"))
def windowed(spark, sf):
    return _days(windowed_churn(_touches(_events(spark, sf)), "7 days", "1 day"))


@query("windowed_churn_stream", "ST1", O.sql(_WINDOWS, """
SELECT * FROM g WHERE end_day * 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000"""))
def windowed_stream(spark, sf):
    """Only windows the watermark has closed are emitted."""
    return _days(_run(spark, windowed_churn(_touches(_stream(spark, sf)), "7 days", "1 day", "1 day")))


_BURSTS = """
o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS s
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS session FROM o),
b AS MATERIALIZED (SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*)::BIGINT AS events,
  epoch_us(max(ts)) + 7200000000 AS fires_at FROM r GROUP BY user_id, session)"""


def _burst_times(df):
    return df.select("user_id", *[F.unix_micros(c).alias(c) for c in ("first", "last", "fires_at")], "events")


@query("bursts", "ST3", O.sql(_BURSTS, "SELECT * FROM b"))
def bursts_batch(spark, sf):
    """Changes within two hours of each other trigger once, two hours after the last."""
    return _burst_times(bursts(_events(spark, sf), "user_id", "ts", 7200))


@query("bursts_stream", "ST3", O.sql(_BURSTS, """
SELECT * FROM b WHERE fires_at <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""))
def bursts_streamed(spark, sf):
    return _burst_times(_run(spark, burst_stream(_stream(spark, sf), "user_id", "ts", "2 hours", "1 hour")))


@query("sliding_counts", "ST4", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events""")
def sliding_counts_batch(spark, sf):
    return sliding_counts(_events(spark, sf), "user_id", "ts", 86400).select("event_id", "in_window")


# Acceptance as a walk over the events of a user, in order: the state is the list of accepted times.
_LIMIT = """
o AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
a(user_id, rn, event_id, accepted, held) AS (
  SELECT user_id, rn, event_id, TRUE, [us] FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.event_id, len(list_filter(a.held, lambda t: o.us - t < 86400000000)) < 3,
    CASE WHEN len(list_filter(a.held, lambda t: o.us - t < 86400000000)) < 3
         THEN list_append(list_filter(a.held, lambda t: o.us - t < 86400000000), o.us)
         ELSE list_filter(a.held, lambda t: o.us - t < 86400000000) END
  FROM a JOIN o ON o.user_id = a.user_id AND o.rn = a.rn + 1)"""


@query("sliding_limit", "ST4", O.sql(_LIMIT, "SELECT event_id, accepted FROM a"))
def sliding_limit_batch(spark, sf):
    return sliding_limit(_events(spark, sf), "user_id", "ts", "event_id", 3, 86400).select("event_id", "accepted")


@query("sliding_limit_stream", "ST4", O.sql(_LIMIT, """
SELECT a.event_id, accepted, FALSE AS late FROM a JOIN o USING (event_id) WHERE us < (SELECT max(us) // 1000 * 1000 FROM o) - 3600000000"""))
def sliding_limit_streamed(spark, sf):
    """Only events that the watermark has passed are decided."""
    return _run(spark, limit_stream(_stream(spark, sf), "user_id", "ts", 3, 86400), _ROCKS).select("event_id", "accepted", "late")


@query("refresh_edges", "ST2", T.edges_sql("py"))
def refresh_edges(spark, sf):
    """Files arrive twice: first with their heads only, then whole. The last version is the graph."""
    store = _refresh(spark, sf)
    return store.edges(1).select("source", "target", "copies")


@query("refresh_diff", "ST2 J12", T.edges_sql("py").replace("count(*)::BIGINT AS copies", "count(*)::BIGINT AS copies, 'added' AS diff"))
def refresh_diff(spark, sf):
    return _refresh(spark, sf).diff(1).select("source", "target", "copies", "diff")


def _refresh(spark, sf):
    def make():
        root = f"{scratch_root(spark)}/refresh/{uuid.uuid4().hex}"
        whole = T.files_of(spark, sf, "py")
        heads = whole.withColumn("content", F.substring_index("content", "\n", 1))
        store = GraphRefresh(spark, f"{root}/graph", ScanOptions.single("py", hide_external=True))
        for i, step in enumerate((heads, whole)):
            step.withColumn("changed_at", F.lit(i)).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema("repo string, path string, content string, changed_at int").parquet(f"{root}/in")
            # Each run picks up what arrived since the last one, from the stream's own checkpoint.
            stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state") \
                .trigger(availableNow=True).start().awaitTermination()
        return store
    return V.remembered(spark, sf, "refresh", make=make)
