import random
import time

from pyspark.sql import functions as F

from linkloom.functions.languages import ScanOptions
from linkloom.sources.trees import read_tree
from linkloom.streaming.churn import windowed_churn
from linkloom.streaming.limiter import limit_stream
from linkloom.streaming.sessions import sliding_limit


def run_limit(spark, folder, stream, **options):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10", "spark.sql.shuffle.partitions": "2",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    held = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        (limit_stream(stream, "user_id", "ts", 3, 100, **options).writeStream.option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination())
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return {r["event_id"]: (r["accepted"], r["late"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def as_events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, s double").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))


def test_limit_of_events_shuffled_over_ten_batches(spark, tmp_path):
    """Arrival is up to 400 s off the order of time, the delay 500 s. A last event of another key closes all others."""
    rnd = random.Random(2)
    rows = [(i, 1 if i < 200 else 2, float(rnd.randrange(2000))) for i in range(260)]
    arrival = sorted(rows, key=lambda r: r[2] + rnd.random() * 400)
    parts = [arrival[k * 26:(k + 1) * 26] for k in range(10)] + [[(1000, 9, 10_000.0)]]
    for k, part in enumerate(parts):
        as_events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    schema = as_events(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_limit(spark, tmp_path, stream, delay="500 seconds")
    batch = sliding_limit(as_events(spark, rows), "user_id", "ts", "event_id", 3, 100)
    assert got == {r["event_id"]: (r["accepted"], False) for r in batch.collect()} and len(got) == 260


def test_late_events_are_refused_and_marked(spark, tmp_path):
    early = [(i, 1, 1000.0 + i) for i in range(5)]
    for part in (early, [(10, 2, 5000.0)], [(20, 1, 900.0), (21, 1, 1002.5), (22, 1, 4999.0), (23, 1, None)], [(30, 3, 9000.0)]):
        as_events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(as_events(spark, early).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_limit(spark, tmp_path, stream, delay="10 seconds")
    assert got == {0: (True, False), 1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 10: (True, False),
                   20: (False, True), 21: (False, True), 22: (True, False), 23: (False, True)}


def test_batch_churn_counts_authors_exactly(spark):
    touches = spark.range(5000).selectExpr("'r' as repo", "'p' as path", "concat('a', id) as author", "timestamp_seconds(id) as ts")
    got = windowed_churn(touches, "1 day", "1 day").collect()
    assert [(r["commits"], r["authors"]) for r in got] == [(5000, 5000)]


def test_tree_below_a_root_whose_name_comes_again(spark, tmp_path, monkeypatch):
    at = tmp_path / "src" / "proj" / "src" / "pkg"
    at.mkdir(parents=True)
    (at / "a.py").write_text("x")
    monkeypatch.chdir(tmp_path)
    for root in (str(tmp_path / "src" / "proj" / "src"), f"file://{tmp_path}/src/proj/src/"):
        assert [r["path"] for r in read_tree(spark, root, ScanOptions.single("py")).collect()] == ["pkg/a.py"]
