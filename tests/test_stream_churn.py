import time

from linkloom.streaming.churn import windowed_churn


def test_streamed_churn_counts_many_authors_exactly(spark, tmp_path):
    """A touch behind the watermark still counts in windows that are open; a later day closes all but the last."""
    day = 86400
    steps = ["select id % 30000 as a, 3600 + id % 1000 as s from range(60000)", f"select 40000 as a, {3 * day} as s",
             f"select 40001 as a, {day - 1} as s union all select null, {2 * day}", f"select 1 as a, {20 * day} as s"]
    for step in steps:
        spark.sql(f"select 'r' as repo, 'p' as path, concat('a', a) as author, timestamp_seconds(s) as ts from ({step})") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    whole = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        (windowed_churn(stream, "2 days", "1 day", "1 day").writeStream.option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    got = {(r["start"].day, r["start"].month): (r["commits"], r["authors"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(31, 12): (60001, 30001), (1, 1): (60001, 30001), (2, 1): (1, 0), (3, 1): (2, 1), (4, 1): (1, 1)}
