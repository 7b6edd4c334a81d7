from pyspark.sql import functions as F

from linkloom.llm import mixing


def test_schedule_goes_on_from_row_to_row(spark, monkeypatch):
    plan = spark.createDataFrame([(0, 50, 3), (1, 7, 5), (2, 31, 1), (3, 1, 2)], "_i bigint, n bigint, _share bigint")
    whole = sorted(map(tuple, mixing.schedule(plan, 2).collect()))
    monkeypatch.setattr(mixing, "MOST_WORK", 1)
    monkeypatch.setattr(mixing, "_STRETCH", 4)
    assert sorted(map(tuple, mixing.schedule(plan, 2).collect())) == whole
    assert len(whole) == 25 + 4 + 16 + 1 and sorted(r[2] for r in whole) == list(range(46))
    assert mixing.schedule(plan.limit(0), 2).count() == 0


def test_blocks_keep_their_size_however_many_rows(spark):
    """Rows times sources beyond eight times four million made blocks of nine rows."""
    rows = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), (F.col("id") % 300).alias("source"))
    mixed = mixing.mix(rows, mixing.temperature_weights(rows))
    sizes = mixed.groupBy("source", "block").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(sizes) == (8, 15_000)
