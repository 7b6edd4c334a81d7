import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from linkloom.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        if name != "sharding":
            assert after.columns == clean
        if name in ("mixing", "sharding"):
            assert after.count() == docs.count()
        else:
            assert after.select(clean).exceptAll(docs).count() == 0
        docs = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_documents(docs.select(clean), labels)
    assert scored.count() == docs.count()
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert docs.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0
