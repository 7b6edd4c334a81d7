import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(i, f"plain words number {i} and some more of them {i * 7} end", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, long, "en", "s0"), (103, "one", "en", "s1"),
             (104, rows[5][1], "en", "s2"), (None, "text without an id at all here", "en", "s0"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", "'x' as shard", "1 as slot", "2 as score", "3 as position", "4 as n", "'k' as key", "5 as label").cache()
