import hashlib
from collections import defaultdict

import corpus_pipeline

from test_mix_exact import brute_run


def mixed_ids(rows):
    """doc_ids in the order of the schedule, by brute force."""
    by_source = defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((hashlib.md5(f"{i}|{text}".encode()).hexdigest(), i))
    names = sorted(by_source)
    for s in names:
        by_source[s].sort()
    most = max(len(v) ** 0.5 for v in by_source.values())
    run = brute_run([(k, len(by_source[s]), int(len(by_source[s]) ** 0.5 / most * 2 ** 52)) for k, s in enumerate(names)])
    return [i for k, block, *_ in run for _, i in by_source[names[k]][block * 8:block * 8 + 8]]


def test_slots_of_a_shard_follow_the_mixed_order(spark):
    rows = [(i, f"text {i}", f"s{0 if i % 3 else i % 7}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    order = mixed_ids(rows)
    assert [r["doc_id"] for r in mixed.collect()] == order
    # The order in which the stage gets its rows does not count.
    got = corpus_pipeline.deal_to_shards(spark, docs.orderBy("doc_id"), "").collect()
    shards = defaultdict(list)
    for r in sorted(got, key=lambda r: r["slot"]):
        shards[r["shard"]].append((r["slot"], r["doc_id"]))
    place = {i: p for p, i in enumerate(order)}
    assert sum(map(len, shards.values())) == len(rows) and len(shards) == corpus_pipeline.SHARDS
    for s in shards.values():
        assert [slot for slot, _ in s] == list(range(len(s)))
        assert [place[i] for _, i in s] == sorted(place[i] for _, i in s)


def test_ranges_carry_their_offsets_and_rows_without_order_come_last(spark, monkeypatch):
    from pyspark.sql import functions as F

    from linkloom.llm import sharding
    monkeypatch.setattr(sharding, "RANGE", 16)
    rows = spark.range(500).withColumn("at", F.when(F.col("id") % 9 != 0, (F.col("id") * 7919) % 500))
    plain = {r["id"]: r["shard"] for r in sharding.shard_rows(rows, [F.col("id")], 3).collect()}
    got = sharding.shard_rows(rows, [F.col("id")], 3, order="at").collect()
    assert {r["id"]: r["shard"] for r in got} == plain
    for s in range(3):
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        at = [r["at"] if r["at"] is not None else 10**9 for r in mine]
        assert at == sorted(at)


def test_texts_move_once_at_most_on_their_way_to_shards(spark, monkeypatch):
    """Clashing columns, repeated rows and null ids stay as they are; only one exchange holds texts."""
    from collections import Counter

    from linkloom import store
    monkeypatch.setattr(store, "BROADCAST_ROWS", 10)  # the join shuffles, as on a large table
    rows = [(i if i % 50 else None, f"text {i % 90}", f"s{i % 4}", "x", i) for i in range(600)] + [(7, "text 7", "s3", "x", 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard string, position int")
    got = corpus_pipeline.deal_to_shards(spark, docs, "")
    assert got.columns == [*docs.columns, "_shard", "slot"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(rows)
    sizes = Counter(r["_shard"] for r in got.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == corpus_pipeline.SHARDS
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("text#") and len([line for line in plan.splitlines() if "Join" in line]) == 1
