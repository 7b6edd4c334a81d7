import json
from collections import Counter

from linkloom.llm import toolcalls


def test_every_result_is_linked_or_a_row(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "t", "{}", []), (1, "b", 3, "t", "{}", []), (1, None, 5, "t", "{}", []), (2, "d", 1, "t", "{}", []), (2, "d", 2, "t", "{}", [])],
        "conv_id bigint, call_id string, turn int, name string, arguments string, after array<string>")
    results = spark.createDataFrame(
        [(1, "a", 2, "first"), (1, "a", 4, "second"), (1, "a", 2, "first"), (1, "a", None, None), (1, "a", None, None), (1, None, 6, "n1"),
         (1, None, 7, "n2"), (None, None, 8, "n3"), (None, None, 8, "n3"), (None, "a", 9, "n4"), (1, "x", 2, "lost"), (1, "x", 3, "lost too"),
         (2, "d", 3, "both"), (2, "d", 4, "more")],
        "conv_id bigint, call_id string, turn int, content string")
    schemas = spark.createDataFrame([("t", None, None, None)], "name string, param string, type string, required boolean")
    got = toolcalls.link_calls(calls, results, schemas, every_result=True).collect()
    of_calls = Counter((r["conv_id"], r["call_id"], r["turn"], r["status"], r["n_results"], json.loads(r["json"]).get("result"))
                       for r in got if "name" in json.loads(r["json"]))
    assert of_calls == Counter([(1, "a", 1, "linked", 5, None), (1, "b", 3, "unanswered", 0, None), (1, None, 5, "unanswered", 0, None),
                                (2, "d", 1, "repeated", 2, "both"), (2, "d", 2, "repeated", 2, "both")])
    alone = Counter((r["conv_id"], r["call_id"], r["turn"], r["status"], r["n_results"], json.loads(r["json"]).get("result"))
                    for r in got if "name" not in json.loads(r["json"]))
    assert alone == Counter([(1, "a", None, "repeated", 5, None), (1, "a", 2, "repeated", 5, "first"), (1, "a", 2, "repeated", 5, "first"),
                             (1, "a", 4, "repeated", 5, "second"), (1, None, 6, "orphan", 1, "n1"), (1, None, 7, "orphan", 1, "n2"),
                             (None, None, 8, "orphan", 1, "n3"), (None, None, 8, "orphan", 1, "n3"), (None, "a", 9, "orphan", 1, "n4"),
                             (1, "x", 2, "orphan", 2, "lost"), (1, "x", 3, "orphan", 2, "lost too"), (2, "d", 4, "repeated", 2, "more")])
