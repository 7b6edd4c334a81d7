import base64
import hashlib
import random

import numpy as np
import pytest

from linkloom.llm import toolcalls, vectors, warc


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "same"), (5, "u", "same"), (3, None, "same"), (2, "v", None), (7, "v", ""), (9, "w", "ä" * 3000), (None, "x", "alone"),
            (9, "w", "ä" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    back = warc.read_archives(warc.write_archives(warc.assign_types(pages))).collect()
    assert all(r["valid"] for r in back) and len(back) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {"same": 5, "": 7, "ä" * 3000: 9}
    want = sorted((str(i or ""), len((t or "").encode()), sha(t), "response" if top.get(t or "", i) == i else "revisit",
                   "" if top.get(t or "", i) == i else str(top[t or ""])) for i, _, t in rows)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or "") for r in back) == want
    assert warc.read_archives(warc.write_archives(warc.assign_types(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_returns_all_undamaged_records(packed):
    rnd = random.Random(3)
    recs = [warc.record(str(i), f"http://h/{i}", b"x" * rnd.randint(0, 500) + bytes([i]), 1, "A", None) for i in range(12)]
    if not packed:
        import gzip
        recs = [gzip.decompress(r) for r in recs]
    starts = [sum(map(len, recs[:i])) for i in range(13)]
    whole = b"".join(recs)
    for trial in range(30):
        data, hurt = bytearray(whole), set()
        for i in rnd.sample(range(12), 3):
            at = rnd.randrange(starts[i] + 12, starts[i + 1] - 12)
            data[at] ^= 0x55
            hurt.add(i)
        got = list(warc.salvage(bytes(data)))
        names = [x.head.get("warc-record-id", "") for x in got if isinstance(x, warc.Record) and x.sound]
        ids = [int(n[10:-1]) for n in names if n.startswith("<urn:page:") and n[10:-1].isdigit()]
        # A byte flipped in a header may leave a record that is valid in itself; no other record is lost.
        assert set(range(12)) - hurt <= set(ids) if packed else set(range(12)) - hurt <= set(ids) | hurt
        gaps = [x for x in got if isinstance(x, tuple)]
        assert all(0 <= a < b <= len(data) for a, b in gaps)
        if packed:
            assert sorted(ids) == sorted(set(range(12)) - hurt) and gaps
    cut = list(warc.salvage(b"junk" + whole[:-5]))
    assert cut[0] == (0, 4) and cut[-1] == (starts[11] + 4, len(whole) - 1)
    # Of a cut member the record is there, but its checksum is not.
    assert [x.sound for x in cut if isinstance(x, warc.Record)] == [True] * 11 + [False] * packed
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_members_of_many_records():
    import gzip
    rnd = random.Random(5)
    plain = [gzip.decompress(warc.record(str(i), f"http://h/{i}", rnd.randbytes(3000) + bytes([i]), 1, "A", None)) for i in range(6)]
    page = lambda x: int(x.head["warc-record-id"][10:-1])
    # A byte flipped before compression: one record is bad, the gap lies in the decompressed bytes.
    hurt = bytearray(b"".join(plain))
    at = len(plain[0]) + len(plain[1]) + len(plain[2]) - 50
    hurt[at] ^= 1
    member = gzip.compress(bytes(hurt), mtime=0)
    got = list(warc.salvage(b"xx" + member + gzip.compress(plain[0], mtime=0)))
    start = len(plain[0]) + len(plain[1])
    assert got[0] == (0, 2) and (2, 2 + len(member), start, start + len(plain[2])) in got
    assert [page(x) for x in got if isinstance(x, warc.Record)] == [0, 1, 3, 4, 5, 0]
    assert all(x.sound for x in got if isinstance(x, warc.Record))
    # A cut member, and one with a broken place in the middle: what came before is returned.
    member = gzip.compress(b"".join(plain), mtime=0)
    got = list(warc.salvage(member[:-6]))
    assert [page(x) for x in got[:-1]] == list(range(6)) and got[-1] == (0, len(member) - 6) and not got[0].sound
    got = list(warc.salvage(member[:len(member) // 2] + b"\0" * 40 + plain[3]))
    assert [page(x) for x in got if isinstance(x, warc.Record)][:2] == [0, 1]
    assert page(got[-1]) == 3 and got[-1].sound and isinstance(got[-2], tuple)


def test_archives_with_broken_copies_and_nulls(spark):
    rows = [(i, f"u{i}", f"page {i % 5} " * (i % 40)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    clean = warc.read_archives(warc.write_archives(warc.assign_types(pages)))
    packed = warc.write_archives(warc.assign_types(pages), broken=3)
    got = warc.read_archives(packed.unionByName(packed.limit(1).selectExpr("cast(null as binary) as content")))
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    good = got.where("record_type <> 'gap' and valid and sound")
    assert good.select(*kept).exceptAll(clean.select(*kept)).count() == 0 and good.count() == 200
    assert got.where("record_type = 'gap'").count() >= 60 and good.agg({"gap_bytes": "sum"}).first()[0] > 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        c = rng.standard_normal(32)
        for _ in range(25):
            rows.append(((c + 0.1 * rng.standard_normal(32)).tolist(), g % 3))
    rows += [(rng.standard_normal(32).tolist(), 1) for _ in range(100)] + [rows[0]] * 40
    rows += [(None, 1), ([], 1), ([0.0] * 32, 1), ([1.0, None], 2), ([float("nan")] * 32, 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1),
             ([3.0], 1), ([5.0], 1)]
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, (v, y) in enumerate(rows)], "vec_id bigint, embedding array<float>, label int, node int, w int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, k=8).collect()}
    good = [i for i, (v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.float32(rows[i][0]).astype(float) / np.linalg.norm(np.float32(rows[i][0]).astype(float)) for i in good}
    links = {i: {j for j in good if j != i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98}
             for i in good}
    true, found = sum(map(len, links.values())), sum(got[i]["n_links"] for i in good)
    assert len(got) == len(rows) and 0.97 * true <= found <= true
    assert got[good[-1]]["component_id"] == good[-2] and got[good[-1]]["n_links"] == 1
    for i in set(range(len(rows))) - set(good):
        assert tuple(got[i])[1:] == (0, i, True)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())
    assert got[440]["n_links"] >= 40 or true == found
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_multi_sequence_visits_nearest_cells():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(5)
    want = sorted((a[i] + b[j], i * 5 + j) for i in range(6) for j in range(5))
    assert vectors.cells(a, b, 17) == [c for _, c in want[:17]]


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "look", '{"q":"x","n":2}', []), (1, "b", 2, "look", ' {"n": 1.5, "q": "y" } ', ["a"]), (1, "c", 3, "look", '{"q":1,"z":[]}', ["b", "a"]),
        (1, "d", 4, "none", "[1]", ["e"]), (1, "e", 5, "look", None, ["d"]), (1, "f", 6, "look", "{bad", ["gone", None]), (2, "a", 1, "now", "{}", None),
        (2, "a", 3, "now", '{"x":null}', ["a2"]), (2, "a2", 9, "look", '{"q":"é\\n","n":0}', []), (None, "n", 1, "now", "{}", [])],
        "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 2, "r1"), (1, "b", 1, "early"), (1, "zz", 3, "lost"), (2, "a2", 10, None), (None, "n", 2, "x")],
                                    "conv_id bigint, call_id string, turn bigint, content string")
    schemas = spark.createDataFrame([("look", "q", "string", True), ("look", "n", "integer", True), ("now", None, None, None)],
                                    "name string, param string, type string, required boolean")
    got = sorted(toolcalls.link_calls(calls, results, schemas).collect(), key=lambda r: (r["conv_id"] or 0, r["call_id"], r["turn"]))
    by = {(r["conv_id"], r["call_id"], r["turn"]): r for r in got}
    assert len(by) == len(got) == 12
    one = by[1, "a", 1]
    assert (one["status"], one["level"], one["valid"], one["n_results"]) == ("linked", 0, True, 2)
    assert one["json"] == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"look","result":"r1"}'
    assert (by[1, "b", 2]["status"], by[1, "b", 2]["level"], by[1, "b", 2]["errors"]) == ("early", 1, ["type:n"])
    assert (by[1, "c", 3]["level"], by[1, "c", 3]["errors"]) == (2, ["missing:n", "type:q", "unknown:z"])
    assert by[1, "d", 4]["level"] is None and by[1, "d", 4]["errors"] == ["not_an_object", "unknown_tool"]
    assert by[1, "e", 5]["status"] == "unanswered" and by[1, "f", 6]["level"] == 0 and by[1, "f", 6]["json"] == '{"arguments_text":"{bad","id":"f","name":"look"}'
    assert by[1, "zz", 3]["status"] == "orphan" and by[2, "a", 1]["status"] == by[2, "a", 3]["status"] == "repeated"
    assert by[2, "a", 3]["level"] == 1 and by[2, "a2", 9]["json"] == '{"arguments":{"n":0,"q":"é\\n"},"id":"a2","name":"look"}'
    assert toolcalls.link_calls(calls.limit(0), results, schemas).count() == 5
    assert toolcalls.link_calls(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_levels_of_long_chains_and_meshes(spark):
    rnd, rows, want = random.Random(4), [], {}
    for c in range(4):
        deps = {i: [rnd.randrange(max(1, i)) for _ in range(rnd.choice((0, 1, 1, 1, 2, 3)))] if i else [] for i in range(30)}
        rows += [(c, str(i), [str(d) for d in deps[i]]) for i in deps]
        for i in range(30):
            want[c, str(i)] = 1 + max((want[c, str(d)] for d in deps[i]), default=-1)
    rows += [(9, str(i), [str(i - 1)]) for i in range(300)] + [(10, "x", ["y"]), (10, "y", ["x"]), (10, "z", ["y"]), (10, "s", ["s"])]
    want |= {(9, str(i)): i for i in range(300)}
    got = toolcalls.levels(spark.createDataFrame(rows, "conv_id bigint, call_id string, after array<string>"))
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got.collect()} == want
