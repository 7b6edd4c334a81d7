import random
import re

import xxhash

from linkloom.llm import simhash
from linkloom.llm.common import star_components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint(docs):
    for r in docs.select("text").collect() + [("ÄA b C\x0bd",), ("A B",), ("  ",)]:
        assert simhash.fingerprint(r[0].encode() if r[0] is not None else None) % 2**64 == brute_print(r[0])


def test_links_of_all_pairs_in_three_bits(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:20]:  # chains and clouds around some
        for _ in range(30):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps |= {0, 1, 2**63, 7, 2**64 - 1}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    for block in (2048, 4):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, block=block).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        assert components(fps, links) == want


def test_components_of_documents(docs):
    ids = {r["doc_id"]: r for r in simhash.near_copies(docs.where("doc_id is not null")).collect()}
    texts = {r["doc_id"]: brute_print(r["text"]) for r in docs.where("doc_id is not null").collect()}
    want = components(texts, [(a, b) for a in texts for b in texts if a < b and (texts[a] ^ texts[b]).bit_count() <= 3])
    assert {k: r["component_id"] for k, r in ids.items()} == want
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_stars_on_a_long_ring_and_a_hub(spark):
    n = 2000
    ring = spark.range(n).selectExpr("(id * 7919) % 2000 as a", "((id + 1) * 7919) % 2000 as b")
    hub = spark.range(1, n).selectExpr("5000L as a", "5000 + id as b")
    odd = spark.createDataFrame([(9, 9), (None, 3), (-4, -9)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in star_components(ring.unionByName(hub).unionByName(odd), "test").collect()}
    assert got == {i: 0 for i in range(n)} | {5000 + i: 5000 for i in range(n)} | {-4: -9, -9: -9}
    assert star_components(ring.limit(0), "test").count() == 0
