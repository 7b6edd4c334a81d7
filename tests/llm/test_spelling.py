import random
import re
import zlib
from collections import Counter

import pytest

from linkloom.llm import spelling


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


def brute(n, factor=10):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return sorted(out)


def vocabulary(seed, count, letters, sizes):
    rnd = random.Random(seed)
    n = {}
    while len(n) < count:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
        n[w] = rnd.choice([2, 3, 20, 30, 200, 300, 2000, 30000])
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:]])
            n[w] = rnd.choice([2, 3, 20, 30, 200])
    return {w: k for w, k in n.items() if len(w) >= 4}


@pytest.mark.parametrize("seed,letters,sizes,group", [(1, "ab", [4, 5, 6, 7], 20_000), (1, "ab", [4, 5, 6, 7], 3), (2, "aàßz", [5, 6, 9], 5),
                                                      (3, "abcdefghij", [7, 8, 12, 30], 20_000), (4, "ÿab", [7, 8], 1)])
def test_against_brute_force(spark, seed, letters, sizes, group):
    n = vocabulary(seed, 250, letters, sizes)
    words = spark.createDataFrame(list(n.items()), "word string, n bigint").selectExpr("*", "1 as near").repartition(3)
    got = spelling.variant_groups(words, group=group).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(n)


def test_a_third_of_all_words_behind_one_head_and_very_long_words(spark):
    rnd = random.Random(8)
    n = {"same" * 4 + "".join(rnd.choice("abc") for _ in range(rnd.choice([5, 6]))): rnd.choice([2, 30, 400]) for _ in range(300)}
    n |= {"".join(rnd.choice("abcdefgh") for _ in range(8)): 2 for _ in range(300)}
    long = "lmno" * 2500
    n |= {long: 50, long[:-1]: 2, "x" + long: 3, long[:5000] + "z" + long[5001:]: 4}
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = spelling.variant_groups(words, group=40).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(n)


def test_acceptor_is_minimal_and_composition_complete():
    rnd = random.Random(6)
    for _ in range(60):
        size = rnd.randint(1, 6)
        words = sorted({"".join(rnd.choice("abc") for _ in range(size - rnd.randint(0, 1))) for _ in range(rnd.randint(1, 60))})
        a = spelling.Acceptor(words)
        rights = {}

        def right(p):
            if p not in rights:
                rights[p] = frozenset(([""] if a.final[p] else []) + [c + s for c, q in a.steps[p].items() for s in right(q)])
            return rights[p]

        assert right(a.start) == set(words)
        assert len(set(map(right, range(len(a.steps))))) == len(a.steps)
        got = [tuple(sorted(p)) for p in a.near(size)]
        want = {tuple(sorted((x, y))) for x in words if len(x) == size for y in words if x != y and one_edit(x, y)}
        assert len(got) == len(set(got)) and set(got) == want


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_words_of_documents(spark, docs, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["Überall", "overall", "OVERALLS", "straßenbahn", "a×bcdefg", "çédille", "word_with_seven", "日本語abcdefg"])
                         for _ in range(30))) for i in range(200)]
    frame = docs.select("doc_id", "text", "n").unionByName(
        spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "4 as n"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    monkeypatch.setattr(spelling, "HELD", 3)
    got = spelling.word_counts(frame)
    assert dict(map(tuple, got.collect())) == counted(rows)
    assert sorted(map(tuple, spelling.variant_groups(got).collect())) == sorted(brute(counted(rows)))
    assert spelling.variant_groups(spelling.word_counts(docs.limit(0))).count() == 0
