import random
import re
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import phrases


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:j] for q, b in often.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                  if j - i < len(q) and 100 * b >= 100 * c[q[i:j]]}
        mine = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), lang, a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(m[3], i + 1, m[2].decode(), *m[4:]) for i, m in enumerate(sorted(mine)[:top])]
    return sorted(out)


def corpus():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "THE", "the", "x\x1cy", " ", "z z", "日本"]
    sets = [rnd.choices(vocabulary, k=rnd.randint(2, 7)) for _ in range(12)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rnd.randint(0, 30)):
            words += rnd.choice(sets) if rnd.random() < 0.5 else [rnd.choice(vocabulary)]
            words += rnd.choice([[], [], [], [","], ["."], ["\n"], ["\x0b"]])
        rows.append((rnd.choice([" ", "  ", "\t", " \t "]).join(words), rnd.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", "fr"), (" \n.", "fr"), ("same words here. " * 500, "en"), ("a " * 3000, "und"), *rows[:20]]


@pytest.mark.parametrize("least,longest,top,size", [(8, 5, 2000, 3_000_000), (3, 5, 40, 500), (20, 3, 2000, 40), (8, 2, 5, 500)])
def test_against_brute_force(spark, monkeypatch, least, longest, top, size):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as a", "2 as n", "'x' as phrase").repartition(3)
    monkeypatch.setattr(phrases, "SHARD_WORDS", size)
    if size < 1000:  # heads beyond HEAVY, and batches of few rows
        monkeypatch.setattr(phrases, "HEAVY", 50)
        monkeypatch.setattr(phrases, "SALTS", 3)
        monkeypatch.setattr(phrases, "BATCH", 7)
    got = phrases.collocations(docs, least=least, longest=longest, top=top)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top)


def test_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 10)
    text = "One two three. four five\tsix seven eight nine ten eleven twelve; a b"
    got = [w for part in phrases._slices(text.encode()) for w in part]
    assert [w for w in got if w != b"\xff"] == text.lower().replace(".", "").replace(";", "").encode().split()
    assert got.count(b"\xff") == 2


def test_index_counts_all_phrases_and_keeps_both_directions_in_step():
    rnd = random.Random(4)
    for _ in range(30):
        ids = np.array([rnd.randint(0, 6) for _ in range(rnd.randint(1, 200))] + [0], np.int32)
        index = phrases.PhraseIndex(ids, 5)
        for columns, n in index.phrases():
            k = len(columns)
            want = Counter(tuple(ids[i:i + k].tolist()) for i in range(len(ids) - k + 1) if (ids[i:i + k] > 0).all())
            got = list(zip(*[c.tolist() for c in columns]))
            assert len(got) == len(set(got)) and dict(zip(got, n.tolist())) == want


def test_filter_has_all_places(spark):
    rows = [("en", f"w{i} x{i * 7}") for i in range(3000)]
    bits = phrases.frequent_filter(spark.createDataFrame(rows, "lang string, phrase string"))
    hashes = [phrases._word_hashes("en", p.encode().split()) for _, p in rows]
    both = phrases._followed(np.array([h[0] for h in hashes]), np.array([h[1] for h in hashes]))
    assert phrases._set_at(bits, both).all() and 2990 < int(np.unpackbits(bits).sum()) <= 3000


def test_exact_arithmetic_past_64_bits(spark):
    n, a, l, r = 10**13, 10**11, 3 * 10**11, 7 * 10**10
    row = spark.range(1).selectExpr(f"{a}L a", f"{n}L n", f"{l}L l", f"{r}L r").selectExpr(
        "(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s")
    assert row.first()["s"] == 1000 * a * n // (l * r)


def test_packed_rows_hold_all_phrases(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(phrases, "BATCH", 7)
    rnd = random.Random(9)
    names = pa.array(["", *(f"w{i}" for i in range(1, 13))])
    heavy, salts = np.arange(13) % 3 == 0, np.arange(13) % 5
    for k in (1, 2, 3):
        want = {tuple(rnd.randint(1, 12) for _ in range(k)): rnd.randint(1, 99) for _ in range(200)}
        columns = [np.array([p[j] for p in want]) for j in range(k)]
        got, heads = {}, set()
        for b in phrases._packed("en", names, columns, np.array(list(want.values())), heavy, salts):
            for r in b.to_pylist():
                assert (r["head"], r["salt"]) not in heads
                heads.add((r["head"], r["salt"]))
                for t, n in zip(r["tails"].split(" "), r["n"].split(" ")):
                    got[f"{r['head']} {t}".strip()] = int(n)
                    hot = all(heavy[int(w[1:])] for w in r["head"].split())
                    assert r["salt"] == (salts[int(t[1:])] if hot else 0)
        assert got == {" ".join(f"w{i}" for i in p): n for p, n in want.items()}


def test_index_of_a_shard_stays_small():
    """Arrays of an index hold 32 bits a word; only the keys of a sort take more, one at a time."""
    import tracemalloc

    import numpy as np

    from linkloom.llm.phrases import PhraseIndex
    ids = np.random.default_rng(5).integers(0, 400, 300_000).astype(np.int32)
    ids[-1] = 0
    tracemalloc.start()
    index = PhraseIndex(ids, 2)
    total = {len(columns): int(n.sum()) for columns, n in index.phrases()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == {1: int((ids > 0).sum()), 2: int(((ids[:-1] > 0) & (ids[1:] > 0)).sum())}
    assert peak < 55 * len(ids), peak / len(ids)
