import random
from collections import Counter
from fractions import Fraction
from math import ceil

import pytest

from linkloom.llm import mixing


def brute_run(sources, block_rows=8):
    """(source, block, slot, first position, on target) of all blocks of (number, rows, share), slot by slot."""
    share, rows = {i: s for i, _, s in sources}, {i: n for i, n, _ in sources}
    ran, out, first, on_target, alive = dict.fromkeys(rows, 0), [], 0, True, sorted(rows)
    while alive:
        whole, base, t = sum(share[i] for i in alive), dict(ran), 0
        while True:
            ready = [(-(-(ran[i] - base[i] + 1) * whole // share[i]), i) for i in alive if (ran[i] - base[i]) * whole // share[i] <= t]
            i = min(ready)[1]
            if ran[i] * block_rows >= rows[i]:
                break
            out.append((i, ran[i], len(out), first, on_target))
            first += min(block_rows, rows[i] - ran[i] * block_rows)
            ran[i] += 1
            t += 1
        alive = [i for i in alive if ran[i] * block_rows < rows[i]]
        on_target = False
    return out


def test_schedule_against_brute_force(spark):
    rnd = random.Random(1)
    for k in (1, 2, 5, 9):
        sources = [(i, rnd.randint(1, 900), rnd.choice([1 << 52, rnd.randint(1, 1 << 52), rnd.randint(1, 1000), 3])) for i in range(k)]
        plan = spark.createDataFrame(sources, "_i bigint, n bigint, _share bigint")
        got = sorted(map(tuple, mixing.schedule(plan, 3).collect()), key=lambda r: r[2])
        assert got == brute_run(sources, 3)


def test_no_source_leaves_its_exact_weight(spark):
    # One hot source with a third of the rows and 19 equal others, one far below 1/50 of the greatest weight.
    weights = {0: 100_000.0, **{i: 100_000.0 / 3 ** 0.5 for i in range(1, 20)}, 20: 3.0}
    sizes = {0: 20_000, **{i: 12_000 for i in range(1, 20)}, 20: 9}
    w = spark.createDataFrame(list(weights.items()), "source int, weight double")
    share = {r["_s"]["s"]: r["_share"] for r in mixing.shares(w).collect()}
    plan = spark.createDataFrame([(i, sizes[i], share[i]) for i in sizes], "_i bigint, n bigint, _share bigint")
    whole, ran = sum(map(Fraction, weights.values())), Counter()
    run = sorted(mixing.schedule(plan, 8).collect(), key=lambda r: r["slot"])
    on_target = [r for r in run if r["on_target"]]
    assert len(on_target) > 15_000
    for t, r in enumerate(on_target):
        assert r["slot"] == t and r["block"] == ran[r["_i"]]
        ran[r["_i"]] += 1
        if t % 10 == 0:
            assert all(abs(ran[i] - (t + 1) * Fraction(x) / whole) < 1 for i, x in weights.items())


def test_weights_that_are_none(spark):
    w = spark.createDataFrame([("a", 4.0), ("b", float("nan")), ("c", float("inf")), ("d", None), ("e", 0.0), ("f", -1.0), ("g", 1.0),
                               ("g", 1.0), (None, 1.0), ("h", 1e-300)], "source string, weight double")
    got = {r["_s"]["s"]: r["_share"] for r in mixing.shares(w).collect()}
    assert got == {"a": 1 << 52, "g": 1 << 51, None: 1 << 50, "h": 1}
    assert mixing.shares(w.limit(0)).count() == 0


@pytest.mark.parametrize("most_work", [1 << 22, 60])
def test_mix_is_gapless_and_keeps_its_targets(spark, docs, most_work):
    weights = mixing.temperature_weights(docs)
    own = docs.selectExpr("*", "'mine' as block")
    mixed = mixing.mix(own, weights, block_rows=3, most_work=most_work)
    out = mixed.collect()
    assert len(out) == docs.count() and sorted(r["position"] for r in out) == list(range(len(out)))
    order = [r["slot"] for r in sorted(out, key=lambda r: r["position"])]
    assert order == sorted(order) and set(order) == set(range(max(order) + 1))
    sizes, blocks = Counter(r["source"] for r in out), Counter((r["source"], r["block"]) for r in out)
    size = max(3, -(-len(out) * len(sizes) // most_work))
    assert all(n == size or b == ceil(sizes[s] / size) - 1 for (s, b), n in blocks.items())
    share = {r["source"]: r["weight"] for r in weights.collect()}
    whole, ran = sum(share.values()), Counter()
    for t, s in sorted({(r["slot"], r["source"]) for r in out if r["on_target"]}, key=lambda x: x[0]):
        ran[s] += 1
        assert all(abs(ran[x] - (t + 1) * w / whole) < 1 for x, w in share.items())
    assert ran
    assert mixed.drop("block", "slot", "position", "on_target").exceptAll(docs.drop("slot", "position")).count() == 0
    assert mixing.mix(docs.limit(0), mixing.temperature_weights(docs.limit(0))).count() == 0
    some = mixing.mix(docs, spark.createDataFrame([("s0", 1.0)], "source string, weight double"))
    assert some.count() == docs.count()
    assert some.where("source = 's1' and (slot is not null or position is not null or block is not null)").count() == 0
    rest = [r["position"] for r in some.where("source = 's0'").collect()]
    assert sorted(rest) == list(range(len(rest)))
