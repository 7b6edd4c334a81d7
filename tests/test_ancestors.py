"""Sets of ancestors, reduction by them, and removal by difference, against plain searches on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from linkloom.operators import iterate as I
from linkloom.operators import whatif as X
from linkloom.operators.graph import graph_from_edges


def reached_from(arcs):
    """Who reaches whom over one arc or more: target -> sources."""
    out = {}
    for s, t in arcs:
        out.setdefault(s, set()).add(t)
    above = {}
    for s in out:
        seen, todo = set(), list(out[s])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out.get(v, ())
        for v in seen:
            above.setdefault(v, set()).add(s)
    return above


def random_dag(rng, size, arcs, step=1):
    order = rng.sample(range(0, size * step, step), size)
    pairs = set()
    while len(pairs) < arcs:
        a, b = sorted(rng.sample(range(size), 2))
        pairs.add((order[a], order[b]))
    return sorted(pairs)


def members(df, column):
    got = {}
    for r in df.where(f"{column} is not null").collect():
        bits = int.from_bytes(bytes(r[column]), "little")
        at = r["bucket"] << I.BUCKET_BITS
        while bits:
            low = bits & -bits
            got.setdefault(r["vid"], set()).add(at + low.bit_length() - 1)
            bits ^= low
    return got


@pytest.mark.parametrize("seed,step", [(1, 1), (2, 5000)])
def test_sets_and_detours_of_acyclic_graphs(spark, seed, step):
    rng = random.Random(seed)
    pairs = random_dag(rng, 40, 90, step)
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    above = I.ancestor_sets(df, I.peel(df).levels)
    want = reached_from(pairs)
    assert members(above.sets, "bits") == want
    far = {}
    for s, t in pairs:
        far.setdefault(t, set()).update(want.get(s, ()))
    assert members(above.sets, "far") == {t: s for t, s in far.items() if s}
    assert sorted(map(tuple, above.bypassed().collect())) == sorted((s, t) for s, t in pairs if s in far[t])


def test_members_of_components_count(spark):
    comps = spark.createDataFrame([(10, 10), (40000, 10), (11, 11), (12, 11)], "vid bigint, comp bigint")
    dag = spark.createDataFrame([(1, 10), (10, 11), (1, 11), (11, 70000)], "src bigint, dst bigint")
    above = I.ancestor_sets(dag, I.peel(dag).levels, comps)
    assert members(above.sets, "bits") == {10: {1}, 11: {1, 10, 40000}, 70000: {1, 10, 40000, 11, 12}}
    assert sorted(map(tuple, above.bypassed().collect())) == [(1, 11)]


def test_graph_without_arcs(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    above = I.ancestor_sets(none, I.peel(none).levels)
    assert above.sets.count() == 0 and above.bypassed().count() == 0


def exact_rule(arcs):
    """Arcs (s, t) for which another direct successor of s reaches t over an arc or more."""
    above, out = reached_from(arcs), {}
    for s, t in arcs:
        out.setdefault(s, set()).add(t)
    return {(s, t) for s, t in arcs if any(w != t and w in above.get(t, ()) for w in out[s])}


def test_reduction_of_many_random_graphs(spark):
    """200 graphs, acyclic and not, as repositories of two graphs."""
    from linkloom.plans.build import reduce_graph
    rng = random.Random(5)
    for cyclic in (False, True):
        graphs = {}
        for k in range(100):
            size = rng.randint(3, 9)
            graphs[f"g{k}"] = set(random_dag(rng, size, rng.randint(1, size * (size - 1) // 2))) if not cyclic else {
                (rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(1, 14))}
        edges = [(r, f"v{a}", f"v{b}") for r, arcs in graphs.items() for a, b in arcs]
        g = graph_from_edges(spark.createDataFrame(edges, "repo string, source string, target string"))
        kept = {(r.repo, r.source, r.target) for r in reduce_graph(g)[0].arcs.collect()}
        want = {(r, f"v{a}", f"v{b}") for r, arcs in graphs.items() for a, b in arcs - exact_rule(arcs)}
        assert kept == want


@pytest.mark.parametrize("seed,arcs,share", [(1, 60, 0.1), (3, 45, 0.3)])
def test_removal_by_difference_is_a_full_recount(spark, seed, arcs, share):
    rng = random.Random(seed)
    edges = [("r", f"v{rng.randrange(40):02d}", f"v{rng.randrange(40):02d}") for _ in range(arcs)]
    df = spark.createDataFrame(edges, "repo string, source string, target string")
    g = graph_from_edges(df, spark.createDataFrame([("r", "alone")], "repo string, id string"))
    bag = g.arcs.select("repo", "source", "target", "copies")
    gone = spark.createDataFrame([("r", f"v{i:02d}") for i in range(40) if rng.random() < share] + [("r", "unknown")], "repo string, id string")
    cut = spark.createDataFrame(rng.sample(edges, 3), df.schema)
    old = X.recount(g.vertices, bag)
    for nodes, arcs_ in ((gone, cut),) if seed == 1 else ((None, cut),):
        change = X.remove(g.vertices, bag, nodes, arcs_)
        whole, part = X.recount(change.nodes, change.edges), X.recount_removal(old, nodes, arcs_)
        for table in ("impacts", "cycles"):
            a, b = getattr(whole, table), getattr(part, table)
            assert rows(a, *a.columns) == rows(b, *a.columns)
        assert rows(whole.graph.arcs, "source", "target", "copies") == rows(part.graph.arcs, "source", "target", "copies")


def test_removal_counts_only_what_is_below(spark, monkeypatch):
    """Of 3,000 vertices in chains, one in a hundred is below what goes."""
    edges = [("r", f"c{k:03d}/{i}", f"c{k:03d}/{i + 1}") for k in range(300) for i in range(9)]
    g = graph_from_edges(spark.createDataFrame(edges, "repo string, source string, target string"))
    old = X.recount(g.vertices, g.arcs.select("repo", "source", "target", "copies"))
    seen, sets = [], I.ancestor_sets
    monkeypatch.setattr("linkloom.plans.build.ancestor_sets", lambda dag, *a: seen.append(dag.count()) or sets(dag, *a))
    new = X.recount_removal(old, spark.createDataFrame([("r", f"c{k:03d}/0") for k in range(3)], "repo string, id string"))
    assert seen == [24]
    changed = X.impact_changes(old.impacts, new.impacts)
    assert changed.count() == 27 and changed.where("delta <> -1").count() == 0


def longest(pairs):
    """Longest chain below each source that reaches no cycle, by peeling."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    level = {b: 0 for _, b in pairs if b not in out}
    while True:
        more = {v: 1 + max(level[w] for w in out[v]) for v in out if v not in level and all(w in level for w in out[v])}
        if not more:
            return {v: x for v, x in level.items() if v in out}
        level |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_by_contraction(spark, seed):
    rng = random.Random(seed)
    pairs = set(random_dag(rng, 60, rng.choice([50, 80, 140])))
    pairs |= {(1000 + i, 1001 + i) for i in range(50)} | {(1020, 5), (5, 1040), (7, 1000)} if seed % 2 else set()
    if seed % 4 > 1:  # cycles, of single targets and of several, and what leads to them
        pairs |= {(200, 201), (201, 200), (202, 200), (203, 202), (203, 3), (210, 211), (211, 212), (212, 210), (211, 210), (212, 1), (4, 210), (220, 220)}
    df = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    want = longest(pairs)
    for quick in (0, 3):
        got = I.peel(df, quick)
        assert dict(map(tuple, got.levels.collect())) == want
        stuck = {a for a, _ in pairs if a not in want}
        assert sorted(map(tuple, got.leftover.collect())) == sorted((a, b) for a, b in pairs if a in stuck and b in stuck)
        assert got.acyclic == (not stuck)


def test_a_chain_of_100000_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    df = spark.range(n).selectExpr("(id * 7919) % 100000 as src", "((id + 1) * 7919) % 100000 as dst").where(f"src <> {(n - 1) * 7919 % n}")
    writes, add = [], I.Rounds.add
    monkeypatch.setattr(I.Rounds, "add", lambda self, *a: writes.append(1) or add(self, *a))
    got = I.peel(df)
    top = got.levels.agg(F.max("level"), F.count("vid")).first()
    assert got.acyclic and tuple(top) == (n - 1, n - 1) and len(writes) <= 40
