"""Reduction, components, depth and impact on known topologies and random graphs."""

import random

import pytest

from helpers import Model, graph, rows
from linkloom.operators import iterate as I
from linkloom.operators.graph import graph_from_edges, names
from linkloom.plans.build import build, reduce_graph

TOPOLOGIES = {
    "two_cycle": [("A", "B"), ("B", "A")],
    "self_loop": [("A", "A")],
    "three_cycle": [("A", "B"), ("B", "C"), ("C", "A")],
    "diamond": [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")],
    "two_cycles_and_root": [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("E", "A"), ("E", "C")],
    "ring": [(f"n{i}", f"n{(i + 1) % 10}") for i in range(10)],
    "triangle": [("A", "B"), ("B", "C"), ("A", "C")],
    "overlapping": [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")],
    "figure_eight": [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "E"), ("E", "C")],
    "chain": [("a", "b"), ("b", "c")],
    "two_way_with_exit": [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")],
    "loop_with_exit": [("a", "a"), ("a", "b")],
    "doubled_shortcut": [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c")],
    "loop_in_cycle": [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")],
}
EXPECTED_REDUCED = {
    "triangle": [("A", "B"), ("B", "C")],
    "two_way_with_exit": [("a", "b"), ("b", "a")],
    "loop_with_exit": [("a", "a")],
    "doubled_shortcut": [("a", "b"), ("b", "c")],
}


def random_edges(seed):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(14):02d}", f"v{rng.randrange(14):02d}") for _ in range(rng.choice([12, 18, 30]))]


CASES = {**TOPOLOGIES, **{f"random{i}": random_edges(i) for i in range(12)}}


@pytest.fixture(scope="module")
def everything(spark):
    """All cases as repositories of one graph, built with and without reduction."""
    edges = [(name, a, b) for name, pairs in CASES.items() for a, b in pairs]
    nodes = [(name, "alone") for name in CASES]
    g = graph_from_edges(spark.createDataFrame(edges, "repo string, source string, target string"),
                         spark.createDataFrame(nodes, "repo string, id string"))
    b, whole = build(g), build(g, reduce=None)
    arcs = [r.asDict() for r in b.reduced.arcs.collect()]
    nodes = [r.asDict() for r in b.nodes.collect()]
    heads = whole.comps.join(g.vertices, "vid").join(
        g.vertices.select(g.vertices.vid.alias("comp"), g.vertices.id.alias("head")), "comp").collect()
    return arcs, nodes, [r.asDict() for r in heads]


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases_against_the_model(everything, name):
    arcs, nodes, heads = everything
    edges = CASES[name]
    model = Model(edges, ("alone",))
    kept = model.reduced()
    bag = sorted((r["source"], r["target"]) for r in arcs if r["repo"] == name for _ in range(r["copies"]))
    assert bag == sorted(kept)
    if name in EXPECTED_REDUCED:
        assert bag == sorted(EXPECTED_REDUCED[name])
    here = [r for r in nodes if r["repo"] == name]
    assert {r["id"] for r in here if r["in_cycle"]} == set(model.components(kept))
    depth, impact = model.depth(kept), model.impact(kept)
    assert {r["id"]: (r["depth"], r["impact"], r["in_degree"], r["out_degree"]) for r in here} == {
        n: (depth[n], impact[n], sum(t == n for _, t in kept), sum(s == n for s, _ in kept)) for n in model.nodes}
    assert {r["id"]: r["head"] for r in heads if r["repo"] == name} == model.components(edges)
    alone = next(r for r in here if r["id"] == "alone")
    assert alone["stability"] == 0.5 and not alone["in_cycle"]


def test_cycles_list_self_loops_and_groups(spark):
    b = build(graph(spark, [("x", "x"), ("a", "b"), ("b", "a")]))
    assert rows(b.cycles, "cycle_id", "kind", "member", "size") == [
        ("a", "group", "a", 2), ("a", "group", "b", 2), ("x", "loop", "x", 1)]
    assert b.edges.where("is_cycle").count() == 3


def test_condensed_reduction_keeps_components(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "d")])
    kept = reduce_graph(g, "condensed")[0]
    assert rows(kept.arcs, "source", "target") == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "d")]
    with pytest.raises(ValueError):
        reduce_graph(g, "other")


def test_shortest_paths_both_ways(spark):
    g = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")])
    ids = {r.id: r.vid for r in g.vertices.collect()}
    wanted = spark.createDataFrame([(ids[f], ids[t]) for f, t in [("a", "e"), ("e", "a"), ("a", "x"), ("a", "a")]],
                                   "`from` bigint, `to` bigint")
    back = {v: k for k, v in ids.items()}
    got = sorted((back[r["from"]], back[r["to"]], "".join(back[v] for v in r.path), r.direction)
                 for r in I.shortest_paths(g.pairs, wanted).collect())
    assert got == [("a", "e", "abde", "forward"), ("e", "a", "edba", "reverse")]


def test_topological_layers_with_leftovers(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("p", "q"), ("q", "p"), ("top", "p"), ("top", "a")], nodes=("alone",))
    lay = names(I.topological_layers(g.vertices, g.pairs), g.vertices, vid="id")
    assert rows(lay, "id", "layer") == [("a", 2), ("alone", 0), ("b", 1), ("c", 0), ("p", 3), ("q", 3), ("top", 3)]


def test_forest_marks_first_visit_and_falls_back(spark):
    g = graph(spark, [("a", "c"), ("b", "c"), ("c", "d")])
    b = build(g)
    f = names(I.forest(g.vertices, b.reduced.pairs, b.metrics.select("vid", "impact")), g.vertices, parent="p", child="c")
    assert sorted((r.p or "", r.c, r.dist, r["first"]) for r in f.collect()) == [
        ("", "a", 0, True), ("", "b", 0, True), ("a", "c", 1, True), ("b", "c", 1, False), ("c", "d", 2, True)]
    ring = graph(spark, [("a", "b"), ("b", "a")])
    r = build(ring)
    assert I.forest(ring.vertices, r.reduced.pairs, r.metrics.select("vid", "impact")).where("parent is null").count() == 2


def test_empty_graph(spark):
    b = build(graph(spark, [], nodes=("a", "b")))
    assert rows(b.nodes, "id", "impact", "depth", "risk") == [("a", 0, 0, "entry"), ("b", 0, 0, "entry")]


def test_rounds_do_not_grow_with_the_length_of_a_ring(spark, monkeypatch):
    size, counted = 2000, []
    # Against the order of the numbers; and a vertex between two cycles, which is no member of either.
    arcs = [(i, (i - 1) % size) for i in range(size)] + [(0, 5000), (5000, 6000), (6000, 6001), (6001, 6000)]
    add = I.Rounds.add
    monkeypatch.setattr(I.Rounds, "add", lambda self, *a: counted.append(1) or add(self, *a))
    got = I.components(spark.createDataFrame(arcs, "src bigint, dst bigint")).collect()
    assert {r.vid: r.comp for r in got} == {i: 0 for i in range(size)} | {6000: 6000, 6001: 6000}
    assert len(got) == size + 2 and len(counted) <= 120


def test_mixed_numbers_come_back(spark):
    n = spark.createDataFrame([(0,), (1,), (2 ** 33 + 5,), (2 ** 62 + 9,), (-3,)], "v bigint")
    mixed = n.select("v", I._mixed("v").alias("m"))
    assert all(r.v == r.b for r in mixed.select("v", I._mixed("m", back=True).alias("b")).collect())
