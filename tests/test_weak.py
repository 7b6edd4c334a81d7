import random

import pytest
from pyspark.sql import functions as F

from linkloom import store
from linkloom.operators import iterate as I
from linkloom.operators import weak, whatif
from linkloom.plans import build as B
from helpers import Model, graph, rows


def tangled(rnd, repo, n, m):
    return [(f"{repo}{rnd.randrange(n):02d}", f"{repo}{rnd.randrange(n):02d}") for _ in range(m)]


@pytest.mark.parametrize("most", [1000, 14])
def test_pieces_give_what_the_model_gives(spark, monkeypatch, most):
    rnd = random.Random(most)
    edges = [e for k, (n, m) in enumerate([(9, 12), (6, 14), (3, 1), (8, 30), (2, 9)]) for e in tangled(rnd, f"k{k}/", n, m)]
    edges = sorted({*edges, ("self/1", "self/1")})
    monkeypatch.setattr(B, "MOST_ROUNDS", 0)
    monkeypatch.setattr(weak, "PIECE_ARCS", most)
    g, model = graph(spark, edges), Model(edges)
    assert isinstance(B.find_components(g.pairs)[0], B.Pieces)
    b, kept = B.build(g), model.reduced()
    assert rows(b.edges, "source", "target") == sorted(kept)
    nodes = b.nodes.collect()
    assert {r.id: r.impact for r in nodes} == model.impact(kept) and {r.id: r.depth for r in nodes} == model.depth(kept)
    assert {r.id for r in nodes if r.in_cycle} == set(model.components(kept))
    lost = {n for n in model.nodes if n.endswith("1")}
    new = whatif.recount_removal(whatif.recount(g.vertices, g.arcs), spark.createDataFrame([("t", n) for n in lost], "repo string, id string"))
    left = [e for e in edges if not lost & set(e)]
    assert {r.id: r.impact for r in new.impacts.collect()} == {n: i for n, i in model.impact(left).items() if n not in lost}


def test_deep_pieces_take_few_rounds(spark, monkeypatch):
    """Forty triangles in a row, in each of three parts: the loops took a round for each of them, over and over."""
    edges = []
    for part in "abc":
        at = [f"{part}/{i:03d}" for i in range(120)]
        edges += [(at[i], at[i + 1]) for i in range(119)] + [(at[i + 2], at[i]) for i in range(0, 120, 3)]
        edges += [(f"{part}/t{i:03d}", f"{part}/t{i + 1:03d}") for i in range(40)] + [(f"{part}/t040", at[0]), (at[119], f"{part}/u000")]
        edges += [(f"{part}/u{i:03d}", f"{part}/u{i + 1:03d}") for i in range(40)]
    seen, write = [], store._write
    monkeypatch.setattr(store, "_write", lambda df, path, also: seen.append(path) or write(df, path, also))
    g = graph(spark, edges)
    b = B.build(g, None)
    assert len(seen) < 70
    assert b.nodes.agg(F.max("depth")).first()[0] == 41 + 39 + 41
    assert b.nodes.where("id = 'a/u040'").first()["impact"] == 41 + 120 + 40


def test_a_loop_says_that_a_graph_is_deep(spark):


    arcs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 29)], "src bigint, dst bigint")
    with pytest.raises(I.TooDeep):
        I.components(arcs, most_rounds=5)
    assert rows(I.components(arcs), "vid", "comp") == [(29, 29), (30, 29)]


def test_strong_components_come_after_what_they_lead_to():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 9)
        out = [[rnd.randrange(n) for _ in range(rnd.choice([0, 1, 1, 2]))] for _ in range(n)]
        reach = Model([(str(v), str(w)) for v in range(n) for w in out[v]], map(str, range(n)))
        comp = reach.components(reach.edges)
        got = weak.strong_components(out)
        assert sorted(v for g in got for v in g) == list(range(n))
        place = {v: i for i, g in enumerate(got) for v in g}
        assert all((place[v] == place[w]) == (comp.get(str(v), str(v)) == comp.get(str(w), str(w))) for v in range(n) for w in range(n))
        assert all(place[w] <= place[v] for v in range(n) for w in out[v])
