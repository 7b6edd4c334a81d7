from helpers import edges_df, rows
from linkloom.operators import whatif as X


def test_a_merge_looks_for_broken_edges_only_when_asked(spark, monkeypatch):
    calls = []
    found = X._broken
    monkeypatch.setattr(X, "_broken", lambda *a: calls.append(1) or found(*a))
    edges = edges_df(spark, [("a", "b"), ("b", "c"), ("x", "c"), ("c", "y"), ("x", "y"), (None, "a"), ("a", None)]).selectExpr("*", "1L as copies")
    nodes = spark.createDataFrame([("t", n) for n in "abc"], "repo string, id string")
    moved = spark.createDataFrame([("t", "b", "a")], "repo string, id string, merged string")
    change = X.merge(nodes, edges, moved)
    new = X.recount(change.nodes, change.edges)
    assert rows(new.graph.arcs, "source", "target") == [("a", "c")] and not calls
    got = {(r.file, r.missing_dep, r.reason) for r in change.broken.collect()}
    assert got == {("x", "c", "source_removed"), ("c", "y", "target_removed"), ("x", "y", "source_removed"),
                   (None, "a", "source_removed"), ("a", None, "target_removed")}
    nodes2, old = nodes, X.recount(nodes, edges)
    got = X.statistics(nodes2, edges, change, old.cycles, new, "merge").first().asDict()
    assert (got["new_edge_count"], got["broken_import_count"], got["orphaned_count"]) == (1, 5, 1)
