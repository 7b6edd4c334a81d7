"""Functions, skewed joins, sources and exports on small inputs."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from helpers import edges_df, graph, rows
from linkloom import store
from linkloom.functions import paths, scalars
from linkloom.operators import compare, whatif
from linkloom.operators.churn import churn
from linkloom.operators.metrics import coupling, depth_warnings
from linkloom.operators.ranking import number_rows, top_per_group
from linkloom.plans.build import build, display
from linkloom.sources import exports, snapshots
from linkloom.sources.archives import archive_files, strip_wrapper
from linkloom.sources.commits import read_commit_log
from linkloom.streaming.sessions import bursts, sliding_counts, sliding_limit


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [k / 2000 * 100 for k in range(400)] + [k / 16 for k in range(100)] + [rng.random() * 100 for _ in range(500)] \
        + [0.0625, 2.675, 1.005, 0.05, 0.15, 0.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = df.select("x", scalars.round_half_even(F.col("x"), digits).alias("r")).collect()
        assert all(r.r == round(r.x, digits) for r in got)


def test_paths(spark):
    import os.path
    given = ["a/b.c", "b.c", "a/.b", "a/..b", "a/b.tar.gz", ".x.y", "a/./b", "a/../b", "../a", "a/../../b", "a//b/", "", "/a/../b", "a/b"]
    got = spark.createDataFrame([(g,) for g in given], "p string").select(
        "p", paths.extension("p").alias("e"), paths.normalize("p").alias("n"), paths.dirname("p").alias("d")).collect()
    for r in got:
        assert r.e == os.path.splitext(r.p)[1], r.p
        assert r.n == os.path.normpath(r.p), r.p
        if not r.p.startswith("/"):
            assert r.d == os.path.dirname(r.p), r.p


def test_directory_colour_is_md5_modulo_20(spark):
    import hashlib
    ids = [f"d{i}/x" for i in range(50)] + ["root"]
    for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", paths.dir_color("id").alias("c")).collect():
        folder = r.id.rsplit("/", 1)[0] if "/" in r.id else "."
        assert r.c == paths.PALETTE[int(hashlib.md5(folder.encode()).hexdigest(), 16) % 20]


def test_hot_keys_are_salted_without_changing_the_result(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT_ROWS", 50)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 2)
    big = store.materialize(spark.range(1000).select((F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 100)).alias("k"), "id"), "t")
    small = spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = store.hot_keys(big, ["k"])
    assert hot is not None and hot.count == 1
    spread = hot.salted(big).where("k = 0").groupBy("_salt").count().collect()
    assert len(spread) == 9
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, store.attach(big, small, ["k"], how).collect())) == \
            sorted(map(str, big.join(small, ["k"], how).collect()))


def test_build_with_salted_loops(spark, monkeypatch):
    edges = [(f"s{i:02d}", "hub") for i in range(30)] + [("hub", "x"), ("x", "y"), ("y", "x"), ("s00", "x")]
    plain = build(graph(spark, edges))
    want = rows(plain.nodes, "id", "in_degree", "depth", "impact", "in_cycle", "reach_pct", "risk")
    monkeypatch.setattr(store, "HOT_ROWS", 5)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    assert rows(build(graph(spark, edges)).nodes, "id", "in_degree", "depth", "impact", "in_cycle", "reach_pct", "risk") == want


def test_row_numbers_inside_a_hot_group(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), F.format_string("%05d", (F.col("id") * 37) % 500).alias("o"))
    got = number_rows(df.unionByName(df.limit(3).withColumn("g", F.lit("h"))), ["g"], ["o"], "n")
    assert [r.n for r in got.where("g = 'g'").orderBy("o").collect()] == list(range(1, 501))
    assert got.where("g = 'h'").count() == 3
    many = df.withColumn("g", F.substring("o", 5, 1))
    assert "WindowGroupLimit" in top_per_group(many, ["g"], [F.asc("o")], 3)._jdf.queryExecution().toString()


def test_filters_follow_the_kept_nodes(spark):
    b = build(graph(spark, [("a/x", "b/y"), ("b/y", "c/z"), ("a/w", "b/y")], nodes=("q",)))
    assert rows(display(b, hide_isolated=True).nodes, "id") == [("a/w",), ("a/x",), ("b/y",), ("c/z",)]
    d = display(b, filter_dir="b")
    assert rows(d.nodes, "id", "reach_pct") == [("b/y", 200.0)] and d.edges.count() == 0
    assert rows(coupling(b.reduced.arcs), "dir1", "dir2", "cross_edges", "score") == [("a", "b", 2, 0.4), ("b", "c", 1, 0.25)]


def test_depth_warnings(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    w = {r.file: r for r in depth_warnings(build(graph(spark, chain)).nodes).collect()}
    assert w["n0"].severity == "critical" and w["n0"].reasons == ["dependency chain 9 levels deep"]
    assert w["n3"].severity == "warning" and w["n3"].reasons == ["pulls in 30.0% of codebase", "dependency chain 6 levels deep"]
    assert w["n9"].severity == "critical" and w["n9"].reasons == ["pulls in 90.0% of codebase"]


def test_diff_of_a_graph_with_itself(spark):
    g = graph(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    nodes, edges = g.vertices.select("repo", "id"), g.arcs.select("repo", "source", "target", "copies")
    assert {r.diff for r in compare.diff_nodes(nodes, nodes).collect()} == {"unchanged"}
    assert rows(compare.diff_edges(edges, edges), "source", "target", "copies", "diff") == [
        ("a", "b", 2, "unchanged"), ("b", "c", 1, "unchanged")]
    text = [r.line for r in exports.diff_markdown(
        compare.diff_nodes(nodes, nodes), compare.diff_edges(edges, edges),
        spark.createDataFrame([], "repo string, cycle_id string, member string")).orderBy("section", "ord").collect()]
    assert text == ["## Dependency Diff", "", "No dependency changes detected."]


def test_merge_and_split(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "c"), ("x.py", "c"), ("a", "x.py")])
    nodes, edges = g.vertices.select("repo", "id"), g.arcs.select("repo", "source", "target", "copies")
    final = whatif.merge_targets(nodes, [("t", ["a", "b"], "b"), ("t", ["b", "c"], "c"), ("t", ["c"], None), ("t", ["a", "x.py"], None)])
    assert final == {("t", "a"): "c", ("t", "b"): "c"}
    moved = spark.createDataFrame([(r, i, m) for (r, i), m in final.items()], "repo string, id string, merged string")
    c = whatif.merge(nodes, edges, moved)
    assert rows(c.edges, "source", "target") == [("c", "c"), ("c", "x.py"), ("x.py", "c")] and c.broken.count() == 0
    parts, part_edges = whatif.propose_split(edges, spark.createDataFrame([("t", "x.py")], "repo string, id string"))
    s = whatif.split(nodes, edges, parts, part_edges)
    assert rows(s.edges, "source", "target") == [("a", "b"), ("a", "x_a.py"), ("b", "c"), ("c", "c"), ("x_a.py", "c")]
    assert rows(s.nodes, "id") == [("a",), ("b",), ("c",), ("x_a.py",), ("x_b.py",)]


def test_removal_reports_cycles_and_orphans(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("r", "a"), ("r", "s")])
    nodes, edges = g.vertices.select("repo", "id"), g.arcs.select("repo", "source", "target", "copies")
    c = whatif.remove(nodes, edges, spark.createDataFrame([("t", "r")], "repo string, id string"),
                      spark.createDataFrame([("t", "b", "a")], "repo string, source string, target string"))
    assert rows(c.broken, "file", "missing_dep", "reason") == [("b", "a", "edge_removed")]
    assert rows(whatif.newly_orphaned(edges, c), "id") == [("a",), ("s",)]
    old, new = whatif.recount(nodes, edges), whatif.recount(c.nodes, c.edges)
    assert rows(compare.only_in(old.cycles, new.cycles), "cycle_id", "size") == [("a", 2)]
    assert rows(whatif.impact_changes(old.impacts, new.impacts), "file", "delta") == [("a", -2), ("b", -1), ("s", -1)]


def test_commit_log_and_churn(spark, tmp_path):
    log = ("__COMMIT__h1|Ann|2024-03-01T10:00:00+02:00\n\na.py\nb.py\n__COMMIT__h2|Bob|not-a-date\n\na.py\n"
           "__COMMIT__h3|Bob\nx.py\n__COMMIT__h4|Bob|2024-01-01T00:00:00+00:00\n\n a.py \n")
    (tmp_path / "proj.log").write_text(log)
    touches = read_commit_log(spark, str(tmp_path / "proj.log"))
    assert sorted((r.repo, r.path, r.author, r.ts.isoformat()) for r in touches.collect()) == [
        ("proj", "a.py", "Ann", "2024-03-01T08:00:00"), ("proj", "a.py", "Bob", "2024-01-01T00:00:00"),
        ("proj", "b.py", "Ann", "2024-03-01T08:00:00")]
    got = churn(touches, "2024-03-02 00:00:00", days=365, recent_days=7)
    assert rows(got, "path", "commits", "recent", "authors", "last_date", "churn_score") == [
        ("a.py", 2, 1, 2, "2024-03-01", 1.0), ("b.py", 1, 1, 1, "2024-03-01", 0.725)]


def test_archives(spark):
    def pack(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in entries:
                z.writestr(name, text)
        return bytearray(out.getvalue())

    link = zipfile.ZipInfo("p/link")
    link.external_attr = 0o120777 << 16
    df = spark.createDataFrame([("ok", pack([("p/", ""), ("p/a.py", "x"), ("p/.h", ""), ("p/q/b.py", "é")])),
                                ("slip", pack([("a.py", ""), ("q/../../e", "")])), ("root", pack([("/etc/x", "")])),
                                ("link", pack([(link, "t")]))], "repo string, content binary")
    files, bad = archive_files(df)
    assert rows(strip_wrapper(files), "repo", "path", "content") == [("ok", "a.py", "x"), ("ok", "q/b.py", "é")]
    assert rows(bad, "repo") == [("link",), ("root",), ("slip",)]


def test_snapshot_and_text_files(spark, tmp_path):
    b = build(graph(spark, [("d/a", "d/b"), ("d/b", "d/a"), ("e/c", "d/a")]))
    snapshots.write(b.nodes, b.edges, str(tmp_path / "snap"))
    assert rows(snapshots.edges_of(snapshots.read(spark, str(tmp_path / "snap"))), "source", "target", "is_cycle") == \
        rows(b.edges, "source", "target", "is_cycle")
    exports.write_text(exports.dot(b.nodes, b.edges), str(tmp_path / "dot"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()]
    assert '  "d/a" -> "d/b" [color="#ef4444", penwidth=2, style=bold];' in lines and lines[0].startswith("digraph")
    mermaid = [r.line for r in exports.mermaid(b.nodes, b.edges, "directory").collect()]
    assert "  d_a -.->|cycle| d_b" in mermaid and "  class d_a cycleNode" in mermaid
    (tmp_path / "g.json").write_text('{"nodes": [{"data": {"id": "x", "depth": 1}}], "edges": [{"data": {"source": "x", "target": "y",'
                                     ' "weight": 1.5}, "classes": "cycle"}]}')
    nodes, edges = snapshots.read_documents(spark, str(tmp_path / "g.json"))
    assert rows(nodes, "repo", "id", "depth") == [("g", "x", 1)]
    assert rows(edges, "source", "target", "copies", "is_cycle", "weight") == [("x", "y", 1, True, 1.5)]


def test_sessions_across_bucket_borders(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 4000) for _ in range(300))
    df = store.materialize(spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "k string, event_id long, s long")
                           .withColumn("ts", F.timestamp_seconds("s")), "t")
    from linkloom.streaming.sessions import with_sessions
    got = [r.session for r in with_sessions(df, "k", "ts", 20, bucket_seconds=60).orderBy("s", "event_id").collect()]
    want, n = [], 0
    for i, t in enumerate(times):
        n += i == 0 or t - times[i - 1] >= 20
        want.append(n)
    assert got == want
    assert bursts(df, "k", "ts", 20).count() == n
    held, verdicts = [], []
    for t in times:
        held = [h for h in held if t - h < 30]
        verdicts.append(len(held) < 2)
        if verdicts[-1]:
            held.append(t)
    assert [r.accepted for r in sliding_limit(df, "k", "ts", "event_id", 2, 30).orderBy("event_id").collect()] == verdicts
    counts = [sum(1 for u in times if t - 30 < u <= t) for t in times]
    assert [r.in_window for r in sliding_counts(df, "k", "ts", 30).orderBy("event_id").collect()] == counts
    assert edges_df(spark, []).count() == 0
