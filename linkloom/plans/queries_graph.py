"""Queries over the graph itself: reduction, cycles, closure, searches, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import iterate as I
from linkloom.operators import metrics as M
from linkloom.operators.graph import names
from linkloom.operators.whatif import unreachable
from linkloom.plans import oracle as O
from linkloom.plans import views as V
from linkloom.plans.build import find_components, reduce_graph
from linkloom.plans.catalog import query
from linkloom.store import attach

NODE_COLUMNS = ["id", "in_degree", "out_degree", "depth", "impact", "in_cycle", "dir", "stability", "size",
                "reach_pct", "risk"]

for _view, _ids in (("fk", "A1 A2 A3 A4 A5 A6 G4 G5 F1 F9 F11"), ("turns", "G4 G5 A5"), ("flow", "G3 G4 G5 A1 A2 A3")):
    @query(f"nodes_{_view}", _ids, O.sql(O.metrics(_view), f"SELECT {', '.join(NODE_COLUMNS)} FROM nodes"))
    def _nodes(spark, sf, view=_view):
        return V.build_of(spark, sf, view).nodes.select(*NODE_COLUMNS)

    @query(f"edges_{_view}", "F10 J9 G3", O.sql(O.metrics(_view), "SELECT source, target, copies, is_cycle, weight FROM w"))
    def _edges(spark, sf, view=_view):
        return V.build_of(spark, sf, view).edges.select("source", "target", "copies", "is_cycle", "weight")

    @query(f"reduction_exact_{_view}", "G1",
           O.sql(O.reduced(_view), "SELECT source, target, count(*)::BIGINT AS copies FROM r GROUP BY 1, 2"))
    def _reduced(spark, sf, view=_view):
        return V.build_of(spark, sf, view).reduced.arcs.select("source", "target", "copies")

    @query(f"removed_by_reduction_{_view}", "G1", O.sql(O.reduced(_view), "SELECT source, target FROM red"))
    def _removed(spark, sf, view=_view):
        b = V.build_of(spark, sf, view)
        return b.graph.arcs.join(b.reduced.arcs.select("src", "dst"), ["src", "dst"], "left_anti") \
            .select("source", "target")

    @query(f"unused_{_view}", "A6", O.sql(O.metrics(_view), "SELECT id FROM m WHERE in_degree = 0"))
    def _unused(spark, sf, view=_view):
        return V.build_of(spark, sf, view).unused.select("id")

    @query(f"closure_{_view}", "G0", O.sql(O.view(_view) + "," + O.closure_of("e", "tc"), "SELECT a, b FROM tc"))
    def _closure(spark, sf, view=_view):
        g = V.graph_of(spark, sf, view)
        return names(I.closure(g.pairs).reach.drop("dist"), g.vertices, a="from_id", b="to_id") \
            .select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))


_WALK = """,
walk(a, b, k) AS (SELECT DISTINCT source, target, 1 FROM e
  UNION SELECT walk.a, e.target, k + 1 FROM walk JOIN e ON walk.b = e.source)"""


@query("closure_distances_turns", "G0", O.sql(O.view("turns") + _WALK,
       "SELECT a, b, min(k)::BIGINT AS dist FROM walk GROUP BY 1, 2"))
def closure_distances(spark, sf):
    g = V.graph_of(spark, sf, "turns")
    return names(I.closure(g.pairs).reach, g.vertices, a="x", b="y") \
        .select(F.col("x").alias("a"), F.col("y").alias("b"), "dist")


_FLOW_RAW = O.view("flow") + ", d AS MATERIALIZED (SELECT DISTINCT source, target FROM e)," \
    + O.closure_of("d", "tc") + "," + O.components_of("tc", "scc")


@query("components_flow", "G2", O.sql(_FLOW_RAW, """
SELECT id, comp, count(*) OVER (PARTITION BY comp) AS size FROM scc"""))
def components_flow(spark, sf):
    b = V.build_of(spark, sf, "flow", None)
    sizes = b.comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return names(b.comps.join(sizes, "comp"), b.graph.vertices, vid="id", comp="head") \
        .select("id", F.col("head").alias("comp"), "size")


@query("components_trade", "G2", """
WITH RECURSIVE s AS MATERIALIZED (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
near AS MATERIALIZED (SELECT DISTINCT x.s AS a, y.s AS b FROM s x JOIN s y ON x.p = y.p),
tc(a, b) AS (SELECT a, b FROM near UNION SELECT tc.a, near.b FROM tc JOIN near ON tc.b = near.a),
m AS MATERIALIZED (SELECT DISTINCT 'supplier/' || a AS id, b FROM tc
                   UNION SELECT DISTINCT 'part/' || s.p, tc.b FROM s JOIN tc ON tc.a = s.s),
low AS (SELECT b, min(id) AS comp FROM m GROUP BY b)
SELECT id, min(comp) AS comp, count(*) OVER (PARTITION BY min(comp)) AS size FROM m JOIN low USING (b) GROUP BY id""")
def components_trade(spark, sf):
    """Nearly all parts and suppliers are one component."""
    g = V.graph_of(spark, sf, "trade")
    comps = V.stored(spark, sf, "components", "trade", make=lambda: find_components(g.pairs)[1])
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return names(attach(comps, sizes, ["comp"], "inner"), g.vertices, vid="id", comp="head") \
        .select("id", F.col("head").alias("comp"), "size")


_CONDENSED = _FLOW_RAW + """,
ce AS MATERIALIZED (
  SELECT source, target, coalesce(a.comp, source) AS cs, coalesce(b.comp, target) AS ct FROM d
  LEFT JOIN scc a ON a.id = source LEFT JOIN scc b ON b.id = target),
cond AS MATERIALIZED (SELECT DISTINCT cs AS source, ct AS target FROM ce WHERE cs <> ct)"""


@query("condensation_flow", "G14", O.sql(_CONDENSED, "SELECT source, target FROM cond"))
def condensation_flow(spark, sf):
    b = V.build_of(spark, sf, "flow", None)
    return names(I.condense(b.graph.pairs, b.comps), b.graph.vertices, src="source", dst="target") \
        .select("source", "target")


@query("reduction_condensed_flow", "G15", O.sql(_CONDENSED + "," + O.closure_of("cond", "ctc") + """,
cred AS (SELECT DISTINCT x.source, x.target FROM cond x JOIN cond y ON x.source = y.source AND x.target <> y.target
         JOIN ctc ON ctc.a = y.target AND ctc.b = x.target)""", """
SELECT ce.source, ce.target FROM ce ANTI JOIN cred ON ce.cs = cred.source AND ce.ct = cred.target"""))
def reduction_condensed_flow(spark, sf):
    kept = V.remembered(spark, sf, "condensed", "flow",
                        make=lambda: reduce_graph(V.graph_of(spark, sf, "flow"), "condensed")[0])
    return kept.arcs.select("source", "target")


@query("cycles_flow", "G3 A29", O.sql(O.metrics("flow"), "SELECT cycle_id, kind, member, size::BIGINT AS size FROM cyc"))
def cycles_flow(spark, sf):
    return V.build_of(spark, sf, "flow").cycles.select("cycle_id", "kind", "member", "size")


@query("cycles_unreduced_flow", "G3 A29", O.sql(O.metrics("flow", "e"),
       "SELECT cycle_id, kind, member, size::BIGINT AS size FROM cyc"))
def cycles_unreduced_flow(spark, sf):
    return V.build_of(spark, sf, "flow", None).cycles.select("cycle_id", "kind", "member", "size")


@query("nodes_unreduced_flow", "G3 G4 G5", O.sql(O.metrics("flow", "e"), f"SELECT {', '.join(NODE_COLUMNS)} FROM nodes"))
def nodes_unreduced_flow(spark, sf):
    return V.build_of(spark, sf, "flow", None).nodes.select(*NODE_COLUMNS)


for _view in ("fk", "flow"):
    @query(f"has_cycles_{_view}", "G3", O.sql(O.metrics(_view), """
SELECT count(*) FILTER (is_cycle) > 0 AS has_cycles, (SELECT count(DISTINCT (cycle_id, kind)) FROM cyc)::BIGINT AS cycles FROM w"""))
    def _has_cycles(spark, sf, view=_view):
        b = V.build_of(spark, sf, view)
        loops = b.cycles.select(F.countDistinct("cycle_id", "kind").alias("cycles"))
        flags = b.links.select(F.coalesce(F.bool_or("is_cycle"), F.lit(False)).alias("has_cycles"))
        return flags.withColumn("cycles", loops.scalar())


# --- searches ------------------------------------------------------------------------------

_BLAST = """,
walk(seed, id, k) AS (SELECT DISTINCT target, source, 1 FROM e WHERE {seed}
  UNION SELECT walk.seed, e.source, k + 1 FROM walk JOIN e ON walk.id = e.target),
blast AS MATERIALIZED (SELECT seed, id, min(k)::BIGINT AS dist FROM walk WHERE id <> seed GROUP BY 1, 2)"""


def _seeds(spark, sf, view: str, condition: str) -> DataFrame:
    return V.graph_of(spark, sf, view).vertices.where(condition).select(F.col("vid").alias("seed"))


def _search(spark, sf, view: str, condition: str, reverse: bool) -> DataFrame:
    """Dependents (reverse) or dependencies of every vertex that meets a condition, by id."""
    def make():
        g = V.graph_of(spark, sf, view)
        found = I.reach_from(g.pairs, _seeds(spark, sf, view, condition), reverse=reverse)
        return names(found, g.vertices, seed="seed_id", vid="id", parent="parent_id")
    return V.stored(spark, sf, "search", view, condition, reverse, make=make)


for _view, _where in (("fk", "{c} LIKE 'region/%'"), ("turns", "{c} LIKE '%/t0'")):
    _spark_seed, _sql_seed = _where.format(c="id"), _where.format(c="target")
    _ctes = O.view(_view) + _BLAST.format(seed=_sql_seed)

    @query(f"blast_radius_{_view}", "G6", O.sql(_ctes, "SELECT seed, id, dist FROM blast"))
    def _blast(spark, sf, view=_view, cond=_spark_seed):
        return _search(spark, sf, view, cond, True).where("dist > 0") \
            .select(F.col("seed_id").alias("seed"), "id", "dist")

    @query(f"blast_summary_{_view}", "G6 F21", O.sql(_ctes, f"""
SELECT seed, count(*)::BIGINT AS reached, {O.half_up('count(*) / (SELECT count(*) FROM n) * 100')} AS pct,
  CASE WHEN {O.half_up('count(*) / (SELECT count(*) FROM n) * 100')} > 40 THEN 'red'
       WHEN {O.half_up('count(*) / (SELECT count(*) FROM n) * 100')} > 15 THEN 'yellow' ELSE 'green' END AS severity
FROM blast GROUP BY 1"""))
    def _blast_summary(spark, sf, view=_view, cond=_spark_seed):
        from linkloom.functions.scalars import level_badge, round_half_up
        hit = _search(spark, sf, view, cond, True).where("dist > 0").groupBy("seed_id") \
            .agg(F.count(F.lit(1)).alias("reached"))
        total = V.graph_of(spark, sf, view).vertices.select(F.count(F.lit(1)).alias("n"))
        pct = round_half_up(F.col("reached") / total.scalar() * 100)
        return hit.select(F.col("seed_id").alias("seed"), "reached", pct.alias("pct")) \
            .withColumn("severity", level_badge(F.col("pct"), 15, 40))

    @query(f"blast_histogram_{_view}", "A26", O.sql(_ctes,
           "SELECT seed, dist, count(*)::BIGINT AS files FROM blast GROUP BY 1, 2"))
    def _blast_histogram(spark, sf, view=_view, cond=_spark_seed):
        return _search(spark, sf, view, cond, True).where("dist > 0") \
            .groupBy(F.col("seed_id").alias("seed"), "dist").agg(F.count(F.lit(1)).alias("files"))


@query("both_ways_nation_fk", "G7", O.sql(O.view("fk") + "," + O.closure_of("e", "tc"), """
SELECT id, (SELECT count(DISTINCT b) FROM tc WHERE a = id)::BIGINT AS upstream,
       (SELECT count(DISTINCT a) FROM tc WHERE b = id)::BIGINT AS downstream FROM n WHERE id LIKE 'nation/%'"""))
def both_ways(spark, sf):
    ups = _search(spark, sf, "fk", "id LIKE 'nation/%'", False)
    downs = _search(spark, sf, "fk", "id LIKE 'nation/%'", True)
    counted = (ups.withColumn("u", F.lit(1)).withColumn("d", F.lit(0))
               .unionByName(downs.withColumn("u", F.lit(0)).withColumn("d", F.lit(1))))
    return counted.groupBy(F.col("seed_id").alias("id")).agg(
        F.sum(F.when(F.col("dist") > 0, F.col("u")).otherwise(0)).alias("upstream"),
        F.sum(F.when(F.col("dist") > 0, F.col("d")).otherwise(0)).alias("downstream"))


_TREE = """,
walk(root, id, k) AS (SELECT id, id, 0 FROM n WHERE {seed}
  UNION SELECT walk.root, e.{to}, k + 1 FROM walk JOIN e ON walk.id = e.{from_} WHERE k < 20),
near AS MATERIALIZED (SELECT root, id, min(k) AS dist FROM walk GROUP BY 1, 2)"""
_TREE_SELECT = """
SELECT c.root, c.id, c.dist::BIGINT AS dist, min(p.id) AS parent FROM near c
LEFT JOIN e ON e.{to} = c.id LEFT JOIN near p ON p.root = c.root AND p.id = e.{from_} AND p.dist = c.dist - 1
WHERE c.dist = 0 OR p.id IS NOT NULL GROUP BY 1, 2, 3"""


@query("tree_downward_region_fk", "G11",
       O.sql(O.view("fk") + _TREE.format(seed="id LIKE 'region/%'", to="source", from_="target"),
             _TREE_SELECT.format(to="source", from_="target")))
def tree_downward(spark, sf):
    """Who breaks: breadth-first tree of dependents below each region."""
    return _search(spark, sf, "fk", "id LIKE 'region/%'", True) \
        .select(F.col("seed_id").alias("root"), "id", "dist", F.col("parent_id").alias("parent"))


@query("tree_upward_turns", "G11", O.sql(
    O.view("turns") + ", tops AS (SELECT id FROM n ANTI JOIN e ON e.target = n.id)"
    + _TREE.format(seed="id IN (SELECT id FROM tops)", to="target", from_="source"),
    _TREE_SELECT.format(to="target", from_="source")))
def tree_upward(spark, sf):
    """What it imports: breadth-first tree from every turn nothing depends on."""
    g = V.graph_of(spark, sf, "turns")
    tops = g.vertices.join(g.pairs.select(F.col("dst").alias("vid")), "vid", "left_anti")
    found = I.reach_from(g.pairs, tops.select(F.col("vid").alias("seed")))
    return names(found, g.vertices, seed="root", vid="id", parent="parent_id") \
        .select("root", "id", "dist", F.col("parent_id").alias("parent"))


# A user has ten spans of five states, so no shortest way is longer than 50.
@query("forest_flow", "G12", O.sql(O.metrics("flow") + """,
tops AS MATERIALIZED (SELECT id FROM m WHERE in_degree = 0),
walk(id, k) AS (SELECT id, 0 FROM tops UNION SELECT rd.target, k + 1 FROM walk JOIN rd ON rd.source = walk.id WHERE k < 50),
near AS MATERIALIZED (SELECT id, min(k) AS dist FROM walk GROUP BY 1),
firsts AS (SELECT c.id, min(p.id) AS parent FROM near c JOIN rd ON rd.target = c.id
           JOIN near p ON p.id = rd.source AND p.dist = c.dist - 1 GROUP BY 1)""", """
SELECT rd.source AS parent, rd.target AS child, (p.dist + 1)::BIGINT AS dist, coalesce(f.parent = rd.source, FALSE) AS first
FROM rd JOIN near p ON p.id = rd.source LEFT JOIN firsts f ON f.id = rd.target
UNION ALL SELECT NULL, id, 0, TRUE FROM tops"""))
def forest_flow(spark, sf):
    b = V.build_of(spark, sf, "flow")
    rows = I.forest(b.graph.vertices, b.reduced.pairs, b.metrics.select("vid", "impact"))
    return names(rows, b.graph.vertices, parent="p", child="c") \
        .select(F.col("p").alias("parent"), F.col("c").alias("child"), "dist", "first")


@query("unreachable_from_roots_flow", "G13", O.sql(O.view("flow") + """,
tops AS MATERIALIZED (SELECT id FROM n ANTI JOIN e ON e.target = n.id),
seen(id) AS (SELECT id FROM tops UNION SELECT e.target FROM seen JOIN e ON e.source = seen.id)""",
       "SELECT id FROM n ANTI JOIN seen ON seen.id = n.id"))
def unreachable_flow(spark, sf):
    return unreachable(V.graph_of(spark, sf, "flow")).select("id")


def _conversation_ends(spark, sf) -> DataFrame:
    """First and last turn of every conversation, both ways round."""
    g = V.graph_of(spark, sf, "turns")
    turns = g.vertices.select("vid", F.regexp_extract("id", r"^conv/(\d+)/", 1).alias("c"),
                              F.regexp_extract("id", r"/t(\d+)$", 1).cast("int").alias("t"))
    ends = turns.groupBy("c").agg(F.min_by("vid", "t").alias("first"), F.max_by("vid", "t").alias("last")) \
        .where("first <> last")
    return ends.select(F.explode(F.array(
        F.struct(F.col("last").alias("from"), F.col("first").alias("to")),
        F.struct(F.col("first").alias("from"), F.col("last").alias("to")))).alias("p")).select("p.*")


@query("shortest_path_turns", "G8", O.sql(O.view("turns") + """,
ends AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1)""", """
SELECT 'conv/' || conv_id || '/t' || hi AS from_id, 'conv/' || conv_id || '/t' || lo AS to_id,
       (hi - lo)::BIGINT AS length, 'forward' AS direction FROM ends WHERE hi > lo
UNION ALL SELECT 'conv/' || conv_id || '/t' || lo, 'conv/' || conv_id || '/t' || hi, hi - lo, 'reverse' FROM ends WHERE hi > lo"""))
def shortest_path_turns(spark, sf):
    g = V.graph_of(spark, sf, "turns")
    found = I.shortest_paths(g.pairs, _conversation_ends(spark, sf))
    return names(found.select("from", "to", (F.size("path") - 1).alias("length"), "direction"), g.vertices,
                 **{"from": "from_id", "to": "to_id"}).select("from_id", "to_id", "length", "direction")


_PAIRS = """,
want AS MATERIALIZED (SELECT a.id AS f, b.id AS t FROM n a JOIN n b
  ON regexp_replace(a.id, '/[^/]*$', '') = regexp_replace(b.id, '/[^/]*$', '') WHERE a.id LIKE '%/signup' AND b.id LIKE '%/purchase'),
hop(f, x, k) AS (SELECT f, f, 0 FROM want UNION SELECT hop.f, e.target, k + 1 FROM hop JOIN e ON e.source = hop.x WHERE k < 6),
poh(f, x, k) AS (SELECT f, f, 0 FROM want UNION SELECT poh.f, e.source, k + 1 FROM poh JOIN e ON e.target = poh.x WHERE k < 6),
fwd AS (SELECT w.f, w.t, min(k) AS k FROM want w JOIN hop ON hop.f = w.f AND hop.x = w.t GROUP BY 1, 2),
bwd AS (SELECT w.f, w.t, min(k) AS k FROM want w JOIN poh ON poh.f = w.f AND poh.x = w.t GROUP BY 1, 2)"""


@query("shortest_path_flow", "G8", O.sql(O.view("flow") + _PAIRS, """
SELECT f AS from_id, t AS to_id, k::BIGINT AS length, 'forward' AS direction FROM fwd
UNION ALL SELECT f, t, k, 'reverse' FROM bwd ANTI JOIN fwd ON bwd.f = fwd.f AND bwd.t = fwd.t"""))
def shortest_path_flow(spark, sf):
    """From signup to purchase inside every span of every user that has both states.

    The check walks up to six steps: a span has five states, so no shortest path is longer.
    """
    g = V.graph_of(spark, sf, "flow")
    spans = g.vertices.select("vid", F.substring_index("id", "/", 2).alias("span"),
                              F.substring_index("id", "/", -1).alias("state"))
    pairs = (spans.where("state = 'signup'").select("span", F.col("vid").alias("from"))
             .join(spans.where("state = 'purchase'").select("span", F.col("vid").alias("to")), "span"))
    found = I.shortest_paths(g.pairs, pairs)
    return names(found.select("from", "to", (F.size("path") - 1).alias("length"), "direction"), g.vertices,
                 **{"from": "from_id", "to": "to_id"}).select("from_id", "to_id", "length", "direction")


# --- layers --------------------------------------------------------------------------------

# Layers on the unreduced graph; what reaches a cycle or a self-loop stays behind.
def _layers_sql(view: str) -> str:
    return O.view(view) + ", d AS MATERIALIZED (SELECT DISTINCT source, target FROM e)," + O.closure_of("d", "tc") + """,
onloop AS (SELECT DISTINCT a AS id FROM tc WHERE a = b),
stuck AS MATERIALIZED (SELECT id FROM onloop UNION SELECT a FROM tc JOIN onloop ON tc.b = onloop.id),
fe AS MATERIALIZED (SELECT source, target FROM d ANTI JOIN stuck ON stuck.id = d.source),
lv(id, k) AS (SELECT source, 1 FROM fe UNION SELECT fe.source, lv.k + 1 FROM lv JOIN fe ON fe.target = lv.id),
top AS (SELECT id, max(k) AS k FROM lv GROUP BY 1),
free AS (SELECT n.id, coalesce(top.k, 0) AS layer FROM n ANTI JOIN stuck ON stuck.id = n.id LEFT JOIN top ON top.id = n.id),
lay AS MATERIALIZED (SELECT id, layer::BIGINT AS layer FROM free
  UNION ALL SELECT id, (SELECT coalesce(max(layer), -1) + 1 FROM free)::BIGINT FROM stuck)"""


def layers_of(spark, sf, view: str) -> DataFrame:
    def make():
        g = V.graph_of(spark, sf, view)
        return g.vertices.join(I.topological_layers(g.vertices, g.pairs), "vid") \
            .select("repo", "id", "vid", "layer", M.paths.directory("id").alias("dir"))
    return V.stored(spark, sf, "layers", view, make=make)


for _view in ("fk", "turns", "flow"):
    @query(f"topological_layers_{_view}", "G9", O.sql(_layers_sql(_view), "SELECT id, layer FROM lay"))
    def _layers(spark, sf, view=_view):
        return layers_of(spark, sf, view).select("id", "layer")

    @query(f"edge_layers_{_view}", "G10", O.sql(_layers_sql(_view), """
SELECT e.source, e.target, greatest(s.layer, t.layer)::BIGINT AS layer, count(*)::BIGINT AS copies FROM e
JOIN lay s ON s.id = e.source JOIN lay t ON t.id = e.target GROUP BY ALL"""))
    def _edge_layers(spark, sf, view=_view):
        lay = layers_of(spark, sf, view)
        arcs = V.graph_of(spark, sf, view).arcs
        s = lay.select(F.col("vid").alias("src"), F.col("layer").alias("ls"))
        t = lay.select(F.col("vid").alias("dst"), F.col("layer").alias("lt"))
        rows = lay.count()
        return attach(attach(arcs, s, ["src"], "inner", rows), t, ["dst"], "inner", rows) \
            .select("source", "target", F.greatest("ls", "lt").alias("layer"), "copies")
