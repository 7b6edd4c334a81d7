"""Snapshot comparison and what-if analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import compare as D
from linkloom.operators import predicates as P
from linkloom.operators import whatif as X
from linkloom.plans import oracle as O
from linkloom.plans import views as V
from linkloom.plans.catalog import query
from linkloom.sources import exports

# The old snapshot is ``fk``. The new one has lost the nations of region 0 with everything on
# them, and every nation depends on a new file per region.
_NEW = """,
gone AS MATERIALIZED (SELECT 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey = 0),
e2 AS MATERIALIZED (SELECT source, target FROM e WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'nation/' || n_nationkey, 'shared/' || n_regionkey FROM nation WHERE n_regionkey <> 0),
n2 AS MATERIALIZED (SELECT id FROM n WHERE id NOT IN (SELECT id FROM gone) UNION SELECT target FROM e2)"""
_DIFF = O.view("fk") + _NEW + """,
dn AS MATERIALIZED (SELECT coalesce(n.id, n2.id) AS id, CASE WHEN n.id IS NULL THEN 'added' WHEN n2.id IS NULL THEN 'removed' ELSE 'unchanged' END AS diff
  FROM n FULL JOIN n2 ON n.id = n2.id),
de AS MATERIALIZED (SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, coalesce(b.c, a.c)::BIGINT AS copies,
  CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'unchanged' END AS diff
  FROM (SELECT source, target, count(*) AS c FROM e GROUP BY 1, 2) a FULL JOIN (SELECT source, target, count(*) AS c FROM e2 GROUP BY 1, 2) b
  ON a.source = b.source AND a.target = b.target)"""


def _old(spark, sf):
    g = V.graph_of(spark, sf, "fk")
    return g.vertices.select("repo", "id"), g.arcs.select("repo", "source", "target", "copies")


def _gone(spark, sf):
    return V.table(spark, sf, "nation").where("n_regionkey = 0") \
        .select(F.lit("fk").alias("repo"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("id"))


def _new(spark, sf):
    nodes, edges = _old(spark, sf)
    gone = _gone(spark, sf)
    left = (edges.join(gone.withColumnRenamed("id", "source"), ["repo", "source"], "left_anti")
            .join(gone.withColumnRenamed("id", "target"), ["repo", "target"], "left_anti")
            .select("repo", "source", "target", "copies"))
    extra = V.table(spark, sf, "nation").where("n_regionkey <> 0").select(
        F.lit("fk").alias("repo"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("source"),
        F.concat(F.lit("shared/"), F.col("n_regionkey").cast("string")).alias("target"), F.lit(1).cast("bigint").alias("copies"))
    edges2 = left.unionByName(extra)
    nodes2 = nodes.join(gone, ["repo", "id"], "left_anti") \
        .unionByName(edges2.select("repo", F.col("target").alias("id"))).distinct()
    return nodes2, edges2


def diffs(spark, sf):
    def make():
        (on, oe), (nn, ne) = _old(spark, sf), _new(spark, sf)
        return (V.materialize(D.diff_nodes(on, nn), "diff"), V.materialize(D.diff_edges(oe, ne), "diff"))
    return V.remembered(spark, sf, "diff", make=make)


@query("diff_nodes_fk", "J12", O.sql(_DIFF, "SELECT id, diff FROM dn"))
def diff_nodes(spark, sf):
    return diffs(spark, sf)[0].select("id", "diff")


@query("diff_edges_fk", "J12", O.sql(_DIFF, "SELECT source, target, copies, diff FROM de"))
def diff_edges(spark, sf):
    return diffs(spark, sf)[1].select("source", "target", "copies", "diff")


@query("diff_attributes_fk", "J12", O.sql(O.metrics("fk") + """,
o AS (SELECT id, in_degree FROM m WHERE dir <> 'part'), w2 AS (SELECT id, out_degree AS in_degree FROM m WHERE dir <> 'customer')""", """
SELECT coalesce(o.id, w2.id) AS id, CASE WHEN w2.id IS NULL THEN o.in_degree ELSE w2.in_degree END AS in_degree,
  CASE WHEN o.id IS NULL THEN 'added' WHEN w2.id IS NULL THEN 'removed' ELSE 'unchanged' END AS diff FROM o FULL JOIN w2 ON o.id = w2.id"""))
def diff_attributes(spark, sf):
    """Attributes come from the new side, or from the old one where the node is gone."""
    nodes = V.build_of(spark, sf, "fk").nodes
    old = nodes.where("dir <> 'part'").select("repo", "id", "in_degree")
    new = nodes.where("dir <> 'customer'").select("repo", "id", F.col("out_degree").alias("in_degree"))
    return D.diff_nodes(old, new).select("id", "in_degree", "diff")


@query("diff_statistics_fk", "A27", O.sql(_DIFF, """
SELECT 'node' AS kind, diff, count(*)::BIGINT AS rows FROM dn GROUP BY diff
UNION ALL SELECT 'edge', diff, sum(copies)::BIGINT FROM de GROUP BY diff"""))
def diff_statistics(spark, sf):
    return D.diff_statistics(*diffs(spark, sf)).select("kind", "diff", "rows")


@query("diff_without_added_fk", "P16", O.sql(_DIFF, """
SELECT source, target, diff FROM de WHERE diff <> 'added' AND source NOT IN (SELECT id FROM dn WHERE diff = 'added')
  AND target NOT IN (SELECT id FROM dn WHERE diff = 'added')"""))
def diff_without_added(spark, sf):
    return P.hide_status(*diffs(spark, sf), ["added"])[1].select("source", "target", "diff")


@query("diff_without_removed_fk", "P16", O.sql(_DIFF, """
SELECT source, target, diff FROM de WHERE diff <> 'removed' AND source NOT IN (SELECT id FROM dn WHERE diff = 'removed')
  AND target NOT IN (SELECT id FROM dn WHERE diff = 'removed')"""))
def diff_without_removed(spark, sf):
    return P.hide_status(*diffs(spark, sf), ["removed"])[1].select("source", "target", "diff")


@query("added_removed_nodes_fk", "U1", O.sql(_DIFF, "SELECT id, diff FROM dn WHERE diff <> 'unchanged'"))
def added_removed_nodes(spark, sf):
    (on, _), (nn, _) = _old(spark, sf), _new(spark, sf)
    return D.added(on, nn, ["repo", "id"]).withColumn("diff", F.lit("added")) \
        .unionByName(D.added(nn, on, ["repo", "id"]).withColumn("diff", F.lit("removed"))).select("id", "diff")


@query("added_removed_edges_fk", "U2", O.sql(_DIFF, "SELECT source, target, diff FROM de WHERE diff <> 'unchanged'"))
def added_removed_edges(spark, sf):
    keys = ["repo", "source", "target"]
    (_, oe), (_, ne) = _old(spark, sf), _new(spark, sf)
    return D.added(oe, ne, keys).withColumn("diff", F.lit("added")) \
        .unionByName(D.added(ne, oe, keys).withColumn("diff", F.lit("removed"))).select("source", "target", "diff")


@query("diff_markdown_fk", "S11")
def diff_markdown(spark, sf):
    nodes, edges = diffs(spark, sf)
    none = nodes.where("false").select("repo", F.col("id").alias("cycle_id"), F.col("id").alias("member"))
    return exports.diff_markdown(nodes, edges, none).select("section", "line")


# --- what if -------------------------------------------------------------------------------

# Remove the suppliers with an account in the red, and every edge from customers straight to region 1.
_REMOVE = O.view("fk") + """,
rn AS MATERIALIZED (SELECT 'supplier/' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0),
re AS MATERIALIZED (SELECT DISTINCT source, target FROM e WHERE starts_with(source, 'customer/') AND target = 'region/1'),
cut AS MATERIALIZED (SELECT e.source, e.target, e.source IN (SELECT id FROM rn) AS s_gone, e.target IN (SELECT id FROM rn) AS t_gone,
  re.source IS NOT NULL AS e_gone FROM e LEFT JOIN re ON re.source = e.source AND re.target = e.target),
e2 AS MATERIALIZED (SELECT source, target FROM cut WHERE NOT s_gone AND NOT t_gone AND NOT e_gone),
n2 AS MATERIALIZED (SELECT id FROM n WHERE id NOT IN (SELECT id FROM rn)),
brk AS MATERIALIZED (SELECT source AS file, target AS missing_dep, CASE WHEN t_gone THEN 'target_removed' ELSE 'edge_removed' END AS reason,
  count(*)::BIGINT AS copies FROM cut WHERE NOT s_gone AND (t_gone OR e_gone) GROUP BY ALL),
orph AS MATERIALIZED (SELECT id FROM n2 WHERE id IN (SELECT target FROM e) AND id NOT IN (SELECT target FROM e2))"""
_IMPACTS = "," + O.closure_of("e", "tc1") + "," + O.closure_of("e2", "tc2") + """,
i1 AS (SELECT b AS id, count(DISTINCT a) AS c FROM tc1 WHERE a <> b GROUP BY 1), i2 AS (SELECT b AS id, count(DISTINCT a) AS c FROM tc2 WHERE a <> b GROUP BY 1),
ic AS MATERIALIZED (SELECT n2.id AS file, coalesce(i1.c, 0)::BIGINT AS old_impact, coalesce(i2.c, 0)::BIGINT AS new_impact,
  (coalesce(i2.c, 0) - coalesce(i1.c, 0))::BIGINT AS delta FROM n2 LEFT JOIN i1 ON i1.id = n2.id LEFT JOIN i2 ON i2.id = n2.id
  WHERE coalesce(i1.c, 0) <> coalesce(i2.c, 0))"""


def removed(spark, sf):
    """The nodes and edges to remove."""
    gone = V.table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.lit("fk").alias("repo"), F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("id"))
    return gone, _old(spark, sf)[1].where("source like 'customer/%' and target = 'region/1'")


def removal(spark, sf):
    def make():
        nodes, edges = _old(spark, sf)
        c = X.remove(nodes, edges, *removed(spark, sf))
        return X.Change(V.materialize(c.nodes, "whatif"), V.materialize(c.edges, "whatif"), V.materialize(c.broken, "whatif"))
    return V.remembered(spark, sf, "removal", make=make)


def before(spark, sf, view):
    """Impact and cycles of a view before a change."""
    def make():
        return X.recount(V.graph_of(spark, sf, view))
    return V.remembered(spark, sf, "before", view, make=make)


def after(spark, sf, name, change):
    return V.remembered(spark, sf, "after", name, make=lambda: X.recount(change.nodes, change.edges))


def after_removal(spark, sf, view, gone_nodes, gone_edges=None):
    return V.remembered(spark, sf, "after removal", view,
                        make=lambda: X.recount_removal(before(spark, sf, view), gone_nodes, gone_edges))


@query("removal_edges_fk", "J21", O.sql(_REMOVE, "SELECT source, target, count(*)::BIGINT AS copies FROM e2 GROUP BY 1, 2"))
def removal_edges(spark, sf):
    return removal(spark, sf).edges.select("source", "target", "copies")


@query("removal_nodes_fk", "J21", O.sql(_REMOVE, "SELECT id FROM n2"))
def removal_nodes(spark, sf):
    return removal(spark, sf).nodes.select("id")


@query("broken_imports_fk", "J22", O.sql(_REMOVE, "SELECT * FROM brk"))
def broken_imports(spark, sf):
    return removal(spark, sf).broken.select("file", "missing_dep", "reason", "copies")


@query("newly_orphaned_fk", "J23", O.sql(O.view("fk"), """
SELECT id FROM n WHERE NOT starts_with(id, 'part/') AND id IN (SELECT target FROM e)
  AND id NOT IN (SELECT target FROM e WHERE NOT starts_with(source, 'part/') AND NOT starts_with(target, 'part/'))"""))
def newly_orphaned(spark, sf):
    """With every part gone, nothing depends on the suppliers that were sold."""
    nodes, edges = _old(spark, sf)
    return X.newly_orphaned(edges, X.remove(nodes, edges, nodes.where("id like 'part/%'"))).select("id")


@query("removal_impact_changes_fk", "J26 T7", O.sql(_REMOVE + _IMPACTS, "SELECT * FROM ic ORDER BY abs(delta) DESC, file LIMIT 30"))
def removal_impact_changes(spark, sf):
    new = after_removal(spark, sf, "fk", *removed(spark, sf))
    return X.impact_changes(before(spark, sf, "fk").impacts, new.impacts, 30).drop("repo")


@query("removal_impact_all_changes_fk", "J26", O.sql(_REMOVE + _IMPACTS, "SELECT * FROM ic"))
def removal_impact_all(spark, sf):
    new = after_removal(spark, sf, "fk", *removed(spark, sf))
    return X.impact_changes(before(spark, sf, "fk").impacts, new.impacts).drop("repo")


@query("removal_statistics_fk", "A28", O.sql(_REMOVE, """
SELECT (SELECT count(*) FROM n)::BIGINT AS original_node_count, (SELECT count(*) FROM n2)::BIGINT AS new_node_count,
  (SELECT count(*) FROM e)::BIGINT AS original_edge_count, (SELECT count(*) FROM e2)::BIGINT AS new_edge_count,
  (SELECT sum(copies) FROM brk)::BIGINT AS broken_import_count, (SELECT count(*) FROM orph)::BIGINT AS orphaned_count,
  0::BIGINT AS cycles_resolved, 0::BIGINT AS cycles_introduced, 'removal' AS operation"""))
def removal_statistics(spark, sf):
    nodes, edges = _old(spark, sf)
    c = removal(spark, sf)
    return X.statistics(nodes, edges, c, before(spark, sf, "fk").cycles, after_removal(spark, sf, "fk", *removed(spark, sf)), "removal").drop("repo")


# Every state of the event type ``error`` goes: cycles through it break up.
_NOERR = O.view("flow") + """,
e2 AS MATERIALIZED (SELECT source, target FROM e WHERE NOT ends_with(source, '/error') AND NOT ends_with(target, '/error')),
n2 AS MATERIALIZED (SELECT id FROM n WHERE NOT ends_with(id, '/error')),""" \
    + O.closure_of("e", "tc1") + "," + O.closure_of("e2", "tc2") + "," + O.components_of("tc1", "s1") + "," + O.components_of("tc2", "s2") + """,
g1 AS (SELECT comp, string_agg(id, ';' ORDER BY id) AS members, count(*) AS size FROM s1 GROUP BY 1),
g2 AS (SELECT comp, string_agg(id, ';' ORDER BY id) AS members, count(*) AS size FROM s2 GROUP BY 1)"""


def without_errors(spark, sf):
    return after_removal(spark, sf, "flow", V.graph_of(spark, sf, "flow").vertices.where("id like '%/error'"))


@query("cycles_resolved_flow", "J27 U3", O.sql(_NOERR, """
SELECT comp AS cycle_id, size::BIGINT AS size, 'resolved' AS change FROM g1 WHERE members NOT IN (SELECT members FROM g2)
UNION ALL SELECT comp, size, 'introduced' FROM g2 WHERE members NOT IN (SELECT members FROM g1)"""))
def cycles_resolved(spark, sf):
    old = before(spark, sf, "flow").cycles
    new = without_errors(spark, sf).cycles
    return D.only_in(old, new).withColumn("change", F.lit("resolved")) \
        .unionByName(D.only_in(new, old).withColumn("change", F.lit("introduced"))).drop("repo")


@query("removal_impact_changes_flow", "J26 T7", O.sql(_NOERR + """,
i1 AS (SELECT b AS id, count(DISTINCT a) AS c FROM tc1 WHERE a <> b GROUP BY 1), i2 AS (SELECT b AS id, count(DISTINCT a) AS c FROM tc2 WHERE a <> b GROUP BY 1)""", """
SELECT n2.id AS file, coalesce(i1.c, 0)::BIGINT AS old_impact, coalesce(i2.c, 0)::BIGINT AS new_impact,
  (coalesce(i2.c, 0) - coalesce(i1.c, 0))::BIGINT AS delta FROM n2 LEFT JOIN i1 ON i1.id = n2.id LEFT JOIN i2 ON i2.id = n2.id
  WHERE coalesce(i1.c, 0) <> coalesce(i2.c, 0) ORDER BY abs(delta) DESC, file LIMIT 30"""))
def removal_impact_changes_flow(spark, sf):
    new = without_errors(spark, sf)
    return X.impact_changes(before(spark, sf, "flow").impacts, new.impacts, 30).drop("repo")


# Merge all nations of a region into the region's first nation.
_MERGE = O.view("fk") + """,
mv AS MATERIALIZED (SELECT 'nation/' || n_nationkey AS id, 'nation/' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS into_ FROM nation),
e2 AS MATERIALIZED (SELECT DISTINCT coalesce(a.into_, source) AS source, coalesce(b.into_, target) AS target FROM e
  LEFT JOIN mv a ON a.id = source LEFT JOIN mv b ON b.id = target WHERE coalesce(a.into_, source) <> coalesce(b.into_, target)),
n2 AS MATERIALIZED (SELECT id FROM n WHERE id NOT IN (SELECT id FROM mv WHERE id <> into_))"""


def merged(spark, sf):
    def make():
        nodes, edges = _old(spark, sf)
        nation = V.table(spark, sf, "nation")
        heads = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("head"))
        moved = nation.join(heads, "n_regionkey").where("n_nationkey <> head").select(
            F.lit("fk").alias("repo"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("id"),
            F.concat(F.lit("nation/"), F.col("head").cast("string")).alias("merged"))
        c = X.merge(nodes, edges, moved)
        return X.Change(V.materialize(c.nodes, "whatif"), V.materialize(c.edges, "whatif"))
    return V.remembered(spark, sf, "merge", make=make)


@query("merge_edges_fk", "J24", O.sql(_MERGE, "SELECT source, target FROM e2"))
def merge_edges(spark, sf):
    return merged(spark, sf).edges.select("source", "target")


@query("merge_impact_changes_fk", "J24 J26 T7", O.sql(_MERGE + _IMPACTS, "SELECT * FROM ic ORDER BY abs(delta) DESC, file LIMIT 30"))
def merge_impact_changes(spark, sf):
    new = after(spark, sf, "merge", merged(spark, sf))
    return X.impact_changes(before(spark, sf, "fk").impacts, new.impacts, 30).drop("repo")


@query("merge_statistics_fk", "A28 J24", O.sql(_MERGE, """
SELECT (SELECT count(*) FROM n)::BIGINT AS original_node_count, (SELECT count(*) FROM n2)::BIGINT AS new_node_count,
  (SELECT count(*) FROM e)::BIGINT AS original_edge_count, (SELECT count(*) FROM e2)::BIGINT AS new_edge_count,
  0::BIGINT AS broken_import_count, (SELECT count(*) FROM n2 WHERE id IN (SELECT target FROM e) AND id NOT IN (SELECT target FROM e2))::BIGINT AS orphaned_count,
  0::BIGINT AS cycles_resolved, 0::BIGINT AS cycles_introduced, 'merge' AS operation"""))
def merge_statistics(spark, sf):
    nodes, edges = _old(spark, sf)
    c = merged(spark, sf)
    return X.statistics(nodes, edges, c, before(spark, sf, "fk").cycles, after(spark, sf, "merge", c), "merge").drop("repo")


_MERGES = [("fk", ["nation/1", "nation/2", "nation/3"], "nation/2"), ("fk", ["nation/4"], None),
           ("fk", ["nation/5", "nowhere/1"], None), ("fk", ["nation/9", "nation/2"], "nation/9"), ("fk", ["nation/7", "nation/1"], None)]


@query("merge_requests_fk", "J24 P17", O.sql(O.view("fk") + """,
mv AS (SELECT * FROM (VALUES ('nation/1', 'nation/9'), ('nation/3', 'nation/9'), ('nation/2', 'nation/9')) t(id, into_)),
e2 AS MATERIALIZED (SELECT DISTINCT coalesce(a.into_, source) AS source, coalesce(b.into_, target) AS target FROM e
  LEFT JOIN mv a ON a.id = source LEFT JOIN mv b ON b.id = target
  WHERE (a.id IS NULL AND b.id IS NULL) OR coalesce(a.into_, source) <> coalesce(b.into_, target))""", "SELECT source, target FROM e2"))
def merge_requests(spark, sf):
    """A chain of merges; requests with too few, unknown or already absorbed nodes are skipped."""
    nodes, edges = _old(spark, sf)
    final = X.merge_targets(nodes, _MERGES)
    moved = spark.createDataFrame([(r, i, t) for (r, i), t in final.items()], "repo string, id string, merged string")
    return X.merge(nodes, edges, moved).edges.select("source", "target")


# Split every nation into the default two parts.
_SPLIT = O.view("fk") + """,
sp AS MATERIALIZED (SELECT 'nation/' || n_nationkey AS node FROM nation),
e2 AS MATERIALIZED (SELECT DISTINCT source, target FROM e WHERE source NOT IN (SELECT node FROM sp) AND target NOT IN (SELECT node FROM sp)
  UNION SELECT source || '_a', target FROM e WHERE source IN (SELECT node FROM sp)
  UNION SELECT source, target || '_a' FROM e WHERE target IN (SELECT node FROM sp)),
n2 AS MATERIALIZED (SELECT id FROM n WHERE id NOT IN (SELECT node FROM sp) UNION SELECT node || '_a' FROM sp UNION SELECT node || '_b' FROM sp)"""


def parted(spark, sf):
    def make():
        nodes, edges = _old(spark, sf)
        targets = V.table(spark, sf, "nation").select(
            F.lit("fk").alias("repo"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("id"))
        parts, part_edges = X.propose_split(edges, targets)
        c = X.split(nodes, edges, parts, part_edges)
        return X.Change(V.materialize(c.nodes, "whatif"), V.materialize(c.edges, "whatif"))
    return V.remembered(spark, sf, "split", make=make)


@query("split_edges_fk", "J25 P17", O.sql(_SPLIT, "SELECT source, target FROM e2"))
def split_edges(spark, sf):
    return parted(spark, sf).edges.select("source", "target")


@query("split_nodes_fk", "J25", O.sql(_SPLIT, "SELECT id FROM n2"))
def split_nodes(spark, sf):
    return parted(spark, sf).nodes.select("id")


@query("split_impact_changes_fk", "J25 J26", O.sql(_SPLIT + _IMPACTS, "SELECT * FROM ic"))
def split_impact_changes(spark, sf):
    new = after(spark, sf, "split", parted(spark, sf))
    return X.impact_changes(before(spark, sf, "fk").impacts, new.impacts).drop("repo")
