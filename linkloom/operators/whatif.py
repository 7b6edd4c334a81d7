"""What-if analysis: removing, merging and splitting nodes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import compare
from linkloom.operators.graph import Graph, graph_from_arcs
from linkloom.operators.iterate import Ancestors, bits_of, bucket_of, component_arcs, member_bits, reach_from, union_all
from linkloom.operators.metrics import cycle_members, impact
from linkloom.operators.ranking import top_per_group
from linkloom.store import attach, materialize, write_table


@dataclass(frozen=True)
class Change:
    """A changed graph next to the original: nodes (repo, id), edges (repo, source, target, copies)."""

    nodes: DataFrame
    edges: DataFrame
    lost: DataFrame | None = None  # broken edges, where the change names them

    @cached_property
    def broken(self) -> DataFrame:
        """repo, file, missing_dep, reason, copies: looked for in the changed graph when first asked for, if not named."""
        return self.lost if self.lost is not None else _broken(self.nodes, self.edges)


def remove(nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame | None = None,
           gone_edges: DataFrame | None = None) -> Change:
    """Drop nodes ``(repo, id)`` and edges ``(repo, source, target)``."""
    kept_nodes, left, broken = nodes.select("repo", "id"), edges, []
    if gone_nodes is not None:
        gone = gone_nodes.select("repo", "id").distinct()
        rows = gone.count()
        kept_nodes = kept_nodes.join(gone, ["repo", "id"], "left_anti")
        left = attach(left, gone.withColumnRenamed("id", "source"), ["repo", "source"], "left_anti", rows)
        targets = gone.withColumnRenamed("id", "target")
        broken.append(attach(left, targets, ["repo", "target"], "left_semi", rows)
                      .withColumn("reason", F.lit("target_removed")))
        left = attach(left, targets, ["repo", "target"], "left_anti", rows)
    if gone_edges is not None:
        keys = ["repo", "source", "target"]
        cut = gone_edges.select(*keys).distinct()
        broken.append(left.join(cut, keys, "left_semi").withColumn("reason", F.lit("edge_removed")))
        left = left.join(cut, keys, "left_anti")
    if not broken:
        raise ValueError("name nodes or edges to remove")
    lost = union_all([b.select("repo", F.col("source").alias("file"), F.col("target").alias("missing_dep"),
                               "reason", "copies") for b in broken])
    return Change(kept_nodes, left, lost)


def merge_targets(nodes: DataFrame, merges: list[tuple[str, list[str], str | None]]) -> dict[tuple[str, str], str]:
    """Where each absorbed node ends up: ``(repo, id) -> merged id``.

    ``merges`` is the ordered list ``(repo, nodes, merged_id)`` a user asks for. A merge is
    skipped when it has fewer than two nodes, or any of its nodes is unknown or already
    absorbed. Chains of merges are followed to their end, so one join applies them all.
    """
    named = {(repo, n) for repo, group, into in merges for n in [*group, into or (group[0] if group else "")]}
    repos = sorted({r for r, _ in named})
    ids = sorted({i for _, i in named})
    # Bounded by the request: only the nodes it names are looked up.
    alive = {(r.repo, r.id) for r in
             nodes.where(F.col("repo").isin(repos) & F.col("id").isin(ids)).select("repo", "id").collect()}
    final: dict[tuple[str, str], str] = {}
    for repo, group, into in merges:
        into = into or (group[0] if group else "")
        absorbed = [n for n in group if n != into]
        if len(group) < 2 or (repo, into) not in alive or any((repo, n) not in alive for n in absorbed):
            continue
        for n in absorbed:
            alive.discard((repo, n))
            for key, at in list(final.items()):
                if key[0] == repo and at == n:
                    final[key] = into
            final[(repo, n)] = into
    return final


def merge(nodes: DataFrame, edges: DataFrame, moved: DataFrame) -> Change:
    """Redirect edges of absorbed nodes; ``moved`` is ``(repo, id, merged)`` at its fixed point.

    Edges become a set. A redirected edge that would point to itself disappears; a self-loop
    that was there before stays.
    """
    rows = moved.count()
    s = moved.select("repo", F.col("id").alias("source"), F.col("merged").alias("_s"))
    t = moved.select("repo", F.col("id").alias("target"), F.col("merged").alias("_t"))
    both = attach(attach(edges, s, ["repo", "source"], "left", rows), t, ["repo", "target"], "left", rows)
    out = (both.select("repo", F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"),
                       (F.col("_s").isNotNull() | F.col("_t").isNotNull()).alias("_moved"))
           .where("not (_moved and source = target)").select("repo", "source", "target").distinct()
           .withColumn("copies", F.lit(1).cast("bigint")))
    kept = nodes.select("repo", "id").join(moved.select("repo", "id"), ["repo", "id"], "left_anti")
    return Change(kept, out)


def propose_split(edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default split of nodes ``(repo, id)``: ``<base>_a<ext>`` takes every edge, ``<base>_b<ext>`` none.

    Returns parts ``(repo, node, part)`` and part edges ``(repo, node, part, other, kind)``.
    """
    dot = F.regexp_extract("id", r"(\.[^.]*)$", 1)
    base = F.substring(F.col("id"), F.lit(1), F.length("id") - F.length(dot))
    named = targets.select("repo", F.col("id").alias("node"), F.concat(base, F.lit("_a"), dot).alias("a"),
                           F.concat(base, F.lit("_b"), dot).alias("b"))
    parts = named.select("repo", "node", F.explode(F.array("a", "b")).alias("part"))
    first = named.select("repo", "node", F.col("a").alias("part"))
    out = edges.join(first.withColumnRenamed("node", "source"), ["repo", "source"]) \
        .select("repo", F.col("source").alias("node"), "part", F.col("target").alias("other"),
                F.lit("outbound").alias("kind"))
    inn = edges.join(first.withColumnRenamed("node", "target"), ["repo", "target"]) \
        .select("repo", F.col("target").alias("node"), "part", F.col("source").alias("other"),
                F.lit("inbound").alias("kind"))
    return parts, out.unionByName(inn).distinct()


def split(nodes: DataFrame, edges: DataFrame, parts: DataFrame, part_edges: DataFrame) -> Change:
    """Replace nodes by parts.

    ``parts``: ``(repo, node, part)``; ``part_edges``: ``(repo, node, part, other, kind)`` with
    kind ``outbound``, ``inbound`` or ``depends_on``. A node with fewer than two parts, or that
    does not exist, is left alone. Part edges to nodes that do not exist are ignored.
    """
    sized = parts.groupBy("repo", "node").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    known = nodes.select("repo", F.col("id").alias("node"))
    valid = sized.join(known, ["repo", "node"], "left_semi").select("repo", "node")
    parts = parts.join(valid, ["repo", "node"], "left_semi")
    gone = valid.withColumnRenamed("node", "id")
    kept = (nodes.select("repo", "id").join(gone, ["repo", "id"], "left_anti")
            .unionByName(parts.select("repo", F.col("part").alias("id"))).distinct())
    rows = gone.count()
    rest = attach(edges.select("repo", "source", "target"), gone.withColumnRenamed("id", "source"),
                  ["repo", "source"], "left_anti", rows)
    rest = attach(rest, gone.withColumnRenamed("id", "target"), ["repo", "target"], "left_anti", rows)
    new = (part_edges.join(valid, ["repo", "node"], "left_semi")
           .join(kept.withColumnRenamed("id", "other"), ["repo", "other"], "left_semi")
           .where("other <> part"))
    inbound = F.col("kind") == "inbound"
    new = new.select("repo", F.when(inbound, F.col("other")).otherwise(F.col("part")).alias("source"),
                     F.when(inbound, F.col("part")).otherwise(F.col("other")).alias("target"))
    out = rest.unionByName(new).distinct().withColumn("copies", F.lit(1).cast("bigint"))
    return Change(kept, out)


def _broken(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node. Ends are looked up once each; edges meet only the names that are missing."""
    ends = [edges.select("repo", F.col(end).alias("id")).distinct() for end in ("source", "target")]
    absent, rows = write_table(ends[0].unionByName(ends[1]).distinct().join(nodes, ["repo", "id"], "left_anti"), "absent")
    out = edges
    for end, mark in (("source", "_s"), ("target", "_t")):
        out = attach(out, absent.select("repo", F.col("id").alias(end), F.lit(True).alias(mark)), ["repo", end], "left", rows, edges)
    no_source = F.col("_s").isNotNull() | F.col("repo").isNull() | F.col("source").isNull()
    return (out.where(no_source | F.col("_t").isNotNull() | F.col("target").isNull())
            .select("repo", F.col("source").alias("file"), F.col("target").alias("missing_dep"),
                    F.when(no_source, F.lit("source_removed")).otherwise(F.lit("target_removed")).alias("reason"), "copies"))


def newly_orphaned(old_edges: DataFrame, change: Change, new: Graph | None = None) -> DataFrame:
    """Nodes of the changed graph that were imported before and no longer are; ``new`` is that graph, where it is built."""
    had = old_edges.select("repo", F.col("target").alias("id")).distinct()
    if new is not None:
        has = new.vertices.join(new.pairs.select(F.col("dst").alias("vid")).distinct(), "vid", "left_semi").select("repo", "id")
    else:
        ends = change.nodes.withColumnRenamed("id", "source")
        has = (attach(change.edges, ends, ["repo", "source"], "left_semi")
               .select("repo", F.col("target").alias("id")).distinct())
    return change.nodes.join(had, ["repo", "id"], "left_semi").join(has, ["repo", "id"], "left_anti")


@dataclass(frozen=True)
class Recount:
    graph: Graph
    comps: DataFrame | None
    impacts: DataFrame   # repo, id, impact
    cycles: DataFrame
    above: Ancestors | None = None


def recount(nodes: DataFrame | Graph, edges: DataFrame | None = None) -> Recount:
    """Cycles and impact of a graph as it stands, without reduction: of nodes and the edges between them, or of a graph."""
    from linkloom.plans.build import ancestors, find_components
    g = nodes if isinstance(nodes, Graph) else graph_from_arcs(edges, nodes.select("repo", "id"), closed=True)
    peeled, comps = find_components(g.pairs)
    above, _ = ancestors(g.pairs, peeled, comps)
    table = (g.vertices.join(impact(above.words, comps), "vid", "left")
             .select("repo", "id", F.coalesce("impact", F.lit(0)).alias("impact")))
    return Recount(g, comps, materialize(table, "impact"), cycle_members(g.vertices, g.links, comps), above)


def recount_removal(old: Recount, gone_nodes: DataFrame | None = None, gone_edges: DataFrame | None = None) -> Recount:
    """What ``recount`` gives without nodes ``(repo, id)`` and edges ``(repo, source, target)``, by difference.

    Only what a removed edge led to can lose a cycle or something that reaches it: the targets of removed edges, and what
    is below them. These vertices are counted anew, from the arcs among them and from what is known of the vertices that
    point to them from outside; all others keep their counts. Vertex numbers stay as they were.
    """
    from linkloom.plans.build import ancestors, find_components
    if old.above is None:
        raise ValueError("the count before has no sets of ancestors")
    g = old.graph
    none = g.vertices.where("false").select("vid")
    gone, n_gone = (none, 0) if gone_nodes is None else write_table(
        g.vertices.join(gone_nodes.select("repo", "id").distinct(), ["repo", "id"], "left_semi").select("vid"), "gone")
    ends = [attach(g.pairs, gone.select(F.col("vid").alias(end)), [end], "left_semi", n_gone) for end in ("src", "dst")]
    if gone_edges is not None:
        cuts, rows = materialize(gone_edges.select("repo", "source", "target").distinct(), "gone_edges"), g.vertices.count()
        for end, name in (("src", "source"), ("dst", "target")):
            held = g.vertices.select("repo", F.col("id").alias(name), F.col("vid").alias(end))
            cuts = attach(cuts, held, ["repo", name], "inner", rows)
        ends.append(g.pairs.join(cuts.select("src", "dst"), ["src", "dst"], "left_semi"))
    cut, n_cut = write_table(union_all(ends).select("src", "dst").distinct(), "cut")
    links = materialize(attach(g.links, cut, ["src", "dst"], "left_anti", n_cut).select("src", "dst", "copies"), "kept")
    vertices = attach(g.vertices, gone, ["vid"], "left_anti", n_gone)
    pairs = links.select("src", "dst")
    seeds = attach(cut.select(F.col("dst").alias("vid")).distinct(), gone, ["vid"], "left_anti", n_gone)
    touched, n_touched = write_table(reach_from(pairs, seeds.withColumn("seed", F.lit(0))).select("vid"), "touched")

    into = attach(pairs, touched.withColumnRenamed("vid", "dst"), ["dst"], "left_semi", n_touched)
    into = materialize(attach(into, touched.select(F.col("vid").alias("src"), F.lit(True).alias("_in")), ["src"], "left", n_touched), "into")
    inside = into.where("_in").select("src", "dst")
    peeled, comps = find_components(inside)
    border = into.where("_in is null").select("src", "dst")
    heads = component_arcs(border, comps).select(F.col("cd").alias("vid"), "src")
    known = heads.join(old.comps.select(F.col("vid").alias("src"), "comp"), "src", "left") if old.comps is not None \
        else heads.withColumn("comp", F.lit(None).cast("bigint"))
    known = materialize(known.select("vid", F.coalesce("comp", "src").alias("up"), F.col("comp").isNotNull().alias("many")).distinct(), "border")
    sets = [known.where("not many").groupBy("vid", bucket_of("up")).agg(bits_of("up").alias("bits")),
            known.join(old.above.words.select(F.col("vid").alias("up"), "bucket", "bits"), "up").select("vid", "bucket", "bits")]
    if old.comps is not None:
        sets.append(known.where("many").join(member_bits(old.comps).withColumnRenamed("comp", "up"), "up").select("vid", "bucket", "bits"))
    above, _ = ancestors(inside, peeled, comps, union_all(sets))
    counted = touched.join(impact(above.words, comps), "vid", "left").select("vid", F.coalesce("impact", F.lit(0)).alias("_new"))
    now = vertices.join(counted, "vid", "left").join(old.impacts, ["repo", "id"]) \
        .select("repo", "id", F.coalesce("_new", "impact").alias("impact"))
    if old.comps is not None:
        apart = attach(attach(old.comps, touched, ["vid"], "left_anti", n_touched), gone, ["vid"], "left_anti", n_gone)
        comps = apart if comps is None else apart.unionByName(comps)
        comps = materialize(comps, "components")
    return Recount(Graph(vertices, links), comps, materialize(now, "impact"), cycle_members(vertices, links, comps))


def impact_changes(old: DataFrame, new: DataFrame, n: int | None = None) -> DataFrame:
    """Impact of each remaining node before and after, largest change first."""
    both = (new.select("repo", F.col("id").alias("file"), F.col("impact").alias("new_impact"))
            .join(old.select("repo", F.col("id").alias("file"), F.col("impact").alias("old_impact")),
                  ["repo", "file"], "left")
            .withColumn("old_impact", F.coalesce("old_impact", F.lit(0))).where("old_impact <> new_impact")
            .withColumn("delta", F.col("new_impact") - F.col("old_impact")))
    rows = both.select("repo", "file", "old_impact", "new_impact", "delta")
    return rows if n is None else top_per_group(rows, ["repo"], [F.desc(F.abs("delta")), F.asc("file")], n)


def unreachable(graph: Graph) -> DataFrame:
    """Nodes that no root (a node nothing points to) reaches: repo, id."""
    roots = graph.vertices.join(graph.pairs.select(F.col("dst").alias("vid")), "vid", "left_anti")
    seen = reach_from(graph.pairs, roots.select(F.col("repo").alias("seed"), "vid"))
    return graph.vertices.join(seen.select("vid"), "vid", "left_anti").select("repo", "id")


def statistics(old_nodes: DataFrame, old_edges: DataFrame, change: Change, old_cycles: DataFrame,
               new: Recount, operation: str) -> DataFrame:
    """One row per repo of counts before and after."""
    def count(df: DataFrame, name: str, weight: bool = False) -> DataFrame:
        agg = F.sum("copies") if weight else F.count(F.lit(1))
        return df.groupBy("repo").agg(agg.alias(name))

    counted = new.graph.links.groupBy(F.col("src").alias("vid")).agg(F.sum("copies").alias("copies"))
    counted = counted.join(new.graph.vertices.select("vid", "repo"), "vid")
    pieces = [count(old_nodes, "original_node_count"), count(change.nodes, "new_node_count"),
              count(old_edges, "original_edge_count", True), count(counted, "new_edge_count", True),
              count(change.broken, "broken_import_count", True),
              count(newly_orphaned(old_edges, change, new.graph), "orphaned_count"),
              count(compare.only_in(old_cycles, new.cycles), "cycles_resolved"),
              count(compare.only_in(new.cycles, old_cycles), "cycles_introduced")]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.join(p, "repo", "left")
    return out.na.fill(0).withColumn("operation", F.lit(operation))


__all__ = ["Change", "Recount", "remove", "merge", "merge_targets", "propose_split", "split", "newly_orphaned",
           "recount", "recount_removal", "impact_changes", "unreachable", "statistics"]
