"""The graph build: reduction, cycles, depth, impact, then the node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import metrics as M
from linkloom.operators.graph import Graph, named
from linkloom.operators.iterate import (
    MOST_ROUNDS, Ancestors, Peel, TooDeep, ancestor_sets, component_arcs, components, condense, peel, redundant_arcs,
    redundant_between_components,
)
from linkloom.operators.weak import small_pieces, solve
from linkloom.store import BROADCAST_ROWS, attach, materialize, write_table


@dataclass(frozen=True)
class Build:
    graph: Graph                 # as given
    reduced: Graph               # after reduction, on the same vertices
    comps: DataFrame | None      # vid, comp of the reduced graph
    above: Ancestors             # what reaches each component of the reduced graph
    metrics: DataFrame           # per node, independent of display filters
    nodes: DataFrame             # metrics + reach_pct, risk
    hide_isolated: bool = False
    filter_dir: str = ""

    @cached_property
    def links(self) -> DataFrame:
        """Reduced arcs that are shown: src, dst, copies, is_cycle, weight."""
        return materialize(M.display_edges(self.reduced.links, self.comps, self.nodes, self.metrics, bool(self.filter_dir)), "links")

    @cached_property
    def edges(self) -> DataFrame:
        """``links`` with repo, source and target: many times the nodes, so worked out when first asked for."""
        return materialize(named(self.links, self.reduced.vertices), "edges")

    @property
    def cycles(self) -> DataFrame:
        return M.cycle_members(self.reduced.vertices, self.reduced.links, self.comps)

    @property
    def unused(self) -> DataFrame:
        return self.metrics.where("in_degree = 0").select("repo", "id")

    @property
    def coupling(self) -> DataFrame:
        """All coupled pairs; ``metrics.top_coupling`` cuts them to the reported ones."""
        return M.coupling(self.reduced.arcs)

    @property
    def warnings(self) -> DataFrame:
        return M.depth_warnings(self.nodes)


@dataclass(frozen=True)
class Pieces:
    """Takes the place of a ``Peel`` where a graph is deep: its small weak components, and a peel of all else."""
    small: DataFrame   # vid, piece
    inside: DataFrame  # src, dst: arcs of small weak components
    solved: DataFrame  # what ``weak.solve`` made of these
    rest: DataFrame    # src, dst: the other arcs
    peeled: Peel       # of the other arcs
    comps: DataFrame | None  # of the other arcs
    acyclic: bool


def find_components(pairs: DataFrame, small: DataFrame | None = None) -> tuple[Peel | Pieces, DataFrame | None]:
    """Peel the arcs; solve components only for what is left over a cycle.

    Where that takes many rounds, the graph is cut into weak components, and those of bounded size are solved in one
    task each. ``small(vid, piece)`` names these where they are known from a graph with more arcs.
    """
    if small is None:
        peeled = peel(pairs, contract=False)
        try:
            if peeled.open:
                raise TooDeep
            comps = None if peeled.acyclic else components(pairs, peeled.leftover, MOST_ROUNDS)
            return peeled, None if comps is None else materialize(comps, "components")
        except TooDeep:
            small = small_pieces(pairs)
    n = small.count()
    ends = small.select(F.col("vid").alias("src"))
    inside = materialize(attach(pairs, ends, ["src"], "left_semi", n).select("src", "dst"), "inside")
    rest, left = write_table(attach(pairs, ends, ["src"], "left_anti", n).select("src", "dst"), "rest")
    solved = solve(inside, small)
    peeled = peel(rest)
    apart = None if peeled.acyclic else components(rest, peeled.leftover)
    apart = None if apart is None else materialize(apart, "components")
    comps, members = write_table(solved.where("kind = 'c'").select(F.col("a").alias("vid"), F.col("b").alias("comp")), "components")
    if apart is not None:
        comps, members = write_table(comps.unionByName(apart), "components")
    looped = inside.where("src = dst").limit(1).count()
    return Pieces(small, inside, solved, rest, peeled, apart, peeled.acyclic and not members and not looped), comps if members else None


def ancestors(pairs: DataFrame, peeled: Peel | Pieces, comps: DataFrame | None,
              known: DataFrame | None = None) -> tuple[Ancestors, DataFrame]:
    """What reaches each component of a graph (and ``known`` above it, see ``ancestor_sets``), and the levels of these."""
    if isinstance(peeled, Pieces):
        solved, other = peeled.solved, None
        if known is not None:
            known = materialize(known, "known")
            solved = solve(peeled.inside, peeled.small, known)
            other = attach(known, peeled.small.select("vid"), ["vid"], "left_anti")
        rest, levels = ancestors(peeled.rest, peeled.peeled, peeled.comps, other)
        sets = solved.where("kind = 's'").select(F.col("a").alias("vid"), F.col("b").alias("bucket"), "bits", "far")
        arcs = solved.where("kind = 'd'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("x").alias("sl"), F.col("y").alias("tl"))
        here = solved.where("kind = 'l'").select(F.col("a").alias("vid"), F.col("x").alias("level"))
        return Ancestors(rest.words.unionByName(sets), rest.arcs.unionByName(arcs)), levels.unionByName(here)
    dag = pairs if peeled.acyclic else materialize(condense(pairs, comps), "condensed")
    levels = materialize((peeled if peeled.acyclic else peel(dag)).levels, "levels")
    return ancestor_sets(dag, levels, comps, known), levels


def reduce_graph(graph: Graph, mode: str | None = "exact"):
    """The graph without redundant arcs, plus what was learned about the input on the way."""
    pairs = graph.pairs
    peeled, comps = find_components(pairs)
    above, levels = ancestors(pairs, peeled, comps)
    if mode is None:
        return graph, peeled, comps, above, levels
    bypassed = above.bypassed()
    if peeled.acyclic:
        gone = bypassed
    elif mode == "exact":
        gone = redundant_arcs(pairs, comps, bypassed)
    elif mode == "condensed":
        gone = redundant_between_components(pairs, comps, bypassed)
    else:
        raise ValueError(f"unknown reduction mode: {mode}")
    gone, n = write_table(gone, "gone")
    kept = graph.links.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, ["src", "dst"], "left_anti")
    return Graph(graph.vertices, materialize(kept.select(graph.links.columns), "reduced")), peeled, comps, above, levels


def member_levels(levels: DataFrame, comps: DataFrame | None) -> DataFrame:
    """vid, depth from the levels of the component graph: members share that of their component."""
    if comps is None:
        return levels.withColumnRenamed("level", "depth")
    inner = comps.join(levels.withColumnRenamed("vid", "comp"), "comp").select("vid", "level")
    outer = levels.join(comps.select(F.col("comp").alias("vid")).distinct(), "vid", "left_anti")
    return inner.unionByName(outer).withColumnRenamed("level", "depth")


def build(graph: Graph, reduce: str | None = "exact", hide_isolated: bool = False,
          filter_dir: str = "") -> Build:
    reduced, peeled, comps, above, levels = reduce_graph(graph, reduce)
    if reduce == "exact" and comps is not None:
        # The exact rule may open cycles. What remains of them lies inside the old components.
        pairs = reduced.pairs
        if isinstance(peeled, Pieces):
            peeled, comps = find_components(pairs, peeled.small)
        else:
            inside = component_arcs(pairs, comps).where("cs = cd").select("src", "dst")
            comps = components(pairs, materialize(inside, "inside"))
            comps = None if comps is None else materialize(comps, "components")
        above, levels = ancestors(pairs, peeled, comps)
    # On an acyclic graph, and between whole components, reduction keeps reachability and longest chains.
    table = materialize(
        M.node_metrics(reduced.vertices, reduced.links, M.impact(above.words, comps), member_levels(levels, comps), comps),
        "metrics")
    out = Build(graph, reduced, comps, above, table, table)
    return display(out, hide_isolated, filter_dir)


def display(b: Build, hide_isolated: bool = False, filter_dir: str = "") -> Build:
    """The same build seen through display filters: reach, risk and weight follow the kept nodes."""
    nodes, _ = M.display_nodes(b.metrics, b.reduced.links, hide_isolated, filter_dir)
    return Build(b.graph, b.reduced, b.comps, b.above, b.metrics, materialize(nodes, "nodes"), hide_isolated, filter_dir)


__all__ = ["Build", "Pieces", "ancestors", "build", "display", "reduce_graph", "find_components"]
