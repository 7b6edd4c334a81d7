"""The graph as two tables: ``vertices`` and ``links``; ``arcs`` are links with the names of their ends.

Vertex numbers follow the order of ``(repo, id)``, so the smallest number among candidates is
also the alphabetically first id: every tie in the iterative operators is broken on a BIGINT.
Numbers are unique across repositories, so loops carry no ``repo`` column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.store import attach, materialize, write_table


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # repo, id, vid
    links: DataFrame     # src, dst, copies (distinct pairs; copies >= 1)

    @property
    def pairs(self) -> DataFrame:
        """Distinct arcs by number: src, dst."""
        return self.links.select("src", "dst")

    @cached_property
    def arcs(self) -> DataFrame:
        """repo, source, target, src, dst, copies: named when first asked for, since most of the work is on numbers."""
        return materialize(named(self.links, self.vertices), "arcs")


def named(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """``links(src, dst, …)``, a stored table, with repo, source and target."""
    rows = vertices.count()
    src = vertices.select("repo", F.col("id").alias("source"), F.col("vid").alias("src"))
    dst = vertices.select(F.col("id").alias("target"), F.col("vid").alias("dst"))
    out = attach(attach(links, dst, ["dst"], "inner", rows), src, ["src"], "inner", rows, links)
    return out.select("repo", "source", "target", *links.columns)


def graph_from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """Build a graph from an edge bag ``(repo, source, target)`` and optional ``(repo, id)``."""
    return graph_from_arcs(edges.select("repo", "source", "target", F.lit(1).cast("bigint").alias("copies")), nodes)


def graph_from_arcs(arcs: DataFrame, nodes: DataFrame | None = None, closed: bool = False) -> Graph:
    """Build a graph from ``(repo, source, target, copies)``; arcs named twice are folded. Where ``closed``, only arcs
    between ``nodes`` count.

    Names are long and there are many more arcs than vertices, so arcs are folded and numbered by two hashes of each
    name. The first is the key; should two names share it, which the second tells, all is done by names.
    """
    bag = materialize(arcs.select("repo", "source", "target", "copies"), "bag")
    ends = [bag.select(_key(end).alias("key"), _key(end, 1).alias("proof")).distinct() for end in ("source", "target")]
    given = nodes
    if given is None:
        given = bag.select("repo", F.explode(F.array("source", "target")).alias("id"))
    given = materialize(given.select("repo", "id").distinct().select("repo", "id", _key("id").alias("key"), _key("id", 1).alias("proof")), "given")
    other, others = write_table(ends[0].unionByName(ends[1]).distinct().join(given, ["key", "proof"], "left_anti"), "other")
    clash = given.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if others:
        clash = clash.select("key").unionByName(other.join(given, "key", "left_semi").select("key"))
        if not closed:
            clash = clash.unionByName(other.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"))
    if clash.limit(1).count():
        return _by_names(bag, given, closed)
    rows = given.select("repo", "id", "key")
    if others and not closed:
        far = bag.select("repo", F.explode(F.array("source", "target")).alias("id")).withColumn("key", _key("id"))
        rows = rows.unionByName(attach(far, other.select("key"), ["key"], "left_semi", others).distinct())
    vertices, n = write_table(rows.orderBy("repo", "id").withColumn("vid", F.monotonically_increasing_id()), "vertices")
    whole = bag.where("repo is not null and source is not null and target is not null")
    folded = materialize(whole.groupBy(_key("source").alias("source"), _key("target").alias("target"))
                         .agg(F.sum("copies").alias("copies")), "folded")
    links = _numbered(folded, vertices, [], "key", n).select("src", "dst", "copies")
    return Graph(vertices.select("repo", "id", "vid"), materialize(links, "links"))


def _key(name: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), "repo", name)


def _by_names(bag: DataFrame, given: DataFrame, closed: bool) -> Graph:
    ends = given.select("repo", "id")
    if not closed:
        ends = ends.unionByName(bag.select("repo", F.explode(F.array("source", "target")).alias("id"))).distinct()
    vertices = materialize(ends.orderBy("repo", "id").withColumn("vid", F.monotonically_increasing_id()), "vertices")
    folded = materialize(bag.groupBy("repo", "source", "target").agg(F.sum("copies").alias("copies")), "folded")
    links = _numbered(folded, vertices, ["repo"], "id", vertices.count()).select("src", "dst", "copies")
    return Graph(vertices, materialize(links, "links"))


def _numbered(folded: DataFrame, vertices: DataFrame, on: list[str], by: str, rows: int) -> DataFrame:
    """Add ``src`` and ``dst`` numbers to a stored table ``(source, target, …)``, whose ends are in column ``by``."""
    src = vertices.select(*on, F.col(by).alias("source"), F.col("vid").alias("src"))
    dst = vertices.select(*on, F.col(by).alias("target"), F.col("vid").alias("dst"))
    out = attach(folded, dst, [*on, "target"], "inner", rows)
    return attach(out, src, [*on, "source"], "inner", rows, folded)


def names(df: DataFrame, vertices: DataFrame, **columns: str) -> DataFrame:
    """Replace vertex numbers by ids: ``names(df, vertices, a="source", b="target")``."""
    rows = vertices.count()
    for number, name in columns.items():
        side = vertices.select(F.col("vid").alias(number), F.col("id").alias(name))
        df = attach(df, side, [number], "left", rows).drop(number)
    return df


def edge_bag(arcs: DataFrame) -> DataFrame:
    """One row per edge, repeated edges included."""
    return arcs.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")) \
               .drop("_copy", "copies")
