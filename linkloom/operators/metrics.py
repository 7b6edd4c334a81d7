"""Node, edge and directory metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import paths, scalars
from linkloom.functions.languages import language_of
from linkloom.operators.ranking import top_per_group
from linkloom.store import attach, write_table


def in_degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("dst").alias("vid")).agg(F.sum("copies").alias("in_degree"))


def out_degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("vid")).agg(F.sum("copies").alias("out_degree"))


def impact(words: DataFrame, comps: DataFrame | None) -> DataFrame:
    """vid, impact: how many other vertices reach the vertex.

    ``words`` are those of ``iterate.ancestor_sets`` between components. A vertex is reached by the members of every
    component above its own and by its fellow members.
    """
    above = words.groupBy("vid").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("impact"))
    if comps is None:
        return above
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    above = above.withColumnRenamed("vid", "comp")
    alone = above.join(sizes, "comp", "left_anti").select(F.col("comp").alias("vid"), "impact")
    inside, groups = write_table(sizes.join(above, "comp", "left").select(
        "comp", (F.coalesce("impact", F.lit(0)) + F.col("members") - 1).alias("impact")), "impact")
    return alone.unionByName(attach(comps, inside, ["comp"], "inner", groups).select("vid", "impact"))


def node_metrics(vertices: DataFrame, arcs: DataFrame, impacts: DataFrame, depths: DataFrame,
                 comps: DataFrame | None) -> DataFrame:
    """Everything about a node that does not depend on display filters."""
    out = (vertices.join(in_degrees(arcs), "vid", "left").join(out_degrees(arcs), "vid", "left")
           .join(impacts, "vid", "left").join(depths, "vid", "left"))
    if comps is not None:
        out = out.join(comps.select("vid", F.lit(True).alias("in_cycle")), "vid", "left")
    else:
        out = out.withColumn("in_cycle", F.lit(False))

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    out = out.select("repo", "id", "vid", number("in_degree"), number("out_degree"), number("depth"),
                     number("impact"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    return out.select(
        "*", paths.directory("id").alias("dir"), language_of("id").alias("language"),
        scalars.instability(F.col("in_degree"), F.col("out_degree")).alias("stability"),
        scalars.node_size(F.col("in_degree")).alias("size"), paths.dir_color("id").alias("dir_color"))


def reach_pct(impact_: Column, total: Column) -> Column:
    return scalars.round_half_even(impact_ / total * 100, 1)


def coupling(arcs: DataFrame) -> DataFrame:
    """repo, dir1, dir2, cross_edges, score for every pair of directories with edges between them."""
    sides = arcs.select("repo", paths.directory("source").alias("d1"), paths.directory("target").alias("d2"),
                        "copies").groupBy("repo", "d1", "d2").agg(F.sum("copies").alias("copies"))
    touches = (sides.select("repo", F.explode(F.array("d1", "d2")).alias("dir"), "copies")
               .groupBy("repo", "dir").agg(F.sum("copies").alias("touches")))
    cross = (sides.where("d1 <> d2")
             .groupBy("repo", F.least("d1", "d2").alias("dir1"), F.greatest("d1", "d2").alias("dir2"))
             .agg(F.sum("copies").alias("cross_edges")))
    t1 = touches.select("repo", F.col("dir").alias("dir1"), F.col("touches").alias("t1"))
    t2 = touches.select("repo", F.col("dir").alias("dir2"), F.col("touches").alias("t2"))
    return (cross.join(t1, ["repo", "dir1"]).join(t2, ["repo", "dir2"])
            .select("repo", "dir1", "dir2", "cross_edges",
                    scalars.round_half_even(F.col("cross_edges") / (F.col("t1") + F.col("t2")), 3).alias("score")))


def top_coupling(pairs: DataFrame, n: int = 20) -> DataFrame:
    return top_per_group(pairs, ["repo"], [F.desc("cross_edges"), F.asc("dir1"), F.asc("dir2")], n)


def depth_warnings(nodes: DataFrame, reach_warn: float = 30, reach_crit: float = 50,
                   depth_warn: int = 5, depth_crit: int = 8) -> DataFrame:
    """Nodes with a wide reach or a deep chain, with severity and reasons.

    A warning threshold at or above its critical one is lowered to just below it.
    """
    reach_warn = reach_warn if reach_warn < reach_crit else max(reach_crit - 1, 0)
    depth_warn = depth_warn if depth_warn < depth_crit else max(depth_crit - 1, 0)
    r, d = F.col("reach_pct"), F.col("depth")
    severity = (F.when((r >= reach_crit) | (d >= depth_crit), F.lit("critical"))
                .when((r >= reach_warn) | (d >= depth_warn), F.lit("warning")))
    reasons = F.filter(F.array(
        F.when(r >= reach_warn, F.concat(F.lit("pulls in "), r.cast("string"), F.lit("% of codebase"))),
        F.when(d >= depth_warn, F.concat(F.lit("dependency chain "), d.cast("string"), F.lit(" levels deep")))),
        lambda x: x.isNotNull())
    return (nodes.select("repo", F.col("id").alias("file"), severity.alias("severity"), "depth", "impact",
                         "reach_pct", reasons.alias("reasons")).where("severity is not null"))


def warning_order() -> list[Column]:
    return [F.when(F.col("severity") == "critical", 0).otherwise(1).asc(), F.desc("reach_pct"), F.asc("file")]


def display_nodes(metrics: DataFrame, arcs: DataFrame, hide_isolated: bool = False,
                  filter_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """Filtered nodes with reach and risk, and the node count per repo they rest on."""
    kept = metrics
    if hide_isolated:
        ends = arcs.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        kept = kept.join(ends, "vid", "left_semi")
    if filter_dir:
        kept = kept.where(F.col("id").startswith(filter_dir))
    totals = kept.groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes"))
    sized = attach(kept, totals, ["repo"], "inner")
    sized = sized.withColumn("reach_pct", reach_pct(F.col("impact"), F.col("n_nodes")))
    risk = scalars.risk_class(F.col("id"), F.col("in_degree"), F.col("out_degree"), F.col("in_cycle"),
                              F.col("reach_pct"), F.col("n_nodes"))
    return sized.withColumn("risk", risk).drop("n_nodes"), totals


def display_edges(arcs: DataFrame, comps: DataFrame | None, nodes: DataFrame, metrics: DataFrame,
                  filtered: bool = False) -> DataFrame:
    """src, dst, copies with cycle flag and weight; with a directory filter only edges between kept nodes."""
    if filtered:
        kept = nodes.select("vid")
        rows = kept.count()
        arcs = attach(attach(arcs, kept.withColumnRenamed("vid", "src"), ["src"], "left_semi", rows),
                      kept.withColumnRenamed("vid", "dst"), ["dst"], "left_semi", rows)
    facts = metrics.select(F.col("vid").alias("dst"), "repo", F.col("in_degree").alias("_in")) \
        .join(nodes.select(F.col("vid").alias("dst"), F.col("reach_pct").alias("_reach")), "dst", "left")
    out = attach(arcs, facts, ["dst"], "left", metrics.count())
    top = metrics.groupBy("repo").agg(F.max("in_degree").alias("_max"))
    out = attach(out, top, ["repo"], "inner")
    weight = scalars.edge_weight(F.coalesce("_in", F.lit(0)), F.col("_max"), F.coalesce("_reach", F.lit(0.0)))
    if comps is None:
        cyclic = F.col("src") == F.col("dst")
    else:
        rows = comps.count()
        out = attach(out, comps.select(F.col("vid").alias("src"), F.col("comp").alias("_s")), ["src"], "left", rows, arcs)
        out = attach(out, comps.select(F.col("vid").alias("dst"), F.col("comp").alias("_d")), ["dst"], "left", rows, arcs)
        cyclic = F.coalesce((F.col("src") == F.col("dst")) | (F.col("_s") == F.col("_d")), F.lit(False))
    return out.select("src", "dst", "copies", cyclic.alias("is_cycle"),
                      weight.alias("weight"))


def cycle_members(vertices: DataFrame, arcs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """repo, cycle_id, member, size: one row per member; a self-loop is a cycle of its own.

    Rows rather than arrays, since one component may hold most of a graph.
    """
    loops = arcs.where("src = dst").select(F.col("src").alias("comp"), F.col("src").alias("vid"),
                                           F.lit("loop").alias("kind"))
    groups = loops
    if comps is not None:
        groups = comps.select("comp", "vid", F.lit("group").alias("kind")).unionByName(loops)
    sizes = groups.groupBy("comp", "kind").agg(F.count(F.lit(1)).alias("size"))
    labelled = groups.join(sizes, ["comp", "kind"])
    names = vertices.select("vid", "repo", F.col("id").alias("member"))
    heads = vertices.select(F.col("vid").alias("comp"), F.col("id").alias("cycle_id"))
    return (labelled.join(names, "vid").join(heads, "comp")
            .select("repo", "cycle_id", "kind", "member", "size"))
