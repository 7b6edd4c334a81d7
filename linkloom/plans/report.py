"""Narrative report and insight export.

Fixed values: the titles and the wording of the sentences, which readers of the report know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import plural, round_half_even
from linkloom.operators import insights as N
from linkloom.operators.iterate import union_all
from linkloom.operators.metrics import top_coupling
from linkloom.operators.ranking import top_per_group
from linkloom.plans.build import Build
from linkloom.sources.exports import _constant, _rows


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _short_lists(nodes: DataFrame) -> DataFrame:
    """repo, and per report list the array of its at most five ``(rank, id, value)``."""
    tops = N.top_story_nodes(nodes)
    return tops.groupBy("repo").pivot("list", ["entry_points", "hubs", "depth", "risks"]).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "value"))))


def _ids(items: Column, start: int, n: int) -> Column:
    return F.array_join(F.transform(F.slice(items, start, n), lambda x: x["id"]), ", ")


def story(b: Build, coupling: DataFrame) -> DataFrame:
    """repo, step, step_type, title, narrative: the report's steps, those without content left out."""
    nodes = b.nodes
    facts = N.overview(nodes, b.reduced.arcs).withColumnRenamed("files", "total")
    lists = _short_lists(nodes)
    entries = nodes.groupBy("repo").agg(F.count_if(F.col("in_degree") == 0).alias("n_entries"))
    loops = b.cycles.select("repo", "cycle_id", "kind", "size", "member")
    loop_facts = loops.groupBy("repo").agg(
        F.countDistinct("cycle_id", "kind").alias("n_cycles"), F.countDistinct("member").alias("n_cycle_files"),
        F.max("size").alias("largest"))
    shown = top_per_group(loops.select("repo", "member").distinct(), ["repo"], [F.asc("member")], 4)
    loop_facts = loop_facts.join(shown.groupBy("repo").agg(F.array_join(
        F.sort_array(F.collect_list("member")), ", ").alias("sample")), "repo")
    tight = coupling.where("score > 0.1")
    tight_facts = tight.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_tight"),
        F.min_by(F.struct("dir1", "dir2", "cross_edges", "score"),
                 F.struct((-F.col("cross_edges")).alias("c"), "dir1", "dir2")).alias("tightest"))
    row = facts
    for side in (lists, entries, loop_facts, tight_facts):
        row = row.join(side, "repo", "left")
    hub_id, deep0, risk0 = F.get("hubs", F.lit(0)), F.get("depth", F.lit(0)), F.get("risks", F.lit(0))
    facts_of = nodes.select("repo", F.col("id").alias("_id"), "impact", "stability")
    row = row.withColumn("_hub", hub_id["id"]).withColumn("_risk", risk0["id"])
    row = (row.join(facts_of.select("repo", F.col("_id").alias("_hub"), F.col("impact").alias("hub_impact")),
                    ["repo", "_hub"], "left")
           .join(facts_of.select("repo", F.col("_id").alias("_risk"), F.col("impact").alias("risk_impact"),
                                 F.col("stability").alias("risk_stability")), ["repo", "_risk"], "left"))

    def have(col: str) -> Column:
        return F.coalesce(F.size(col), F.lit(0)) > 0

    n_entries, n_cycles = F.col("n_entries"), F.coalesce("n_cycles", F.lit(0))
    overview = _text("This project contains ", _s("total"), " source file", plural(F.col("total"), "", "s"),
                     " connected by ", _s("edges"), " dependency edge", plural(F.col("edges"), "", "s"),
                     ", spread across ", _s("directories"), " director", plural(F.col("directories"), "y", "ies"),
                     ". Let’s walk through the architecture.")
    entry = F.when(n_entries == 1, _text(
        "There is one entry point: ", F.get("entry_points", F.lit(0))["id"],
        ". This file is not imported by anything else — it’s where execution begins.")).otherwise(_text(
            "There are ", _s("n_entries"), " entry points (files with no inbound imports). The most connected are: ",
            _ids(F.col("entry_points"), 1, 3), ". These are the roots of the dependency tree — nothing imports them, "
            "but they pull in other modules."))
    hub_pct = round_half_even(F.col("hub_impact") / F.col("total") * 100, 0).cast("bigint").cast("string")
    hubs = _text("The most-imported file is ", F.col("_hub"), ", referenced by ", hub_id["value"].cast("bigint").cast("string"),
                 " other files. Changes here ripple out to ", _s("hub_impact"), " file", plural(F.col("hub_impact"), "", "s"),
                 " (", hub_pct, "% of the project). ",
                 F.when(F.size("hubs") > 1, _text("Other key hubs include: ", _ids(F.col("hubs"), 2, 2), ". ")).otherwise(F.lit("")),
                 "These are the load-bearing walls of your codebase — tread carefully.")
    others = F.array_join(F.transform(F.slice("depth", 2, 2), lambda x: _text(
        x["id"], " (depth ", x["value"].cast("bigint").cast("string"), ")")), ", ")
    deep = _text("The longest dependency chain is ", deep0["value"].cast("bigint").cast("string"), " levels deep, starting from ",
                 deep0["id"], ". Deep chains mean a change at the bottom can cascade through many layers. ",
                 F.when(F.size("depth") > 1, _text("Other deep files: ", others, ". ")).otherwise(F.lit("")),
                 "Consider whether these chains are intentional or accidental complexity.")
    cycles = F.when(n_cycles == 0, F.lit(
        "Good news — there are no circular dependency loops in this project. That’s a sign of clean, well-layered "
        "architecture.")).otherwise(_text(
            "There ", plural(n_cycles, "is", "are"), " ", _s("n_cycles"), " circular dependency loop", plural(n_cycles, "", "s"),
            " involving ", _s("n_cycle_files"), " file", plural(F.col("n_cycle_files"), "", "s"),
            ". Cycles make code harder to test, refactor, and reason about. ",
            F.when(n_cycles == 1, _text("The cycle includes: ", F.col("sample"), "."))
            .otherwise(_text("The largest cycle has ", _s("largest"), " files."))))
    risks = _text("The riskiest file is ", F.col("_risk"), " — it affects ", _s("risk_impact"),
                  " files but has a high instability score of ", _s("risk_stability"),
                  ". High-impact, unstable files are the most dangerous: they change often and break a lot when they do. ",
                  F.when(F.size("risks") > 1, _text("Other risky files: ", _ids(F.col("risks"), 2, 2), "."))
                  .otherwise(F.lit("Consider stabilizing this file by reducing its outbound dependencies.")))
    c = F.col("tightest")
    coupled = _text("The most coupled directories are ", c["dir1"], " and ", c["dir2"], ", sharing ",
                    c["cross_edges"].cast("string"), " cross-boundary edges (score: ", c["score"].cast("string"),
                    "). High coupling between directories can indicate unclear boundaries. ",
                    F.when(F.col("n_tight") > 1, _text("There are ", _s("n_tight"),
                                                       " directory pairs with notable coupling.")).otherwise(F.lit("")))
    advice = F.filter(F.array(
        F.when(n_cycles > 0, _text("Break ", _s("n_cycles"), " circular dependency loop", plural(n_cycles, "", "s"))),
        F.when(have("risks"), _text("Stabilize ", F.size("risks").cast("string"), " high-risk file",
                                    plural(F.size("risks"), "", "s"))),
        F.when(hub_id["value"] > F.col("total") * 0.3, _text("Consider splitting ", F.col("_hub"), " — it’s a god file")),
        F.when(F.col("n_tight") > 0, F.lit("Clarify directory boundaries to reduce coupling"))), lambda x: x.isNotNull())
    summary = _text("That’s the full picture. Key recommendations: ", F.when(F.size(advice) > 0, F.array_join(advice, "; "))
                    .otherwise(F.lit("Architecture looks healthy — keep it up!")), ".")
    steps = [(F.lit(True), "overview", F.lit("Project Overview"), overview),
             (n_entries > 0, "entry_points", F.lit("Entry Points"), entry),
             (have("hubs"), "hubs", F.lit("Critical Hubs"), hubs),
             (have("depth"), "depth", F.lit("Deepest Chains"), deep),
             (F.lit(True), "cycles", F.when(n_cycles == 0, F.lit("No Circular Dependencies"))
              .otherwise(F.lit("Circular Dependencies")), cycles),
             (have("risks"), "risks", F.lit("Stability Risks"), risks),
             (F.col("n_tight") > 0, "coupling", F.lit("Directory Coupling"), coupled),
             (F.lit(True), "summary", F.lit("Summary"), summary)]
    built = F.filter(F.array(*[F.when(keep, F.struct(F.lit(kind).alias("step_type"), title.alias("title"),
                                                     text.alias("narrative"))) for keep, kind, title, text in steps]),
                     lambda x: x.isNotNull())
    return (row.select("repo", F.posexplode(built).alias("step", "s"))
            .select("repo", (F.col("step") + 1).alias("step"), "s.*"))


def story_highlights(b: Build) -> DataFrame:
    """repo, step_type, id: the nodes each step points at, one row each."""
    lists = N.top_story_nodes(b.nodes).select("repo", F.col("list").alias("step_type"), "id")
    loops = b.cycles.select("repo", F.lit("cycles").alias("step_type"), F.col("member").alias("id")).distinct()
    return lists.unionByName(loops)


def insight_lines(b: Build, coupling: DataFrame) -> DataFrame:
    """Findings as Markdown lines; see ``sources.exports`` for the columns."""
    nodes = b.nodes
    repos = nodes.select("repo").distinct()
    facts = (N.health_score(nodes, b.cycles, coupling).select("repo", "score")
             .join(N.overview(nodes, b.reduced.arcs), "repo"))

    def item(df: DataFrame, section: int, rank: Column, *text) -> DataFrame:
        line = _text("- `", F.col("id"), "`", *text)
        return _rows(df, section, line, key=F.concat(F.lpad((F.lit(10 ** 12) - rank).cast("string"), 13, "0"), F.col("id")))

    def titled(section: int, title: str, df: DataFrame, rows: DataFrame) -> list[DataFrame]:
        present = df.select("repo").distinct()
        return [_constant(present, section, [f"## {title}", ""]),
                rows.withColumn("ord", F.lit(2)), _rows(present, section, F.lit(""), ord_=3)]

    zero = F.lit(0)
    loops = b.cycles.select("repo", F.col("member").alias("id")).distinct()
    god, hubs, core = N.god_files(nodes), N.hubs(nodes, 10), N.unstable_core(nodes, 10)
    impact, fan, deep = N.high_impact(nodes, 10), N.high_fan_out(nodes, 10), N.deep_files(nodes, 10)
    # The printed list is the feature that is cut, after the counts are made.
    tight = top_coupling(coupling.where("score > 0.1")).withColumn("id", F.col("dir1"))
    unused = nodes.where("in_degree = 0").select("repo", "id")
    head = [_constant(repos, 0, ["# Project Insights", ""]),
            _rows(facts, 1, _text("**Health Score: ", _s("score"), "/100**")), _rows(facts, 1, F.lit(""), ord_=1),
            _rows(facts, 1, F.lit("| Metric | Value |"), ord_=2), _rows(facts, 1, F.lit("|--------|-------|"), ord_=3),
            _rows(facts, 1, _text("| Files | ", _s("files"), " |"), ord_=4),
            _rows(facts, 1, _text("| Dependencies | ", _s("edges"), " |"), ord_=5),
            _rows(facts, 1, _text("| Directories | ", _s("directories"), " |"), ord_=6),
            _rows(facts, 1, _text("| Density | ", _s("density"), "% |"), ord_=7), _rows(facts, 1, F.lit(""), ord_=8)]
    n_loops = b.cycles.groupBy("repo").agg(F.countDistinct("cycle_id", "kind").alias("n"), F.countDistinct("member").alias("m"))
    counted = _text(_s("n"), " cycle(s) involving ", _s("m"), " files:")
    files = item(loops, 2, zero)
    body = (titled(2, "Circular Dependencies", loops, union_all([
        files, _rows(n_loops, 2, counted, key=F.lit("")), _rows(n_loops, 2, F.lit(""), key=F.lit(" "))]))
            + titled(3, "God Files", god, item(god, 3, F.col("inbound"), " — ", _s("inbound"), " inbound refs"))
            + titled(4, "Hub Files", hubs, item(hubs, 4, F.col("total"), " — in:", _s("inbound"), " out:", _s("outbound")))
            + titled(5, "Unstable Core Files", core, item(core, 5, F.col("inbound"), " — instability=", _s("stability"), ", ",
                                                          _s("inbound"), " refs"))
            + titled(6, "Directory Coupling", tight, item(tight, 6, F.col("cross_edges"), " ↔ `", F.col("dir2"), "` — ",
                                                          _s("cross_edges"), " edges, score=", _s("score")))
            + titled(7, "High-Impact Files", impact, item(impact, 7, F.col("impact"), " — affects ", _s("impact"), " files (",
                                                          _s("pct"), "%)"))
            + titled(8, "High Fan-Out", fan, item(fan, 8, F.col("outbound"), " — ", _s("outbound"), " imports"))
            + titled(9, "Deep Dependency Chains", deep, item(deep, 9, F.col("depth"), " — depth ", _s("depth")))
            + titled(10, "Unused Files", unused, item(unused, 10, zero)))
    return union_all(head + body)
