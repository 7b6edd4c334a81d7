"""Project-level findings on top of the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import RISK_ORDER, risk_rank, round_half_up, search_score
from linkloom.operators.predicates import search
from linkloom.operators.ranking import top_per_group
from linkloom.store import attach


def _per_repo(nodes: DataFrame, *aggs: Column) -> DataFrame:
    return nodes.groupBy("repo").agg(*aggs)


def overview(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """repo, files, edges, directories, density (percent of all ordered pairs, 1 dp)."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("dir").alias("directories"))
    e = arcs.groupBy("repo").agg(F.sum("copies").alias("edges"))
    both = n.join(e, "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    room = F.col("files") * (F.col("files") - 1)
    density = F.when(room > 0, round_half_up(F.col("edges") / room * 100, 1)).otherwise(F.lit(0.0))
    return both.select("repo", "files", "edges", "directories", density.alias("density"))


def god_files(nodes: DataFrame) -> DataFrame:
    """Inbound of at least 10 and at least half the largest inbound."""
    top = _per_repo(nodes, F.max("in_degree").alias("_top"))
    return (attach(nodes, top, ["repo"], "inner")
            .where(F.col("in_degree") >= F.greatest(F.lit(10.0), F.col("_top") * 0.5))
            .select("repo", "id", F.col("in_degree").alias("inbound")))


def high_fan_out(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Outbound of at least 8 and at least 0.4 of the largest outbound."""
    top = _per_repo(nodes, F.max("out_degree").alias("_top"))
    hit = (attach(nodes, top, ["repo"], "inner")
           .where(F.col("out_degree") >= F.greatest(F.lit(8.0), F.col("_top") * 0.4))
           .select("repo", "id", F.col("out_degree").alias("outbound")))
    return hit if n is None else top_per_group(hit, ["repo"], [F.desc("outbound"), F.asc("id")], n)


def hubs(nodes: DataFrame, n: int | None = None, at_least: int = 5) -> DataFrame:
    hit = (nodes.where((F.col("in_degree") >= at_least) & (F.col("out_degree") >= at_least))
           .select("repo", "id", F.col("in_degree").alias("inbound"), F.col("out_degree").alias("outbound"),
                   (F.col("in_degree") + F.col("out_degree")).alias("total")))
    return hit if n is None else top_per_group(hit, ["repo"], [F.desc("total"), F.asc("id")], n)


def deep_files(nodes: DataFrame, n: int | None = None, at_least: int = 5) -> DataFrame:
    hit = nodes.where(F.col("depth") >= at_least).select("repo", "id", "depth")
    return hit if n is None else top_per_group(hit, ["repo"], [F.desc("depth"), F.asc("id")], n)


def high_impact(nodes: DataFrame, n: int | None = None, at_least: int = 5) -> DataFrame:
    total = _per_repo(nodes, F.count(F.lit(1)).alias("_n"))
    hit = (attach(nodes.where(F.col("impact") >= at_least), total, ["repo"], "inner")
           .select("repo", "id", "impact", round_half_up(F.col("impact") / F.col("_n") * 100, 1).alias("pct")))
    return hit if n is None else top_per_group(hit, ["repo"], [F.desc("impact"), F.asc("id")], n)


def unstable_core(nodes: DataFrame, n: int | None = None, above: float = 0.7, inbound: int = 3) -> DataFrame:
    hit = (nodes.where((F.col("stability") > above) & (F.col("in_degree") >= inbound))
           .select("repo", "id", "stability", F.col("in_degree").alias("inbound")))
    return hit if n is None else top_per_group(hit, ["repo"], [F.desc("inbound"), F.asc("id")], n)


def tight_coupling(coupling: DataFrame, above: float) -> DataFrame:
    return coupling.where(F.col("score") > above)


def health_score(nodes: DataFrame, cycles: DataFrame, coupling: DataFrame) -> DataFrame:
    """repo, score in 0..100 and the counts it is made of.

    Node findings are counted in one pass with the two per-repo maxima joined in; ``coupling``
    holds all pairs, so a small but tight one counts as well.
    """
    tops = _per_repo(nodes, F.max("in_degree").alias("_in"))
    c = F.count_if
    marked = attach(nodes, tops, ["repo"], "inner")
    counts = marked.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"),
        c(F.col("in_degree") >= F.greatest(F.lit(10.0), F.col("_in") * 0.5)).alias("god"),
        c(F.col("in_degree") == 0).alias("unused"),
        c((F.col("stability") > 0.7) & (F.col("in_degree") >= 3)).alias("unstable"),
        c(F.col("depth") >= 5).alias("deep"),
        c((F.col("in_degree") >= 5) & (F.col("out_degree") >= 5)).alias("hubs"))
    loops = cycles.groupBy("repo").agg(F.countDistinct("cycle_id", "kind").alias("cycles"))
    tight = coupling.where("score > 0.3").groupBy("repo").agg(F.count(F.lit(1)).alias("coupled"))
    all_ = (counts.join(loops, "repo", "left").join(tight, "repo", "left")
            .na.fill(0, ["cycles", "coupled"]))
    unused = F.floor(F.col("unused") / F.col("n") * 30 + 0.5)
    cost = (F.least(F.lit(30), F.col("cycles") * 10) + F.least(F.lit(15), F.col("god") * 5)
            + F.least(F.lit(15), F.col("coupled") * 5) + F.least(F.lit(10), unused)
            + F.least(F.lit(10), F.col("unstable") * 3) + F.least(F.lit(10), F.col("deep") * 2)
            + F.least(F.lit(10), F.col("hubs") * 3))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - cost)).cast("bigint")
    return all_.select("repo", score.alias("score"), "cycles", "god", "coupled", "unused", "unstable", "deep", "hubs")


def risk_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """One column per risk class."""
    return nodes.groupBy(*by).agg(*[F.count_if(F.col("risk") == r).alias(r) for r in RISK_ORDER])


def warning_summary(warnings: DataFrame) -> DataFrame:
    """repo, critical, warning, worst: counts and the file at the top of the warning order."""
    worst = F.min_by("file", F.struct(F.when(F.col("severity") == "critical", 0).otherwise(1).alias("s"),
                                      (-F.col("reach_pct")).alias("r"), F.col("file")))
    return warnings.groupBy("repo").agg(F.count_if(F.col("severity") == "critical").alias("critical"),
                                        F.count_if(F.col("severity") == "warning").alias("warning"),
                                        worst.alias("worst"))


def directory_references(nodes: DataFrame) -> DataFrame:
    """Per directory: files and sum of inbound references, most referenced first."""
    return (nodes.groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("files"), F.sum("in_degree").alias("refs"))
            .orderBy("repo", F.desc("refs"), F.asc("dir")))


def directory_legend(nodes: DataFrame) -> DataFrame:
    return (nodes.groupBy("repo", "dir").agg(F.min("dir_color").alias("color"), F.count(F.lit(1)).alias("files"))
            .orderBy("repo", "dir"))


def language_counts(nodes: DataFrame) -> DataFrame:
    return (nodes.where("language is not null").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))
            .orderBy("repo", F.desc("files"), F.asc("language")))


def by_risk(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(risk_rank(F.col("risk")), F.desc("impact"), F.asc("id"))


def diagnostics(nodes: DataFrame, cycles: DataFrame, max_depth: int = 8) -> DataFrame:
    """repo, file, code, severity for cycle members, deep chains and wide reach."""
    loops = cycles.select("repo", F.col("member").alias("file"), F.lit("cycle").alias("code"),
                          F.lit("warning").alias("severity"))
    deep = nodes.where(F.col("depth") > max_depth).select(
        "repo", F.col("id").alias("file"), F.lit("depth").alias("code"), F.lit("information").alias("severity"))
    wide = nodes.where(F.col("reach_pct") > 50).select(
        "repo", F.col("id").alias("file"), F.lit("high-impact").alias("code"), F.lit("hint").alias("severity"))
    return loops.unionByName(deep).unionByName(wide)


def top_story_nodes(nodes: DataFrame, n: int = 5) -> DataFrame:
    """The report's short lists: entry points, hubs, deepest, risky; repo, list, rank, id, value."""
    def pick(name: str, keep: Column, value: Column) -> DataFrame:
        rows = nodes.where(keep).select("repo", "id", value.cast("double").alias("value"))
        return (top_per_group(rows, ["repo"], [F.desc("value"), F.asc("id")], n, rank="rank")
                .select("repo", F.lit(name).alias("list"), "rank", "id", "value"))

    return (pick("entry_points", F.col("in_degree") == 0, F.col("out_degree"))
            .unionByName(pick("hubs", F.col("in_degree") >= 3, F.col("in_degree")))
            .unionByName(pick("depth", F.col("depth") >= 2, F.col("depth")))
            .unionByName(pick("risks", (F.col("impact") >= 2) & (F.col("stability") > 0.6),
                              F.col("impact") * F.col("stability"))))


def quick_jump(nodes: DataFrame, needle: str, n: int = 15) -> DataFrame:
    return (search(nodes, needle).select("repo", "id", search_score(F.col("id"), needle).alias("score"), "in_degree")
            .orderBy(F.desc("score"), F.desc("in_degree"), F.asc("id")).limit(n))
