"""Layer checks and dependency rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.paths import layer_of
from linkloom.functions.scalars import rank_name
from linkloom.operators.ranking import top_per_group
from linkloom.store import attach


def layer_violations(edges: DataFrame, layers: list[str]) -> DataFrame:
    """Edges whose target lies in an earlier layer than their source."""
    placed = edges.withColumn("_s", layer_of("source", layers)).withColumn("_t", layer_of("target", layers))
    return (placed.where(F.col("_t.rank") < F.col("_s.rank"))
            .select("repo", "source", "target", F.col("_s.name").alias("source_layer"),
                    F.col("_t.name").alias("target_layer"), "copies"))


def effective_ranks(nodes: DataFrame, layers: list[str] | None = None,
                    overrides: Mapping[str, int] | None = None) -> DataFrame:
    """Nodes with ``rank``: per-file override, else named layer (unmatched: after the last), else depth."""
    if layers:
        rank = F.coalesce(layer_of("id", layers)["rank"], F.lit(len(layers)))
    else:
        rank = F.coalesce("depth", F.lit(0))
    if overrides:
        flat = [F.lit(x) for kv in overrides.items() for x in kv]
        rank = F.coalesce(F.try_element_at(F.create_map(*flat), F.col("id")), rank)
    return nodes.withColumn("rank", rank.cast("bigint"))


def rank_violations(edges: DataFrame, ranked: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Edges from a higher to a lower effective rank, with the rank names."""
    s = ranked.select(F.col("vid").alias("src"), F.col("rank").alias("source_rank"))
    t = ranked.select(F.col("vid").alias("dst"), F.col("rank").alias("target_rank"))
    rows = ranked.count()
    both = attach(attach(edges, s, ["src"], "inner", rows), t, ["dst"], "inner", rows)
    return (both.where("source_rank > target_rank")
            .select("repo", "source", "target", "copies", "source_rank", "target_rank",
                    rank_name(F.col("source_rank"), layers).alias("source_name"),
                    rank_name(F.col("target_rank"), layers).alias("target_name")))


def violations_per_source(violations: DataFrame) -> DataFrame:
    return violations.groupBy("repo", "source").agg(F.sum("copies").alias("violations"))


def violations_per_file(violations: DataFrame) -> DataFrame:
    """How often a file is either end of a violation."""
    ends = violations.select("repo", F.explode(F.array("source", "target")).alias("file"), "copies")
    return ends.groupBy("repo", "file").agg(F.sum("copies").alias("violations"))


def worst_offenders(per_file: DataFrame, n: int) -> DataFrame:
    return top_per_group(per_file, ["repo"], [F.desc("violations"), F.asc("file")], n)


def layer_breakdown(ranked: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Files per rank and directory."""
    return (ranked.groupBy("repo", "rank", "dir").agg(F.count(F.lit(1)).alias("files"))
            .withColumn("layer", rank_name(F.col("rank"), layers)))


def top_directories(breakdown: DataFrame, n: int = 3) -> DataFrame:
    return top_per_group(breakdown, ["repo", "rank"], [F.desc("files"), F.asc("dir")], n, rank="place")


def rule_violations(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Violations of ``(type, source text, target text)`` rules.

    ``forbidden``: both texts occur. ``required``: the source text occurs and the target text
    does not. The rules are a short literal list, so each edge is tested once against all of
    them inside one projection; nothing is joined.
    """
    rules = [(kind or "forbidden", s.strip(), t.strip()) for kind, s, t in rules]
    tests = []
    for kind, s, t in rules:
        if not s or not t:
            continue
        to_target = F.contains(F.col("target"), F.lit(t))
        broken = F.contains(F.col("source"), F.lit(s)) & (to_target if kind == "forbidden" else ~to_target)
        verb = "must not depend on" if kind == "forbidden" else "must only depend on"
        tests.append(F.when(broken, F.struct(F.lit(kind).alias("rule_type"),
                                             F.lit(f"{s} {verb} {t}").alias("rule_desc"))))
    hits = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return (edges.select("repo", "source", "target", "copies", F.explode(hits).alias("hit"))
            .select("repo", "source", "target", "copies", "hit.rule_type", "hit.rule_desc"))
