"""Filters over the node table, as column predicates."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import pattern_predicate
from linkloom.store import attach

_METRICS = {"inbound": "in_degree", "outbound": "out_degree", "depth": "depth", "impact": "impact",
            "stability": "stability"}
_OPS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le,
        "=": operator.eq, "==": operator.eq, "!=": operator.ne}


def metric(name: str, op: str, value: float) -> Column:
    """Comparison of a node metric; a missing metric counts as 0."""
    return _OPS[op](F.coalesce(F.col(_METRICS[name]), F.lit(0)), F.lit(value))


def matching(pattern: str) -> Column:
    return pattern_predicate(F.col("id"), pattern)


def under(folder: str) -> Column:
    return F.lower("id").startswith(folder.lower())


def where(nodes: DataFrame, *conditions: Column) -> DataFrame:
    """Nodes that meet every condition, most referenced first."""
    return nodes.where(reduce(operator.and_, conditions)).orderBy(F.desc("in_degree"), F.asc("id"))


def in_cycles(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Nodes on any cycle, self-loops included."""
    members = cycles.select("repo", F.col("member").alias("id"))
    return nodes.join(members, ["repo", "id"], "left_semi")


def search(nodes: DataFrame, needle: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("id"), F.lit(needle.lower())))


def search_groups(nodes: DataFrame, needle: str) -> DataFrame:
    """All nodes of every directory in which at least one node matches."""
    hit = search(nodes, needle).select("repo", "dir").distinct()
    return nodes.join(hit, ["repo", "dir"], "left_semi")


def hide_status(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Diff rows without the hidden statuses; an edge goes with either of its ends."""
    kept = nodes.where(~F.col("diff").isin(hidden))
    ids = kept.select("repo", "id")
    rows = ids.count()
    shown = attach(edges.where(~F.col("diff").isin(hidden)), ids.withColumnRenamed("id", "source"), ["repo", "source"],
                   "left_semi", rows)
    return kept, attach(shown, ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi", rows)


def share_of_max(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Bar length: value over the largest value of the group (0 when that is 0).

    The maximum is aggregated on the map side and joined back, so no group has to fit a task.
    """
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    return attach(df, top, group, "inner").withColumn(
        "share", F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.lit(0.0))).drop("_top")

