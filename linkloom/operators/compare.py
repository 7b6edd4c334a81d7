"""Comparison of two snapshots of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _status() -> Column:
    return (F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("removed"))
            .otherwise(F.lit("unchanged")))


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every node of either side with ``diff``; attributes of the new side, of the old one for removed.

    Both inputs have unique ``(repo, id)`` and the same columns.
    """
    attrs = [c for c in new.columns if c not in ("repo", "id")]
    o = old.select("repo", "id", F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in attrs])
    n = new.select("repo", "id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in attrs])
    both = o.join(n, ["repo", "id"], "full_outer")
    return both.select("repo", "id", *[F.when(F.col("_new").isNull(), F.col(f"_o_{c}"))
                                       .otherwise(F.col(f"_n_{c}")).alias(c) for c in attrs],
                       _status().alias("diff"))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (source, target): the new side's multiplicity, the old one's for removed edges."""
    o = old.groupBy("repo", "source", "target").agg(F.sum("copies").alias("_old"))
    n = new.groupBy("repo", "source", "target").agg(F.sum("copies").alias("_new"))
    return (o.join(n, ["repo", "source", "target"], "full_outer")
            .select("repo", "source", "target", F.coalesce("_new", "_old").alias("copies"), _status().alias("diff")))


def diff_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, diff, rows: edges count with their copies."""
    n = nodes.groupBy("repo", "diff").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("node"))
    e = edges.groupBy("repo", "diff").agg(F.sum("copies").alias("rows")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def only_in(cycles: DataFrame, others: DataFrame) -> DataFrame:
    """Cycles (by member set) that the other side does not have: repo, cycle_id, size."""
    mine = cycles.where("kind = 'group'").select("repo", "cycle_id", "size", "member")
    theirs = others.where("kind = 'group'").select(
        "repo", "member", F.col("cycle_id").alias("_other"), F.col("size").alias("_size"))
    # A member lies in one cycle of each side: cycles are equal when they share all members and have one size.
    same = (mine.join(theirs, ["repo", "member"]).where("size = _size")
            .groupBy("repo", "cycle_id", "size", "_other").agg(F.count(F.lit(1)).alias("_shared"))
            .where("_shared = size").select("repo", "cycle_id"))
    return mine.select("repo", "cycle_id", "size").distinct().join(same, ["repo", "cycle_id"], "left_anti")
