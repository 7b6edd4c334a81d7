"""Components of undirected links by large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.store import discard, write_table


def least_of(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def star_components(links: DataFrame, label: str) -> DataFrame:
    """node, root (the smallest node reachable) for every node that occurs in ``links(a, b)``.

    Large and small stars in turn: every node hangs its greater neighbours, then its smaller ones, below the
    smallest node it knows. The number of rounds grows with the logarithm of a component's size, not with its
    diameter. A star is a minimum per node and a join, so no node's neighbours meet in one list; each round is a
    written table. Self links and null ends are left out; no rows give no rows.
    """
    edges = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), least_of("a", "b").alias("v")).distinct())
    edges, _ = write_table(edges, label)
    last, before = edges, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", least_of("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large, rows = write_table(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        edges = low.select("u", F.col("m").alias("v")).unionByName(rest).distinct().observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
        old, (edges, _) = last, write_table(edges, label)
        last = edges
        discard(old, large)
        now = (seen.get["n"], seen.get["x"])
        if now == before or rows == 0:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


__all__ = ["least_of", "star_components"]
