"""Top-n and row numbers that stay parallel inside a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.store import attach, materialize


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    The filter on ``row_number`` lets Spark cut every group to ``n`` rows before the shuffle,
    so a group of any size reaches its final task with at most ``n`` rows per map task.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Exact ``row_number`` (from 1) per group without putting a group into one task.

    Rows are range-partitioned by group and order, and written with their partition number.
    The rows of a group before a partition are then a sum over a table of one row per
    (group, partition), and inside a partition the number is a local count.
    """
    keys = [*group, *order]
    placed = materialize(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = placed.withColumn("_local", F.row_number().over(local))
    return (attach(ranked, offsets, [*group, "_part"], "inner")
            .withColumn(name, F.col("_local") + F.col("_offset"))
            .drop("_local", "_offset", "_part"))
