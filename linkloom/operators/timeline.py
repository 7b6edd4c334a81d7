"""Build-up steps: topological layers cut into chunks of bearable size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.paths import basename
from linkloom.operators.ranking import number_rows, top_per_group
from linkloom.store import attach, materialize

MIN_STEPS = 12


def steps(layered: DataFrame) -> DataFrame:
    """Add ``step`` to nodes ``(repo, id, layer, dir)``.

    With fewer than twelve layers, a layer is cut into chunks of ``max(8, ceil(n / 25))`` nodes
    in the order of directory and id; then layers and chunks are numbered through.
    """
    sizes = layered.groupBy("repo").agg(
        F.greatest(F.lit(8), F.ceil(F.count(F.lit(1)) / 25)).alias("_chunk"),
        F.countDistinct("layer").alias("_layers"))
    ranked = number_rows(layered, ["repo", "layer"], ["dir", "id"], "_place")
    part = F.when(F.col("_layers") < MIN_STEPS, F.floor((F.col("_place") - 1) / F.col("_chunk"))).otherwise(F.lit(0))
    cut = materialize(attach(ranked, sizes, ["repo"], "inner").withColumn("_part", part)
                      .drop("_place", "_chunk", "_layers"), "chunks")
    # One row per chunk: a repo has some tens of them, or as many as it has layers.
    chunks = cut.select("repo", "layer", "_part").distinct()
    numbered = chunks.withColumn(
        "step", (F.row_number().over(Window.partitionBy("repo").orderBy("layer", "_part")) - 1).cast("bigint"))
    return attach(cut, numbered, ["repo", "layer", "_part"], "inner").drop("_part")


def describe(stepped: DataFrame) -> DataFrame:
    """repo, step, files, top_dir, samples, role.

    The role follows the position of the step against the number of layers.
    """
    per_dir = stepped.groupBy("repo", "step", "dir").agg(F.count(F.lit(1)).alias("c"))
    main = per_dir.groupBy("repo", "step").agg(
        F.sum("c").alias("files"), F.min_by("dir", F.struct((-F.col("c")).alias("c"), "dir")).alias("top_dir"))
    few = top_per_group(stepped.select("repo", "step", "dir", "id"), ["repo", "step"], [F.asc("dir"), F.asc("id")], 3,
                        rank="place")
    samples = few.groupBy("repo", "step").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", basename("id").alias("name")))),
                                 lambda x: x["name"]), ", ").alias("samples"))
    ends = stepped.groupBy("repo").agg(F.max("step").alias("_last"), F.max("layer").alias("_top"))
    out = attach(main.join(samples, ["repo", "step"]), ends, ["repo"], "inner")
    at = F.when(F.col("_top") > 0, F.col("step") / F.col("_top")).otherwise(F.lit(0.0))
    role = (F.when(F.col("step") == 0, F.lit("Foundation")).when(F.col("step") == F.col("_last"), F.lit("Entry points"))
            .when(at < 0.2, F.lit("Foundation")).when(at < 0.45, F.lit("Core modules"))
            .when(at < 0.7, F.lit("Mid-level modules")).otherwise(F.lit("High-level modules")))
    return out.select("repo", "step", "files", "top_dir", "samples", role.alias("role"))
