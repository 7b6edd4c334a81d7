"""What stands next to a node, and which node an import text means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.paths import path_suffixes
from linkloom.operators.ranking import top_per_group


def mini_graph(arcs: DataFrame, shown: int = 8, inline: int = 4) -> DataFrame:
    """First dependencies of every node, each with its own dependencies in one line.

    repo, id, dep, place, more (dependencies not shown), second_level (up to ``inline`` names,
    or one fewer and the number left out).
    """
    pairs = arcs.select("repo", F.col("source").alias("id"), F.col("target").alias("dep"))
    counts = pairs.groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n"))
    first = top_per_group(pairs, ["repo", "id"], [F.asc("dep")], shown, rank="place")
    short = (top_per_group(pairs, ["repo", "id"], [F.asc("dep")], inline, rank="place")
             .groupBy("repo", "id").agg(F.sort_array(F.collect_list("dep")).alias("names"))
             .join(counts, ["repo", "id"]))
    text = (F.when(F.col("n") <= inline, F.array_join("names", ", "))
            .otherwise(F.concat(F.array_join(F.slice("names", 1, inline - 1), ", "), F.lit(", +"),
                                (F.col("n") - (inline - 1)).cast("string"), F.lit(" more"))))
    second = short.select("repo", F.col("id").alias("dep"), text.alias("second_level"))
    return (first.join(counts, ["repo", "id"])
            .withColumn("more", F.greatest(F.col("n") - shown, F.lit(0)))
            .join(second, ["repo", "dep"], "left")
            .select("repo", "id", "dep", "place", "more", F.coalesce("second_level", F.lit("")).alias("second_level")))


def nodes_for_imports(texts: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(repo, raw)`` to the node it names: equal, else a path tail, else dots read as slashes.

    Tails of each node path become lookup keys, so "ends with" is an equi join.
    """
    bare = F.regexp_replace("id", r"\.[^.]+$", "")
    keyed = vertices.select(
        "repo", "id", F.explode(F.concat(
            F.array(F.concat(F.lit("e:"), "id")),
            F.transform(F.array_union(path_suffixes("id"), path_suffixes(bare)), lambda s: F.concat(F.lit("s:"), s)),
            F.transform(path_suffixes(bare), lambda s: F.concat(F.lit("d:"), s)))).alias("key"))
    table = keyed.groupBy("repo", "key").agg(F.min("id").alias("id"))
    asked = texts.select("repo", "raw").distinct()
    ladder = F.array(F.concat(F.lit("e:"), "raw"), F.concat(F.lit("s:"), "raw"),
                     F.concat(F.lit("d:"), F.translate("raw", ".", "/")))
    probes = asked.select("repo", "raw", F.posexplode(ladder).alias("pos", "key"))
    best = (probes.join(table, ["repo", "key"]).groupBy("repo", "raw").agg(F.min_by("id", "pos").alias("id")))
    return texts.join(best, ["repo", "raw"], "left")
