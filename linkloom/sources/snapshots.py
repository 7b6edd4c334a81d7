"""Graph snapshots as JSON.

A snapshot is written as one JSON object per line, so it is split, read and written in
parallel. The single-document form of other tools can be read too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = ("id string, in_degree bigint, out_degree bigint, depth bigint, impact bigint, stability double, "
               "size bigint, reach_pct double, in_cycle boolean, language string, risk string, dir_color string")
EDGE_SCHEMA = "source string, target string, copies bigint, is_cycle boolean, weight double"
LINE_SCHEMA = f"repo string, section string, node struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ',')}>, " \
              f"edge struct<{EDGE_SCHEMA.replace(' ', ':').replace(',:', ',')}>"

# One document: {"nodes": [{"data": {...}}], "edges": [{"data": {...}, "classes": "cycle"}]}
DOCUMENT_SCHEMA = (
    "nodes array<struct<data: struct<id: string, in_degree: bigint, out_degree: bigint, depth: bigint, impact: bigint,"
    " stability: double, size: bigint, reach_pct: double, in_cycle: boolean, language: string, risk: string,"
    " dir_color: string>>>,"
    " edges array<struct<data: struct<source: string, target: string, weight: double>, classes: string>>")


def _fields(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def to_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, section, json: one line per node and per distinct edge."""
    n = nodes.select("repo", F.lit("node").alias("section"),
                     F.to_json(F.struct("repo", F.lit("node").alias("section"),
                                        F.struct(*_fields(NODE_SCHEMA)).alias("node"))).alias("json"))
    e = edges.select("repo", F.lit("edge").alias("section"),
                     F.to_json(F.struct("repo", F.lit("edge").alias("section"),
                                        F.struct(*_fields(EDGE_SCHEMA)).alias("edge"))).alias("json"))
    return n.unionByName(e)


def from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", LINE_SCHEMA).alias("x")).select("x.*")


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    to_lines(nodes, edges).select("repo", "section", F.col("json").alias("value")) \
        .write.partitionBy("repo", "section").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path).select(F.col("value").alias("json")))


def nodes_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("section = 'node'").select("repo", "node.*")


def edges_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("section = 'edge'").select("repo", "edge.*")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of single-document snapshots; the file name is the repo."""
    docs = (spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
            .withColumn("repo", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)))
    nodes = docs.select("repo", F.explode("nodes.data").alias("d")).select("repo", "d.*")
    edges = (docs.select("repo", F.explode("edges").alias("e"))
             .groupBy("repo", "e.data.source", "e.data.target")
             .agg(F.count(F.lit(1)).alias("copies"),
                  F.bool_or(F.coalesce(F.contains(F.col("e.classes"), F.lit("cycle")), F.lit(False))).alias("is_cycle"),
                  F.max("e.data.weight").alias("weight")))
    return nodes, edges
