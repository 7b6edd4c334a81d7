"""Graph views over the supplied tables: path-like ids, so directory operators apply.

Every view reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.graph import Graph, graph_from_edges
from linkloom.plans.build import Build, build
from linkloom.store import materialize

_memo: dict[tuple, object] = {}


def remembered(spark: SparkSession, *key, make):
    """One copy per session of a written table or build, shared by the queries over it."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _memo:
        _memo[full] = make()
    return _memo[full]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.col(key).cast("string"))


def _arc(df: DataFrame, repo: str, a: Column, b: Column) -> DataFrame:
    return df.select(F.lit(repo).alias("repo"), a.alias("source"), b.alias("target"))


def fk_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign keys as dependencies: customer and supplier on nation, nation on region, part on supplier."""
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return (_arc(table(spark, sf, "customer"), "fk", _id("customer", "c_custkey"), _id("nation", "c_nationkey"))
            .unionByName(_arc(table(spark, sf, "supplier"), "fk", _id("supplier", "s_suppkey"),
                              _id("nation", "s_nationkey")))
            .unionByName(_arc(table(spark, sf, "nation"), "fk", _id("nation", "n_nationkey"),
                              _id("region", "n_regionkey")))
            .unionByName(_arc(sold, "fk", _id("part", "l_partkey"), _id("supplier", "l_suppkey"))))


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``fk_direct`` plus shortcuts from customer and supplier to region, which reduction must find."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")

    def shortcut(name: str, key: str, link: str) -> DataFrame:
        side = table(spark, sf, name).select(key, F.col(link).alias("n_nationkey"))
        return _arc(side.join(nation, "n_nationkey"), "fk", _id(name, key), _id("region", "n_regionkey"))

    return (fk_direct(spark, sf).unionByName(shortcut("customer", "c_custkey", "c_nationkey"))
            .unionByName(shortcut("supplier", "s_suppkey", "s_nationkey")))


def fk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    keys = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"),
            ("region", "r_regionkey"), ("part", "p_partkey")]
    out = None
    for name, key in keys:
        one = table(spark, sf, name).select(F.lit("fk").alias("repo"), _id(name, key).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def turns_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn depends on the one before it."""
    def turn(offset: int) -> Column:
        return F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/t"),
                        (F.col("turn") - offset).cast("string"))
    return _arc(table(spark, sf, "conversations").where("turn > 0"), "turns", turn(0), turn(1))


def turns_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.lit("turns").alias("repo"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/t"),
                 F.col("turn").cast("string")).alias("id"))


def flow_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as states: user, three-day span, event type."""
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).alias("span"),
    ).withColumn("state", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/s"),
                                   F.col("span").cast("string"), F.lit("/"), F.col("event_type")))


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive events of a user, over the whole history; repeats and self-loops are kept."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stepped = flow_steps(spark, sf).withColumn("next", F.lead("state").over(w)).where("next is not null")
    return _arc(stepped, "flow", F.col("state"), F.col("next"))


def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return flow_steps(spark, sf).select(F.lit("flow").alias("repo"), F.col("state").alias("id")).distinct()


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers depend on each other where one sold the other: components of a large share of all nodes."""
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = _id("part", "l_partkey"), _id("supplier", "l_suppkey")
    return _arc(sold, "trade", part, supplier).unionByName(_arc(sold, "trade", supplier, part))


def trade_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.lit("trade").alias("repo"), _id("part", "p_partkey").alias("id")).unionByName(
        table(spark, sf, "supplier").select(F.lit("trade").alias("repo"), _id("supplier", "s_suppkey").alias("id")))


_EDGES = {"fk": (fk_edges, fk_nodes), "turns": (turns_edges, turns_nodes), "flow": (flow_edges, flow_nodes),
          "trade": (trade_edges, trade_nodes)}


def graph_of(spark: SparkSession, sf: str, view: str) -> Graph:
    edges, nodes = _EDGES[view]
    return remembered(spark, sf, "graph", view,
                      make=lambda: graph_from_edges(edges(spark, sf), nodes(spark, sf)))


def build_of(spark: SparkSession, sf: str, view: str, reduce: str | None = "exact") -> Build:
    return remembered(spark, sf, "build", view, reduce,
                      make=lambda: build(graph_of(spark, sf, view), reduce))


def stored(spark: SparkSession, *key, make) -> DataFrame:
    return remembered(spark, *key, make=lambda: materialize(make(), "view"))
