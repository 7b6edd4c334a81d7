"""Commit churn per file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import round_half_even
from linkloom.store import attach


def churn(commits: DataFrame, now: datetime | str | Column, days: int = 365, recent_days: int = 90) -> DataFrame:
    """repo, path, commits, recent, authors, last_date, churn_score.

    ``commits`` is ``(repo, path, author, ts)`` and ``now`` a value or a column. The look-back
    starts at midnight ``days`` before now, the recent window exactly ``recent_days`` before.
    """
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    since = F.date_trunc("day", at - F.make_dt_interval(F.lit(days)))
    cutoff = at - F.make_dt_interval(F.lit(recent_days))
    per_file = (commits.where(F.col("ts") >= since).groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.col("ts") >= cutoff).alias("recent"),
        F.countDistinct("author").alias("authors"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_date")))
    return score(per_file)


def score(per_file: DataFrame) -> DataFrame:
    """Add ``churn_score``: shares of the repo's maxima, weighted towards recent commits."""
    def top(name: str) -> Column:
        return F.greatest(F.max(name), F.lit(1)).alias(f"_{name}")

    tops = per_file.groupBy("repo").agg(top("commits"), top("recent"), top("authors"))
    value = (0.45 * (F.col("recent") / F.col("_recent")) + 0.40 * (F.col("commits") / F.col("_commits"))
             + 0.15 * (F.col("authors") / F.col("_authors")))
    return (attach(per_file, tops, ["repo"], "inner").withColumn("churn_score", round_half_even(value, 4))
            .drop("_commits", "_recent", "_authors"))


def with_churn(nodes: DataFrame, churned: DataFrame) -> DataFrame:
    """Nodes with their churn; a file without commits scores 0."""
    c = churned.select("repo", F.col("path").alias("id"), "commits", "recent", "authors", "churn_score")
    return nodes.join(c, ["repo", "id"], "left").na.fill(0, ["commits", "recent", "authors", "churn_score"])


def hot_files(nodes: DataFrame, churned: DataFrame, above: float = 0.6) -> DataFrame:
    """Files of critical or high risk that also change often."""
    c = churned.where(F.col("churn_score") > above).select("repo", F.col("path").alias("id"), "churn_score")
    return nodes.where(F.col("risk").isin("critical", "high")).join(c, ["repo", "id"])


def hottest(churned: DataFrame, n: int = 5) -> DataFrame:
    return churned.orderBy(F.desc("churn_score"), F.asc("path")).limit(n)
