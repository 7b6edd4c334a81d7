"""Windowed churn over a stream of commit touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(commits: DataFrame, length: str = "90 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """repo, path, start, end, commits, authors per sliding window.

    On a stream, touches later than ``late`` are dropped and a window is final once the watermark passes its end. State
    is a counter per window, file and author, and one per window and file, so authors are counted exactly on streams too
    and no file's authors have to fit one row.
    """
    timed = commits.withWatermark("ts", late) if commits.isStreaming else commits
    each = timed.groupBy("repo", "path", "author", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return (each.groupBy("repo", "path", "w").agg(F.sum("n").alias("commits"), F.count("author").alias("authors"))
            .select("repo", "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits", "authors"))
