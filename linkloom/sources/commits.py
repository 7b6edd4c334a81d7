"""Commit logs: ``__COMMIT__<hash>|<author>|<ISO date>`` followed by the touched paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "__COMMIT__"


def read_commit_log(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """repo, path, author, ts from log files; one log per repo, named by file unless given.

    The mark is the record separator, so a log is split across tasks like any text file.
    """
    lines = (spark.read.option("lineSep", MARK).text(path)
             .withColumn("repo", F.lit(repo) if repo else F.substring_index(F.col("_metadata.file_name"), ".", 1)))
    return parse_commits(lines)


def parse_commits(records: DataFrame) -> DataFrame:
    """``(repo, value)`` records, one per commit, to touched paths.

    The header holds at least three fields; further bars belong to the date. Commits whose date
    does not parse, or without author, contribute nothing. Names are trimmed, blank lines ignored.
    """
    lines = F.split("value", r"\r\n|[\n\r]")
    head = F.split(F.get(lines, F.lit(0)), r"\|", 3)
    return (records.select(
        "repo", F.get(head, F.lit(1)).alias("author"),
        F.try_to_timestamp(F.trim(F.get(head, F.lit(2)))).alias("ts"),
        F.explode(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                              lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("path"))
        .where("path <> '' and ts is not null and author <> ''")
        .select("repo", "path", "author", "ts"))
