"""Zip archives as file tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import paths
from linkloom.store import attach, materialize

_ENTRY = "repo string, path string, content string, unsafe boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives of a folder as ``(repo, content)``; the file name is the repo."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path) \
        .select(F.regexp_extract(F.substring_index("path", "/", -1), r"^(.*)\.zip$", 1).alias("repo"), "content")


def _unsafe(info: zipfile.ZipInfo) -> bool:
    link = (info.external_attr >> 16) & 0o170000 == 0o120000
    at = posixpath.normpath(info.filename)
    return link or info.filename.startswith("/") or at == ".." or at.startswith("../")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for repo, blob in zip(batch["repo"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                for info in archive.infolist():
                    if info.is_dir():
                        continue
                    bad = _unsafe(info)
                    text = None if bad else archive.read(info).decode("utf-8", errors="ignore")
                    # One entry at a time: an archive is never unpacked whole in memory.
                    yield pd.DataFrame({"repo": [repo], "path": [info.filename], "content": [text], "unsafe": [bad]})


def archive_files(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``(repo, path, content)`` of safe archives, and ``(repo, path)`` of the offending entries.

    One entry that is a link or leaves its folder rejects its whole archive. Hidden and desktop
    files are left out.
    """
    entries = materialize(archives.select("repo", "content").mapInPandas(_unzip, _ENTRY), "entries")
    bad = entries.where("unsafe").select("repo", "path")
    name = paths.basename("path")
    kept = entries.where(~name.startswith(".") & ~name.isin("Thumbs.db", "desktop.ini"))
    return kept.join(bad.select("repo").distinct(), "repo", "left_anti").select("repo", "path", "content"), bad


def strip_wrapper(files: DataFrame, ignore_noise: bool = False) -> DataFrame:
    """Drop the first folder of a repo whose files all lie in it.

    ``ignore_noise`` leaves hidden entries and archive by-products out of the question.
    """
    top = F.substring_index("path", "/", 1)
    judged = files
    if ignore_noise:
        judged = files.where(~top.startswith(".") & ~top.isin("__MACOSX", "__pycache__"))
    tops = judged.groupBy("repo").agg(F.min(top).alias("_lo"), F.max(top).alias("_hi"),
                                      F.bool_and(F.contains(F.col("path"), F.lit("/"))).alias("_deep"))
    wrapped = attach(files, tops, ["repo"], "left")
    inside = (F.col("_lo") == F.col("_hi")) & F.col("_deep") & (top == F.col("_lo"))
    cut = F.when(inside, F.substring(F.col("path"), F.length(top) + 2, F.length("path"))).otherwise(F.col("path"))
    return wrapped.withColumn("path", cut).drop("_lo", "_hi", "_deep").where("path <> ''")
