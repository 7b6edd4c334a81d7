"""Source trees on a file system, and lookups in a file table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import paths
from linkloom.functions.languages import EXTENSIONS, ScanOptions, preview_language, skipped_path


def read_tree(spark: SparkSession, root: str, options: ScanOptions, repo: str | None = None) -> DataFrame:
    """repo, path, content of one tree below ``root``.

    The reader lists only wanted extensions (and ``go.mod``). Paths are relative to the root,
    skip rules look at what lies below it. Line ends become ``\\n``, undecodable bytes go.
    """
    exts = [e[1:] for lang in options.enabled for e in EXTENSIONS[lang]] + ["mod"]
    base = root.rstrip("/")
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
           .text(base, wholetext=True).select("value", F.col("_metadata.file_path").alias("uri")))
    # Both the root and the files as absolute paths of their file system; a prefix is then cut, not searched for.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("uri", r"\+", "%2B")), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return raw.select(
        F.lit(repo or base.rsplit("/", 1)[-1]).alias("repo"),
        F.substring(plain, F.lit(len(whole.rstrip("/")) + 2), F.length(plain)).alias("path"),
        F.replace(F.regexp_replace("value", r"\r\n?", "\n"), F.lit("�"), F.lit("")).alias("content")) \
        .where(~skipped_path("path", options.enabled))


def find_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo, wanted)`` to the file meant: that path, else the first with its base name.

    Adds path, content, language, lines. A path that climbs with ``..`` finds nothing.
    """
    asked = requests.select("repo", "wanted").distinct()
    safe = asked.where(~F.array_contains(F.split("wanted", "/"), ".."))
    exact = files.select("repo", F.col("path").alias("wanted"), F.col("path").alias("exact"))
    named = (files.select("repo", paths.basename("path").alias("base"), "path")
             .groupBy("repo", "base").agg(F.min("path").alias("named")))
    hit = (safe.join(exact, ["repo", "wanted"], "left").withColumn("base", paths.basename("wanted"))
           .join(named, ["repo", "base"], "left")
           .select("repo", "wanted", F.coalesce("exact", "named").alias("path")))
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    return (asked.join(hit, ["repo", "wanted"], "left").join(files, ["repo", "path"], "left")
            .select("repo", "wanted", "path", "content", F.when(F.col("path").isNotNull(), preview_language("path"))
                    .alias("language"), lines.cast("bigint").alias("lines")))
