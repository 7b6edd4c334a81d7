"""Keep a graph up to date while files change.

Each micro-batch of changed files becomes a new version of three tables below a folder:
``files`` (which files exist), ``imports`` (extracted from the changed files only) and
``edges`` (resolved anew, since a new file can give old imports a target), plus ``diff``
against the version before. A replayed batch rewrites its own version, so it is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.languages import ScanOptions
from linkloom.operators.compare import diff_edges
from linkloom.operators.extract import extract_imports, scan_files
from linkloom.operators.resolve import resolve_imports, visible

_IMPORTS = "repo string, src string, lang string, kind string, raw string, ord int"
_EDGES = "repo string, source string, target string, copies bigint"
_FILES = "repo string, path string, content string"


class GraphRefresh:
    """``foreachBatch`` target. Changes are ``(repo, path, content, changed_at)``; null content deletes."""

    def __init__(self, spark: SparkSession, folder: str, options: ScanOptions):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options

    def _path(self, table: str, version: int) -> str:
        return f"{self.folder}/{table}/version={version}"

    def read(self, table: str, version: int, schema: str) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, version))

    def edges(self, version: int) -> DataFrame:
        return self.read("edges", version, _EDGES)

    def diff(self, version: int) -> DataFrame:
        return self.read("diff", version, _EDGES + ", diff string")

    def __call__(self, changes: DataFrame, version: int) -> None:
        changes = changes.select("repo", "path", "content", "changed_at")
        latest = (changes.groupBy("repo", "path")
                  .agg(F.max_by(F.struct("content"), "changed_at").alias("last"))
                  .select("repo", "path", F.col("last.content").alias("content")))
        touched = latest.select("repo", "path")
        # Contents are needed for namespaces and go.mod, so the latest text of a file is kept.
        self._write(self.read("files", version - 1, _FILES).join(touched, ["repo", "path"], "left_anti")
                    .unionByName(latest.where("content is not null")), "files", version)
        files = self.read("files", version, _FILES)
        fresh = extract_imports(scan_files(latest.where("content is not null"), self.options), self.options.enabled)
        kept = self.read("imports", version - 1, _IMPORTS) \
            .join(touched.withColumnRenamed("path", "src"), ["repo", "src"], "left_anti")
        self._write(kept.unionByName(fresh), "imports", version)
        resolved = visible(resolve_imports(self.read("imports", version, _IMPORTS), scan_files(files, self.options), files,
                                           self.options), self.options.hide_external)
        self._write(resolved.groupBy("repo", F.col("src").alias("source"), "target")
                    .agg(F.count(F.lit(1)).alias("copies")), "edges", version)
        self._write(diff_edges(self.edges(version - 1), self.edges(version)), "diff", version)

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, version))
