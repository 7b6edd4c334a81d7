"""Source trees rendered from the foreign-key graph: one file per node, one import per edge.

Each language has its own path and statement form, chosen so that another rung of its search
order decides. The known answer is the edge list itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.languages import ScanOptions
from linkloom.operators.extract import extract_imports, scan_files
from linkloom.operators.resolve import resolve_imports, visible
from linkloom.plans import oracle as O
from linkloom.plans import views as V


@dataclass(frozen=True)
class Tree:
    """``path``/``node`` over (d, k) are SQL of both engines; ``statement`` is Spark SQL over (sd, sk, td, tk)."""

    languages: tuple[str, ...]
    path: str
    statement: str
    node: str | None = None      # target node, where it is not the target's file
    header: str = "''"           # first lines of a file, Spark SQL over (d, k)


_CAP = "concat(upper(substr({d}, 1, 1)), substr({d}, 2))"
_TCAP = _CAP.format(d="td")
_DCAP = _CAP.format(d="d")

TREES = {
    "h": Tree(("c", "h", "cpp"), "concat(d, '/', k, '.h')", r"""concat('  #include "../', td, '/./', tk, '.h"')"""),
    "c": Tree(("c", "h"), "concat(d, '/', d, '_', k, '.c')", r"""concat('#include "', td, '_', tk, '.c" // near')"""),
    "cpp": Tree(("cpp",), "concat(d, '/', k, '.hpp')", r"""concat('#include "', td, '/', tk, '.hpp"')""",
                header=r"'#include <vector>\n#include \"gone.py\"'"),
    "cpp_system": Tree(("cpp",), "concat(d, '/', k, '.hpp')", r"""concat('#include <', td, '/', tk, '.hpp>')""",
                       header=r"'#include <vector>\n#include \"gone.py\"'"),
    "js": Tree(("js",), "concat(d, '/', k, '.ts')", r"""concat('import {a} from \'../', td, '/', tk, '\';')""",
               header="'import React from \"react\";'"),
    "js_index": Tree(("js",), "concat(d, '/', k, '/index.mjs')", r"""concat('const x = require("../../', td, '/', tk, '")')"""),
    "py": Tree(("py",), "concat(d, '/m', k, '.py')",
               r"""CASE WHEN endswith(sk, '1') THEN concat('from .. import (\n    ', td, '.m', tk, ',\n)')
                   WHEN endswith(sk, '2') THEN concat('import ', td, '.m', tk)
                   ELSE concat('from ', td, '.m', tk, ' import (\n  a,\n  b\n)') END""",
               header="'import os, sys\\nfrom collections import deque'"),
    "py_package": Tree(("py",), "concat(d, '/m', k, '/__init__.py')", r"""concat('from ...', td, '.m', tk, ' import x')"""),
    "java": Tree(("java",), "concat(d, '/N', k, '.java')", "concat('import static ', td, '.N', tk, ';')",
                 header="'import java.util.*;'"),
    "go": Tree(("go",), "concat(d, '/', k, '/main.go')", r"""concat('import (\n\t"fmt"\n\t"example.com/app/', td, '/', tk, '"\n)')""",
               node="concat(d, '/', k)"),
    "rust": Tree(("rust",), "concat(d, '/m', k, '.rs')",
                 r"""CASE WHEN endswith(sk, '1') THEN concat('  pub use super::', td, '::m', tk, ';')
                     ELSE concat('use crate::', td, '::m', tk, '::{self};') END""",
                 header="'extern crate serde;\\nuse std::fmt;'"),
    "cs": Tree(("cs",), "concat(d, '/N', k, '.cs')", "concat('using App.', td, '.X', tk, ';')",
               header="concat('using System.Linq;\\n  namespace App.', d, '.X', k, ' {')"),
    "cs_path": Tree(("cs",), "concat(d, '-set/N', k, '.cs')", "concat('using Root.', td, '_set.N', tk, ';')"),
    "swift": Tree(("swift",), "concat(d, '/S', d, k, '.swift')", "concat('@testable import struct App.S', td, tk)",
                  header="'import Foundation'"),
    "ruby": Tree(("ruby",), "concat(d, '/r', k, '.rb')",
                 r"""CASE WHEN endswith(sk, '1') THEN concat('require "', td, '/r', tk, '"')
                     ELSE concat('require_relative \'../', td, '/r', tk, '\'') END""", header="'require \"json\"'"),
    "kotlin": Tree(("kotlin",), "concat(d, '/K', k, '.kts')", "concat('import ', td, '.K', tk, ' as A')",
                   header="'import kotlin.math.max'"),
    "scala": Tree(("scala",), "concat(d, '/S', k, '.scala')", "concat('import ', td, '.S', tk, '.{A, B}')",
                  header="'import scala.util.Try'"),
    "php": Tree(("php",), "concat(d, '/P', k, '.php')",
                r"""CASE WHEN endswith(sk, '1') THEN concat('require_once(\'../', td, '/P', tk, '.php\');')
                    ELSE concat('use App\\', td, '\\P', tk, ' as Q;') END""",
                header=r"concat('namespace App\\', d, ';')"),
    "dart": Tree(("dart",), "concat('lib/', d, '/d', k, '.dart')",
                 r"""CASE WHEN endswith(sk, '1') THEN concat('import \'../', td, '/d', tk, '.dart\' as x;')
                     ELSE concat('import "package:app/', td, '/d', tk, '.dart" show A, B;') END""",
                 header="'import \"dart:io\";'"),
    "elixir": Tree(("elixir",), "concat('lib/my_app/', d, '/e', k, '.ex')", f"concat('  alias MyApp.', {_TCAP}, '.E', tk)",
                   header="'use GenServer'"),
    "lua": Tree(("lua",), "concat(d, '/l', k, '/init.lua')", r"""concat('local a = require("', td, '.l', tk, '")')""",
                header="'local s = require \"socket\"'"),
    "zig": Tree(("zig",), "concat(d, '/z', k, '.zig')", r"""concat('const a = @import("../', td, '/z', tk, '.zig");')""",
                header="'const std = @import(\"std\");'"),
    "haskell": Tree(("haskell",), f"concat('src/', {_DCAP}, '/H', k, '.hs')", f"concat('import qualified ', {_TCAP}, '.H', tk, ' as H')",
                    header="'import Data.Text'"),
    "r": Tree(("r",), "concat(d, '/r', k, '.R')", r"""concat('source("../', td, '/r', tk, '.R")')""", header="'library(ggplot2)'"),
}


def _parts(df: DataFrame, id_: str, d: str, k: str) -> DataFrame:
    return df.withColumn(d, F.substring_index(id_, "/", 1)).withColumn(k, F.substring_index(id_, "/", -1))


def files_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """repo, path, content of a rendered tree."""
    def make():
        tree = TREES[name]
        edges = _parts(_parts(V.fk_direct(spark, sf), "source", "sd", "sk"), "target", "td", "tk")
        imports = (edges.select(F.col("source").alias("id"), F.expr(tree.statement).alias("line"))
                   .groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body")))
        nodes = _parts(V.fk_nodes(spark, sf).select("id"), "id", "d", "k")
        files = nodes.join(imports, "id", "left").select(
            F.lit(name).alias("repo"), F.expr(tree.path).alias("path"),
            F.concat(F.expr(tree.header), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("content"))
        if "go" in tree.languages:
            module = files.sparkSession.range(1).select(
                F.lit(name).alias("repo"), F.lit("go.mod").alias("path"), F.lit("module example.com/app\n\ngo 1.22\n").alias("content"))
            files = files.unionByName(module)
        return files
    return V.stored(spark, sf, "files", name, make=make)


def resolved_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    def make():
        options = ScanOptions(languages=TREES[name].languages)
        files = files_of(spark, sf, name)
        scanned = scan_files(files, options)
        return resolve_imports(extract_imports(scanned, options.enabled), scanned, files, options)
    return V.stored(spark, sf, "resolved", name, make=make)


def edges_of(spark: SparkSession, sf: str, name: str, hide_external: bool = True) -> DataFrame:
    return visible(resolved_of(spark, sf, name), hide_external) \
        .groupBy(F.col("src").alias("source"), "target").agg(F.count(F.lit(1)).alias("copies"))


def sql_name(expr: str, id_: str) -> str:
    """A path or node expression in check SQL."""
    d, k = f"regexp_replace({id_}, '/.*$', '')", f"regexp_replace({id_}, '^.*/', '')"
    return f"(SELECT {expr} FROM (SELECT {d} AS d, {k} AS k))"


def edges_sql(name: str) -> str:
    tree = TREES[name]
    s, t = sql_name(tree.path, "source"), sql_name(tree.node or tree.path, "target")
    return O.sql(O.FK_DIRECT, f"SELECT {s} AS source, {t} AS target, count(*)::BIGINT AS copies FROM e GROUP BY 1, 2")
