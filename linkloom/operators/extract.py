"""Import statements out of file contents.

Each language is one column expression from ``content`` to an array of ``(kind, raw)``; a
single CASE over the file's language picks it, so the files are read and exploded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.languages import (
    EXTENSIONS, ScanOptions, extension_language, handler_language, include_excluded, skipped_path, wanted,
)
from linkloom.functions import paths
from linkloom.store import spread

# Multi-line anchors, only \n ends a line, Unicode character classes.
_M = "(?mdU)"
# What ends a line when text is taken line by line.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# What counts as an import, per language. Group 1 is the imported name.
INCLUDE = r"""#include\s*(<|")([^>"]+)(>|")"""
JS_IMPORT = (r"""(?:import\s+(?:[\s\S]*?\s+from\s+)?['"]([^'"]+)['"]"""
             r"""|require\s*\(\s*['"]([^'"]+)['"]\s*\))""")
PY_FROM = r"^from\s+(\.{0,3}[\w.]*)\s+import\s+(.+)$"
PY_IMPORT = r"^import\s+([\w.]+(?:\s*,\s*[\w.]+)*)\s*$"
JAVA_IMPORT = r"^import\s+(?:static\s+)?([\w.*]+)\s*;"
GO_IMPORT = r'import\s+(?:\(\s*([^)]*?)\s*\)|"([^"]+)")'
RUST_USE = r"^\s*(?:pub\s+)?use\s+([\w:]+)"
RUST_MOD = r"^\s*(?:pub(?:\([\w:]+\))?\s+)?mod\s+(\w+)\s*[;{]"
RUST_EXTERN = r"^\s*extern\s+crate\s+(\w+)(?:\s+as\s+\w+)?\s*;"
CS_USING = r"^using\s+(?:static\s+)?([\w.]+)\s*;"
CS_NAMESPACE = r"^\s*namespace\s+([\w.]+)"
SWIFT_IMPORT = (r"^\s*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|enum\s+|protocol\s+|typealias\s+|func\s+|var\s+|let\s+)?"
                r"([\w.]+)")
RUBY_REQUIRE = r"""^\s*(?:require|load)\s+['"]([\w./\-]+)['"]"""
RUBY_RELATIVE = r"""^\s*require_relative\s+['"]([\w./\-]+)['"]"""
KOTLIN_IMPORT = r"^import\s+([\w.*]+)(?:\s+as\s+\w+)?\s*$"
SCALA_IMPORT = r"^import\s+([\w.*]+(?:\.\{[^}]+\})?)\s*$"
PHP_USE = r"^\s*use\s+([\w\\]+)(?:\s+as\s+\w+)?\s*;"
PHP_REQUIRE = r"""^\s*(?:require_once|include_once|require|include)\s*[\(]?\s*['"]([\w./\-]+)['"]\s*[\)]?\s*;"""
PHP_NAMESPACE = r"^\s*namespace\s+([\w\\]+)\s*;"
DART_IMPORT = (r"""^\s*import\s+['"]([\w:/.\-]+)['"]\s*(?:as\s+\w+\s*)?(?:show\s+[\w,\s]+)?(?:hide\s+[\w,\s]+)?;""")
ELIXIR_USE = r"^\s*(?:alias|import|use|require)\s+([\w.]+)"
LUA_REQUIRE = r"""require\s*[\(]?\s*['"]([^'"]+)['"]\s*[\)]?"""
ZIG_IMPORT = r'@import\s*\(\s*"([^"]+)"\s*\)'
HASKELL_IMPORT = r"^\s*import\s+(?:qualified\s+)?([\w.]+)"
R_LIBRARY = r"""^\s*(?:library|require)\s*\(\s*(?:['"]?([\w.]+)['"]?)\s*\)"""
R_SOURCE = r"""^\s*source\s*\(\s*['"]([^'"]+)['"]\s*\)"""


def find_all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(_M + pattern), F.lit(group))


def _tag(kind: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))


def _plain(kind: str, pattern: str) -> Callable[[Column], Column]:
    return lambda content: _tag(kind, find_all(content, pattern))


def _split_names(text: Column) -> Column:
    trimmed = F.transform(F.split(text, ","), lambda n: F.regexp_replace(n, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda n: n != "")


def one_line_imports(content: Column) -> Column:
    r"""Put every parenthesised Python import list on the line of its ``import``, without parens.

    The first replacement turns line ends between the parens into blanks, one per match, going
    on from the end of the last match (``\G``); the second drops the parens.
    """
    joined = F.regexp_replace(
        content, r"(?mdU)(^from\s+\S+\s+import\s*\((?=[^)]*\))|(?!\A)\G)([^)\n]*)\n", "$1$2 ")
    bare = F.regexp_replace(joined, r"(?mdU)^(from\s+\S+\s+import\s*)\(\s*([^)\n]*)\)", "$1$2")
    return F.when(F.contains(content, F.lit("(")), bare).otherwise(content)


def _python(content: Column) -> Column:
    text = one_line_imports(content)
    whole = find_all(text, PY_FROM, 0)

    def names(statement: Column) -> Column:
        at = F.regexp_extract(statement, _M + PY_FROM, 1)
        listed = F.filter(_split_names(F.regexp_extract(statement, _M + PY_FROM, 2)), lambda n: n != "*")
        dots_only = (at != "") & (F.replace(at, F.lit("."), F.lit("")) == "")
        return F.when(dots_only, F.transform(listed, lambda n: F.concat(at, n))).otherwise(F.array(at))

    froms = F.flatten(F.transform(whole, names))
    plain = F.flatten(F.transform(find_all(text, PY_IMPORT), _split_names))
    return _tag("import", F.concat(froms, plain))


def _go(content: Column) -> Column:
    statements = find_all(content, GO_IMPORT, 0)
    return _tag("import", F.flatten(F.transform(statements, lambda s: find_all(s, r'"([^"]+)"'))))


def _lines_with(content: Column, mark: str) -> Column:
    return F.filter(F.split(content, _LINE_END), lambda line: line.rlike(mark))


def _c_family(content: Column) -> Column:
    def first(line: Column) -> Column:
        system = F.regexp_extract(line, INCLUDE, 1) == "<"
        return F.struct(F.when(system, F.lit("system")).otherwise(F.lit("quoted")).alias("kind"),
                        F.regexp_extract(line, INCLUDE, 2).alias("raw"))
    return F.transform(_lines_with(content, INCLUDE), first)


def _js(content: Column) -> Column:
    # The name is what stands between the last two quotes of a match; neither holds a quote itself.
    found = F.transform(F.split(content, _LINE_END), lambda line: F.regexp_extract(line, "(?U)" + JS_IMPORT, 0))
    return F.transform(F.filter(found, lambda m: m != ""), lambda m: F.struct(
        F.lit("import").alias("kind"), F.element_at(F.split(m, "['\"]"), -2).alias("raw")))


def _ruby(content: Column) -> Column:
    plain = F.filter(find_all(content, RUBY_REQUIRE), lambda r: ~F.contains(r, F.lit("require_relative")))
    return F.concat(_tag("relative", find_all(content, RUBY_RELATIVE)), _tag("require", plain))


def _join(*parts: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda content: F.concat(*[p(content) for p in parts])


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "c": _c_family, "h": _c_family, "cpp": _c_family, "js": _js, "py": _python,
    "java": _plain("import", JAVA_IMPORT), "go": _go,
    "rust": _join(_plain("mod", RUST_MOD), _plain("use", RUST_USE), _plain("extern", RUST_EXTERN)),
    "cs": _plain("using", CS_USING), "swift": _plain("import", SWIFT_IMPORT), "ruby": _ruby,
    "kotlin": _plain("import", KOTLIN_IMPORT), "scala": _plain("import", SCALA_IMPORT),
    "php": _join(_plain("use", PHP_USE), _plain("require", PHP_REQUIRE)),
    "dart": _plain("import", DART_IMPORT), "elixir": _plain("alias", ELIXIR_USE),
    "lua": _plain("require", LUA_REQUIRE), "zig": _plain("import", ZIG_IMPORT),
    "haskell": _plain("import", HASKELL_IMPORT),
    "r": _join(_plain("library", R_LIBRARY), _plain("source", R_SOURCE)),
}


def scan_files(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Files of the enabled languages outside skipped folders, with their language."""
    return (files.where(wanted("path", options.enabled) & ~skipped_path("path", options.enabled))
            .withColumn("lang", handler_language("path")))


def extract_imports(scanned: DataFrame, languages: Iterable[str]) -> DataFrame:
    """repo, src, lang, kind, raw, ord: one row per import, in the order of the file."""
    found = None
    groups: dict[Callable, list[str]] = {}
    for lang in languages:
        groups.setdefault(EXTRACTORS[lang], []).append(lang)
    for extractor, langs in groups.items():
        test, value = F.col("lang").isin(langs), extractor(F.col("content"))
        found = F.when(test, value) if found is None else found.when(test, value)
    if found is None:
        found = F.array().cast("array<struct<kind:string,raw:string>>")
    return (spread(scanned.select("repo", "path", "lang", "content"))
            .select("repo", F.col("path").alias("src"), "lang", F.posexplode(found).alias("ord", "i"))
            .select("repo", "src", "lang", "i.kind", "i.raw", "ord"))


def detect_languages(files: DataFrame) -> DataFrame:
    """repo and one flag per language: whether any file outside skipped folders has it."""
    kept = files.where(~skipped_path("path", EXTENSIONS))
    ext = paths.suffix("path")
    return kept.select("repo", extension_language(ext).alias("lang")).where("lang is not null").distinct() \
        .groupBy("repo").agg(*[F.bool_or(F.col("lang") == k).alias(f"has_{k}") for k in EXTENSIONS])


def language_union(detected: DataFrame) -> DataFrame:
    """Flags over all repos: a language counts when any tree has it."""
    return detected.agg(*[F.bool_or(f"has_{k}").alias(f"has_{k}") for k in EXTENSIONS])


__all__ = ["scan_files", "extract_imports", "detect_languages", "language_union", "find_all", "one_line_imports",
           "include_excluded"]
