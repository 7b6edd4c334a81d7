"""Imports to files.

Every language's search order becomes one array of lookup keys. Keys name what is looked up
(``f:`` a file, ``b:`` a base name, ``d:`` a folder with files below, ``n:`` a namespace, …);
a table of the keys the known files offer is joined to the exploded arrays once, and the key
that comes first in the array wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import paths
from linkloom.functions.languages import (
    CSHARP_PREFIXES, ELIXIR_MODULES, EXTENSIONS, HASKELL_MODULES, HASKELL_PREFIXES, KOTLIN_PREFIXES, LUA_MODULES,
    PHP_PREFIXES, RUBY_MODULES, SCALA_PREFIXES, SWIFT_MODULES, ZIG_MODULES, ScanOptions, include_excluded,
    PYTHON_MODULES, starts_with_any,
)
from linkloom.operators.extract import CS_NAMESPACE, PHP_NAMESPACE, extract_imports, find_all, scan_files
from linkloom.operators.iterate import union_all
from linkloom.store import BROADCAST_ROWS, attach, materialize, write_table


def raw() -> Column:
    return F.col("raw")


def src() -> Column:
    return F.col("src")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _keys(prefix: str, *names: Column) -> Column:
    return F.array(*[_cat(prefix, n) for n in names])


def _slashed(name: Column, mark: str = ".") -> Column:
    return F.replace(name, F.lit(mark), F.lit("/"))


def _first_part(name: Column, mark: str) -> Column:
    return F.substring_index(name, mark, 1)


def _last_part(name: Column, mark: str) -> Column:
    return F.substring_index(name, mark, -1)


def near() -> Column:
    """The raw name seen from the importing file; computed once per import (see ``resolve_imports``)."""
    return F.col("near")


def _relative(name: Column) -> Column:
    return paths.normalize(paths.join_path(paths.dirname(src()), name))


class Plan:
    """How one kind of import is resolved, as columns over an import row.

    ``settled``: known to be external without a lookup. ``ladder``: keys in search order.
    ``miss`` and ``miss_external``: the target when nothing is found; a null ``miss`` drops it. ``by_near``: the ladder
    is made from ``near`` alone, so imports of one file from many folders are one search.
    """

    def __init__(self, lang: list[str], ladder: Column, miss: Column, miss_external: Column | bool,
                 settled: Column | None = None, kind: list[str] | None = None, no_self: bool = False,
                 by_near: bool = False):
        self.test = F.col("lang").isin(lang)
        if kind:
            self.test = self.test & F.col("kind").isin(kind)
        self.langs, self.ladder, self.miss = set(lang), ladder, miss
        self.miss_external = F.lit(miss_external) if isinstance(miss_external, bool) else miss_external
        self.settled = F.lit(False) if settled is None else settled
        self.no_self, self.by_near = no_self, by_near


def _c() -> Plan:
    ladder = F.concat(_keys("f:", near(), paths.normalize(raw())), _keys("bs:", paths.basename(raw())))
    return Plan(["c", "h", "cpp"], ladder, raw(), F.col("kind") == "system")


def _js() -> Plan:
    at = near()
    exts = EXTENSIONS["js"]
    ladder = _keys("f:", at, *[_cat(at, e) for e in exts], *[_cat(at, f"/index{e}") for e in exts])
    return Plan(["js"], ladder, at, False, settled=~raw().startswith("."), by_near=True)


def _python() -> Plan:
    relative = raw().startswith(".")
    rest = F.regexp_replace(raw(), r"^\.+", "")
    base = paths.climb(paths.dirname(src()), F.length(raw()) - F.length(rest) - 1)
    inside = F.when(rest == "", base).otherwise(paths.join_path(base, _slashed(rest)))
    at = F.when(relative, inside).otherwise(_slashed(raw()))
    ladder = _keys("f:", _cat(at, ".py"), paths.join_path(at, F.lit("__init__.py")))
    return Plan(["py"], ladder, F.when(relative, _cat(at, ".py")).otherwise(raw()), ~relative,
                settled=~relative & _first_part(raw(), ".").isin(PYTHON_MODULES))


def _java() -> Plan:
    wild = raw().endswith(".*")
    package = _slashed(F.substring(raw(), F.lit(1), F.length(raw()) - 2))
    ladder = F.when(wild, _keys("cj:", package)).otherwise(_keys("f:", _cat(_slashed(raw()), ".java")))
    return Plan(["java"], ladder, raw(), True)


def _go() -> Plan:
    module = F.col("go_module")
    local = module.isNotNull() & F.startswith(raw(), F.coalesce(module, F.lit("")))
    rest = F.regexp_replace(F.substring(raw(), F.length(F.coalesce(module, F.lit(""))) + 1, F.length(raw())), "^/+", "")
    return Plan(["go"], _keys("d:", rest), raw(), True, settled=~local | (rest == ""))


def _rust_mod() -> Plan:
    here = paths.dirname(src())
    file = paths.join_path(here, _cat(raw(), ".rs"))
    return Plan(["rust"], _keys("f:", file, paths.join_path(here, _cat(raw(), "/mod.rs"))), file, False, kind=["mod"])


def _rust_use() -> Plan:
    """``crate`` counts from the root, ``self`` from the folder, each ``super`` one folder up."""
    path = F.regexp_replace(raw(), ":+$", "")
    top = _first_part(path, "::")
    parts = F.filter(F.split(path, "::"), lambda p: p != "")
    supers = F.size(F.split(F.regexp_extract(path, r"^((?:super(?:::|$))*)", 1), "super")) - 1
    folder = paths.dirname(src())
    base = (F.when(top == "self", folder).when(top == "super", paths.climb(folder, supers)).otherwise(F.lit("")))
    skip = F.when(top == "super", supers).otherwise(F.lit(1))
    tail = F.array_join(F.slice(parts, skip + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    at = F.when(tail == "", base).otherwise(paths.join_path(base, tail))
    local = top.isin("crate", "self", "super")
    ladder = F.when(at != "", _keys("f:", _cat(at, ".rs"), _cat(at, "/mod.rs"))).otherwise(F.array().cast("array<string>"))
    return Plan(["rust"], ladder, F.when(~local, top), True, settled=~local, kind=["use"])


def _rust_extern() -> Plan:
    return Plan(["rust"], F.array().cast("array<string>"), raw(), True, settled=F.lit(True), kind=["extern"])


def _ranges(parts: Column) -> Column:
    """Every run of consecutive segments: start ascending, end descending."""
    n = F.size(parts)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(
        F.reverse(F.sequence(F.lit(1), n - s + 1)), lambda k: F.array_join(F.slice(parts, s, k), "/"))))


def _tails(parts: Column) -> Column:
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda s: F.array_join(F.slice(parts, s, n), "/"))


def fold_name(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("-"), F.lit("_"))


def _csharp() -> Plan:
    parts = F.split(raw(), r"\.")
    files = F.flatten(F.transform(_ranges(parts), lambda r: F.array(
        _cat("f:", r, ".cs"), _cat("f:", F.replace(_cat(r, ".cs"), F.lit("_"), F.lit("-"))))))
    folders = F.flatten(F.transform(_tails(parts), lambda t: F.array(_cat("cc:", t), _cat("cx:", fold_name(t)))))
    ladder = F.array_distinct(F.concat(F.array(_cat("ns:", raw()), _cat("nk:", raw()), _cat("np:", raw())), files, folders))
    return Plan(["cs"], ladder, raw(), True, settled=starts_with_any(raw(), CSHARP_PREFIXES), no_self=True)


def _swift() -> Plan:
    at = _slashed(raw())
    ladder = F.concat(_keys("f:", _cat(at, ".swift")), _keys("ds:", at), _keys("bm:", _cat(_last_part(raw(), "."), ".swift")))
    return Plan(["swift"], ladder, raw(), True, settled=_first_part(raw(), ".").isin(SWIFT_MODULES))


def _with_rb(name: Column) -> Column:
    return F.when(name.endswith(".rb"), name).otherwise(_cat(name, ".rb"))


def _ruby_relative() -> Plan:
    at = near()
    return Plan(["ruby"], _keys("f:", _with_rb(at), at), _with_rb(at), False, kind=["relative"], by_near=True)


def _ruby_require() -> Plan:
    return Plan(["ruby"], _keys("f:", _with_rb(raw()), raw()), raw(), True, settled=_first_part(raw(), "/").isin(RUBY_MODULES),
                kind=["require"])


def _parent(name: Column) -> Column:
    """The dotted name without its last part; null for a single part."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def _kotlin() -> Plan:
    wild = raw().endswith(".*")
    named = F.array_compact(F.array(_cat("f:", _slashed(raw()), ".kt"), _cat("f:", _slashed(raw()), ".kts"),
                                    _cat("f:", _slashed(_parent(raw())), ".kt")))
    package = _slashed(F.substring(raw(), F.lit(1), F.length(raw()) - 2))
    return Plan(["kotlin"], F.when(wild, _keys("ck:", package)).otherwise(named), raw(), True,
                settled=starts_with_any(raw(), KOTLIN_PREFIXES))


def _scala() -> Plan:
    plain = F.substring_index(raw(), ".{", 1)
    base = F.when(plain.endswith("._"), F.substring(plain, F.lit(1), F.length(plain) - 2)).otherwise(plain)
    ladder = F.array_compact(F.array(
        _cat("f:", _slashed(base), ".scala"), _cat("f:", _slashed(base), ".sc"), _cat("f:", _slashed(base), "/package.scala"),
        _cat("f:", _slashed(_parent(base)), ".scala")))
    return Plan(["scala"], ladder, raw(), True, settled=starts_with_any(plain, SCALA_PREFIXES))


def _php_use() -> Plan:
    parts = F.split(raw(), r"\\")
    ladder = F.concat(F.array(_cat("pk:", raw()), _cat("pn:", raw()), _cat("pp:", raw())),
                      F.transform(_tails(parts), lambda t: _cat("f:", t, ".php")))
    return Plan(["php"], ladder, raw(), True, settled=starts_with_any(raw(), PHP_PREFIXES), kind=["use"], no_self=True)


def _near_or_root(langs: list[str], kind: list[str] | None = None) -> Plan:
    """Next to the importing file, else from the root; a miss stays a project path."""
    at = near()
    return Plan(langs, _keys("f:", at, raw()), at, False, kind=kind)


def _dart() -> Plan:
    package = raw().startswith("package:")
    inside = F.regexp_extract(raw(), r"^package:[^/]*/(.*)$", 1)
    ladder = F.when(package, _keys("f:", _cat("lib/", inside))).otherwise(_keys("f:", near(), raw()))
    return Plan(["dart"], ladder, F.when(package, raw()).otherwise(near()), package, settled=raw().startswith("dart:"))


def _elixir() -> Plan:
    at = _slashed(paths.snake_case(raw()))
    ladder = F.concat(_keys("f:", _cat("lib/", at, ".ex"), _cat("lib/", at, ".exs"), _cat(at, ".ex"), _cat(at, ".exs")),
                      _keys("es:", paths.basename(at)))
    return Plan(["elixir"], ladder, raw(), True, settled=_first_part(raw(), ".").isin(ELIXIR_MODULES))


def _lua() -> Plan:
    at = _slashed(raw())
    ladder = _keys("f:", _cat(at, ".lua"), _cat(at, "/init.lua"), _relative(_cat(at, ".lua")), _cat(raw(), ".lua"))
    return Plan(["lua"], ladder, raw(), True, settled=_first_part(raw(), ".").isin(LUA_MODULES))


def _zig() -> Plan:
    more = F.when(raw().endswith(".zig"), F.array().cast("array<string>")).otherwise(
        _keys("f:", _cat(near(), ".zig"), _cat(raw(), ".zig")))
    return Plan(["zig"], F.concat(_keys("f:", near(), raw()), more), raw(), True, settled=raw().isin(ZIG_MODULES))


def _haskell() -> Plan:
    at = _cat(_slashed(raw()), ".hs")
    ladder = F.concat(_keys("f:", at, _cat("src/", at), _cat("lib/", at), _cat("app/", at)),
                      _keys("bm:", _cat(_last_part(raw(), "."), ".hs")))
    return Plan(["haskell"], ladder, raw(), True,
                settled=raw().isin(HASKELL_MODULES) | starts_with_any(raw(), HASKELL_PREFIXES))


def _r_library() -> Plan:
    return Plan(["r"], F.array().cast("array<string>"), raw(), True, settled=F.lit(True), kind=["library"])


# Languages in which names are looked up from the importing file.
_NEAR = ["c", "h", "cpp", "js", "ruby", "php", "dart", "zig", "r"]


def plans(languages: list[str]) -> list[Plan]:
    every = [_c(), _js(), _python(), _java(), _go(), _rust_mod(), _rust_use(), _rust_extern(), _csharp(), _swift(),
             _ruby_relative(), _ruby_require(), _kotlin(), _scala(), _php_use(), _near_or_root(["php"], ["require"]),
             _dart(), _elixir(), _lua(), _zig(), _haskell(), _r_library(), _near_or_root(["r"], ["source"])]
    return [p for p in every if p.langs & set(languages)]


def _case(chosen: list[Plan], pick) -> Column:
    out = None
    for p in chosen:
        out = F.when(p.test, pick(p)) if out is None else out.when(p.test, pick(p))
    return out


# --- what the known files offer ------------------------------------------------------------

def namespaces(scanned: DataFrame, lang: str, pattern: str, mark: str) -> DataFrame:
    """repo, path, ns: declared namespaces of a language's files, and ``cls`` with the file name."""
    return (scanned.where(F.col("lang") == lang)
            .select("repo", "path", F.explode(F.array_distinct(find_all(F.col("content"), pattern))).alias("ns"))
            .withColumn("cls", _cat(F.col("ns"), mark, paths.stem("path"))))


def _outer(ns: Column, mark: str) -> Column:
    """All proper prefixes of a namespace."""
    parts = F.split(ns, r"\." if mark == "." else r"\\")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                     lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))) \
            .otherwise(F.array().cast("array<string>"))


def lookup_table(scanned: DataFrame, languages: list[str]) -> DataFrame:
    """repo, key, target: distinct. Keys with one answer are reduced to it here."""
    on = set(languages)
    files = scanned.select("repo", "path", "lang")
    at = F.col("path")
    single: list[tuple[DataFrame, Column, Column]] = []   # keep the smallest order value
    many = [files.select("repo", _cat("f:", at).alias("key"), at.alias("target"))]

    def children(prefix: str, lang: str) -> DataFrame:
        return files.where(F.col("lang") == lang).select(
            "repo", _cat(prefix, paths.dirname(at)).alias("key"), at.alias("target"))

    if on & {"c", "h", "cpp"}:
        single.append((files, _cat("bs:", paths.basename(at)), F.struct(F.length(at).alias("n"), at.alias("target"))))
    if on & {"swift", "haskell"}:
        single.append((files, _cat("bm:", paths.basename(at)), F.struct(F.lit(0).alias("n"), at.alias("target"))))
    if "elixir" in on:
        ex = files.where(F.col("lang") == "elixir")
        single.append((ex, _cat("es:", paths.stem(at)), F.struct(F.lit(0).alias("n"), at.alias("target"))))
    if "kotlin" in on:
        kt = files.where(F.col("lang") == "kotlin")
        single.append((kt, _cat("ck:", paths.dirname(at)), F.struct(F.lit(0).alias("n"), at.alias("target"))))
    if "go" in on:
        above = files.select("repo", F.explode(paths.ancestors(at)).alias("dir")).distinct()
        many.append(above.select("repo", _cat("d:", F.col("dir")).alias("key"), F.col("dir").alias("target")))
    if "swift" in on:
        above = files.where(F.col("lang") == "swift").select("repo", F.explode(paths.ancestors(at)).alias("dir")).distinct()
        many.append(above.select("repo", _cat("ds:", F.col("dir")).alias("key"), F.col("dir").alias("target")))
    if "java" in on:
        many.append(children("cj:", "java"))
    if "cs" in on:
        spaces = namespaces(scanned, "cs", CS_NAMESPACE, ".")
        many += [spaces.select("repo", _cat("ns:", F.col("ns")).alias("key"), F.col("path").alias("target")),
                 spaces.select("repo", F.explode(_outer(F.col("ns"), ".")).alias("o"), F.col("path").alias("target"))
                 .select("repo", _cat("np:", F.col("o")).alias("key"), "target").distinct(),
                 children("cc:", "cs").where("key <> 'cc:'")]
        single.append((spaces, _cat("nk:", F.col("cls")), F.struct(F.lit(0).alias("n"), at.alias("target"))))
        # Of folders that fold to one name, the first in order stands for it.
        cs = files.where(F.col("lang") == "cs").withColumn("dir", paths.dirname(at)).where("dir <> ''")
        chosen = cs.groupBy("repo", fold_name(F.col("dir")).alias("fold")).agg(F.min("dir").alias("dir"))
        many.append(cs.join(chosen, ["repo", "dir"]).select("repo", _cat("cx:", F.col("fold")).alias("key"),
                                                            F.col("path").alias("target")))
    if "php" in on:
        spaces = namespaces(scanned, "php", PHP_NAMESPACE, "\\")
        first = F.struct(F.lit(0).alias("n"), at.alias("target"))
        single += [(spaces, _cat("pk:", F.col("cls")), first), (spaces, _cat("pn:", F.col("ns")), first),
                   (spaces.select("repo", "path", F.explode(_outer(F.col("ns"), "\\")).alias("o")),
                    _cat("pp:", F.col("o")), first)]
    for df, key, order in single:
        best = df.groupBy("repo", key.alias("key")).agg(F.min(order).alias("b"))
        many.append(best.select("repo", "key", F.col("b.target").alias("target")))
    return union_all(many)


def go_modules(files: DataFrame) -> DataFrame:
    """repo, go_module: the module path a repo's ``go.mod`` declares."""
    name = F.trim(F.regexp_extract("content", r"(?mdU)^\s*module (.*)$", 1))
    return files.where("path = 'go.mod'").select("repo", F.when(name != "", name).alias("go_module")) \
        .where("go_module is not null")


# --- the join ------------------------------------------------------------------------------

def resolve_imports(imports: DataFrame, scanned: DataFrame, files: DataFrame, options: ScanOptions) -> DataFrame:
    """repo, src, lang, kind, raw, ord, target, is_external; several rows where an import means several files.

    What is external by name alone is settled in place. The rest is made distinct before the
    search (many files import the same things), searched, and joined back.
    """
    langs = list(options.enabled)
    chosen = plans(langs)
    rows = imports
    if "go" in langs:
        rows = attach(rows, go_modules(files), ["repo"], "left")
    else:
        rows = rows.withColumn("go_module", F.lit(None).cast("string"))
    if set(langs) & {"c", "h", "cpp"}:
        rows = rows.where(~(F.col("lang").isin("c", "h", "cpp") & include_excluded(raw(), langs)))
    rows = rows.withColumn("settled", _case(chosen, lambda p: p.settled)).withColumn("dir", paths.dirname(src()))
    # A column of its own, since the path is named several times in its normal form.
    rows = rows.withColumn("_from", paths.join_path(F.col("dir"), raw()))
    rows = materialize(rows.withColumn(
        "near", F.when(~F.col("settled") & F.col("lang").isin(_NEAR), paths.normalize("_from"))).drop("_from"), "imports")
    # Where a search starts from the importing file, only the file's folder matters, or only where it leads to.
    near_only = F.coalesce(_case(chosen, lambda p: F.lit(p.by_near)), F.lit(False))
    searches = rows.where("not settled").withColumn("_raw", F.when(near_only, F.col("near")).otherwise(raw())) \
        .withColumn("_dir", F.when(near_only, F.lit("")).otherwise(F.col("dir")))
    asked = (searches.select("repo", "lang", "kind", F.col("_raw").alias("raw"), F.col("_dir").alias("dir"), "near", "go_module").distinct()
             .withColumn("src", F.when(F.col("dir") == "", F.lit("x")).otherwise(_cat(F.col("dir"), "/x"))))
    probes = asked.select("repo", "lang", "kind", "raw", "dir",
                          F.posexplode(_case(chosen, lambda p: p.ladder)).alias("pos", "key"))
    table, offers = write_table(lookup_table(scanned, langs), "lookup")
    offered = table.select("repo", "key").distinct()
    same = ["repo", "lang", "kind", "raw", "dir"]
    if offers > BROADCAST_ROWS:
        # Both sides will be shuffled by key, and one key may be asked for from everywhere.
        probes = materialize(probes, "probes")
    winner = (attach(probes, offered, ["repo", "key"], "left_semi", offers).groupBy(*same)
              .agg(F.min_by("key", "pos").alias("key")))
    if offers > BROADCAST_ROWS:
        winner = materialize(winner, "winners")
    hits = materialize(attach(winner, table, ["repo", "key"], "inner", offers).select(*same, "target"), "hits")
    found = hits.withColumnsRenamed({"raw": "_raw", "dir": "_dir"})
    searched = attach(searches, found, ["repo", "lang", "kind", "_raw", "_dir"], "left")
    known = rows.where("settled").withColumn("target", F.lit(None).cast("string"))
    both = searched.select(*rows.columns, "target").unionByName(known.select(*rows.columns, "target"))
    missed = F.col("target").isNull()
    out = both.select(
        "repo", "src", "lang", "kind", "raw", "ord",
        F.when(~missed, F.col("target")).when(F.col("settled"), _case(chosen, lambda p: _settled_target(p)))
        .otherwise(_case(chosen, lambda p: p.miss)).alias("target"),
        F.when(~missed, F.lit(False)).when(F.col("settled"), F.lit(True))
        .otherwise(_case(chosen, lambda p: p.miss_external)).alias("is_external"),
        _case(chosen, lambda p: F.lit(p.no_self)).alias("no_self"))
    return out.where("target is not null and not (no_self and target = src)").drop("no_self")


def _settled_target(p: Plan) -> Column:
    return p.miss if "rust" in p.langs else raw()


def visible(resolved: DataFrame, hide_external: bool) -> DataFrame:
    """Drop external targets on request; a ``<…>`` include goes even when a project file matches."""
    if not hide_external:
        return resolved
    return resolved.where(~F.col("is_external") & ~((F.col("kind") == "system") & F.col("lang").isin("c", "h", "cpp")))


def file_graph(files: DataFrame, options: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """Edges ``(repo, source, target)`` and nodes ``(repo, id)`` of source trees ``(repo, path, content)``."""
    scanned = scan_files(files, options)
    imports = extract_imports(scanned, options.enabled)
    resolved = visible(resolve_imports(imports, scanned, files, options), options.hide_external)
    edges = resolved.select("repo", F.col("src").alias("source"), "target")
    return edges, scanned.select("repo", F.col("path").alias("id"))
