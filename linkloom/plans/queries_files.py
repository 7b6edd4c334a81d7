"""Queries over file tables: scanning, extraction, resolution, archives, links."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from linkloom.functions import languages as L
from linkloom.functions import paths
from linkloom.functions.languages import EXTENSIONS, ScanOptions
from linkloom.operators import extract as E
from linkloom.operators import metrics as M
from linkloom.operators import resolve as R
from linkloom.operators.graph import graph_from_edges
from linkloom.operators.insights import language_counts
from linkloom.operators.iterate import union_all
from linkloom.operators.links import page_links
from linkloom.plans import oracle as O
from linkloom.plans import trees as T
from linkloom.plans import views as V
from linkloom.plans.build import build
from linkloom.plans.catalog import query
from linkloom.sources.archives import archive_files, strip_wrapper
from linkloom.sources.trees import find_files

_IDS = {"h": "X1 J1 J2 F4", "c": "X1 J3", "cpp": "X1 P5 P7", "js": "X2 J2", "js_index": "X2", "py": "X3 F15 J8",
        "py_package": "X3", "java": "X4", "go": "X5 J5 S6", "rust": "X6", "cs": "X7 J6 A31", "cs_path": "X7 J7", "swift": "X8 J4",
        "ruby": "X9", "kotlin": "X10", "scala": "X11", "php": "X12 J6", "dart": "X13", "elixir": "X14 F6", "lua": "X15",
        "zig": "X16", "haskell": "X17", "r": "X18"}

for _name, _covers in _IDS.items():
    @query(f"imports_{_name}", _covers + " W5", T.edges_sql(_name))
    def _imports(spark, sf, name=_name):
        return T.edges_of(spark, sf, name)


def _external(name: str, extra: list[str]) -> str:
    tree = T.TREES[name]
    p = T.sql_name(tree.path, "id")
    rows = " UNION ALL ".join(f"SELECT {p} AS source, '{x}' AS target, TRUE AS is_external FROM n" for x in extra)
    s, t = T.sql_name(tree.path, "source"), T.sql_name(tree.node or tree.path, "target")
    return O.sql(O.FK_DIRECT + ", n AS (SELECT id FROM (SELECT source AS id FROM e UNION SELECT target FROM e "
                 "UNION SELECT 'part/' || p_partkey FROM part UNION SELECT 'region/' || r_regionkey FROM region))",
                 f"SELECT {s} AS source, {t} AS target, FALSE AS is_external FROM e UNION ALL {rows}")


for _name, _extra in (("py", ["os", "sys", "collections"]), ("rust", ["serde", "std"]), ("js", ["react"]),
                      ("java", ["java.util.*"]), ("r", ["ggplot2"]), ("haskell", ["Data.Text"]), ("zig", ["std"]), ("cpp", ["vector"]),
                      ("cpp_system", ["vector"])):
    @query(f"imports_with_external_{_name}", "P7 J8 U6", _external(_name, _extra))
    def _with_external(spark, sf, name=_name):
        return T.resolved_of(spark, sf, name).select(F.col("src").alias("source"), "target", "is_external")


@query("all_languages_graph", "U7 X3 X5 X9", O.sql(O.FK_DIRECT, " UNION ALL ".join(
    f"SELECT '{n}' AS repo, count(*)::BIGINT AS edges, count(DISTINCT source)::BIGINT AS sources FROM e" for n in ("py", "go", "ruby"))))
def all_languages_graph(spark, sf):
    """Trees of several languages in one file table, scanned with every language enabled."""
    files = T.files_of(spark, sf, "py").unionByName(T.files_of(spark, sf, "go")).unionByName(T.files_of(spark, sf, "ruby"))
    edges, _ = R.file_graph(files, ScanOptions.auto(hide_external=True))
    return edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"))


@query("file_graph_nodes_py", "G1 G5 A8 S2 U6", O.sql(O.FK_DIRECT + ", n AS (SELECT source AS id FROM e UNION SELECT target FROM e)," + O.closure_of("e", "tc"), f"""
SELECT {T.sql_name(T.TREES['py'].path, 'id')} AS id, (SELECT count(DISTINCT a) FROM tc WHERE b = id)::BIGINT AS impact, 'py' AS language FROM n"""))
def file_graph_nodes(spark, sf):
    """From file contents to node metrics: scan, extract, resolve, build."""
    def make():
        files = T.files_of(spark, sf, "py")
        options = ScanOptions.single("py", hide_external=True, hide_isolated=True)
        edges, nodes = R.file_graph(files, options)
        return build(graph_from_edges(edges, nodes), hide_isolated=True)
    b = V.remembered(spark, sf, "filegraph", make=make)
    return b.nodes.select("id", "impact", "language")


# --- scanning ------------------------------------------------------------------------------

# A mixed tree: extension by folder, some files in folders or under names that scans leave out.
_MIXED = """CASE WHEN starts_with(id, 'region') THEN id || '.txt' WHEN starts_with(id, 'nation') THEN 'latest/' || id || '.py'
  WHEN ends_with(id, '7') THEN 'web/node_modules/' || id || '.js' WHEN ends_with(id, '8') THEN id || 'CMake.cpp'
  WHEN ends_with(id, '9') THEN 'target/' || id || '.rs' WHEN starts_with(id, 'customer') THEN id || '.py'
  WHEN starts_with(id, 'supplier') THEN id || '.h' WHEN ends_with(id, '1') THEN id || '.R' ELSE id || '.js' END"""
_SQL_MIXED = O.view("fk") + f", x AS MATERIALIZED (SELECT {_MIXED} AS path FROM n)"
_SKIP = "regexp_matches(lower(path), 'test|cmake')"


def mixed(spark, sf):
    path = _MIXED.replace("starts_with(", "startswith(").replace("ends_with(", "endswith(")
    return V.graph_of(spark, sf, "fk").vertices.select(F.lit("mixed").alias("repo"), F.expr(path).alias("path"),
                                                       F.lit("").alias("content"))


@query("scan_all_languages", "S2 P1 P2 P3 P4", O.sql(_SQL_MIXED, f"""
SELECT path, CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.py' THEN 'py' WHEN '.js' THEN 'js' WHEN '.h' THEN 'h' WHEN '.R' THEN 'r' END AS lang
FROM x WHERE NOT {_SKIP} AND NOT ends_with(path, '.txt') AND NOT contains('/' || path, '/node_modules/') AND NOT contains('/' || path, '/target/')"""))
def scan_all(spark, sf):
    return E.scan_files(mixed(spark, sf), ScanOptions.auto()).select("path", "lang")


@query("scan_python_only", "P2 P4 P6", O.sql(_SQL_MIXED, f"SELECT path FROM x WHERE NOT {_SKIP} AND ends_with(path, '.py')"))
def scan_python(spark, sf):
    return E.scan_files(mixed(spark, sf), ScanOptions.single("py")).select("path")


@query("scan_defaults", "P6", O.sql(_SQL_MIXED, f"SELECT path FROM x WHERE NOT {_SKIP} AND ends_with(path, '.h')"))
def scan_defaults(spark, sf):
    return E.scan_files(mixed(spark, sf), ScanOptions()).select("path")


_FOUND = {"py": "py", "js": "js", "h": "h", "r": "R"}
_FLAGS = ", ".join(
    f"bool_or({'ends_with(path, ' + repr('.' + _FOUND[k]) + ')' if k in _FOUND else 'FALSE'}) AS has_{k}" for k in EXTENSIONS)


@query("detect_languages", "A10", O.sql(_SQL_MIXED, f"""
SELECT {_FLAGS} FROM x WHERE NOT {_SKIP} AND NOT contains('/' || path, '/node_modules/') AND NOT contains('/' || path, '/target/')"""))
def detect(spark, sf):
    return E.detect_languages(mixed(spark, sf)).drop("repo")


@query("detect_languages_of_two_trees", "U4", O.sql(_SQL_MIXED, f"""
SELECT {_FLAGS.replace('FALSE AS has_go', 'TRUE AS has_go').replace('bool_or(FALSE) AS has_go', 'TRUE AS has_go')} FROM x
WHERE NOT {_SKIP} AND NOT contains('/' || path, '/node_modules/') AND NOT contains('/' || path, '/target/')"""))
def detect_two(spark, sf):
    both = E.detect_languages(mixed(spark, sf)).unionByName(E.detect_languages(T.files_of(spark, sf, "go")))
    return E.language_union(both)


@query("language_counts_mixed", "A8", O.sql(_SQL_MIXED, """
SELECT CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.py' THEN 'py' WHEN '.js' THEN 'js' WHEN '.h' THEN 'h' WHEN '.R' THEN 'r'
  WHEN '.cpp' THEN 'cpp' WHEN '.rs' THEN 'rust' END AS language, count(*)::BIGINT AS files
FROM x WHERE NOT ends_with(path, '.txt') GROUP BY 1"""))
def language_counts_mixed(spark, sf):
    nodes = mixed(spark, sf).select("repo", L.language_of("path").alias("language"))
    return language_counts(nodes).drop("repo")


@query("excluded_include_targets", "P5", O.sql(_SQL_MIXED, """
SELECT path, NOT (ends_with(path, '.txt') OR ends_with(path, '.h') OR ends_with(path, '.cpp')) AS excluded FROM x"""))
def excluded_targets(spark, sf):
    return mixed(spark, sf).select("path", E.include_excluded(F.col("path"), ("c", "h", "cpp")).alias("excluded"))


@query("go_module", "S6", """
SELECT 'customer' || c_custkey AS repo, 'example.com/' || lower(c_mktsegment) || '/m' || c_custkey AS go_module FROM customer
WHERE c_custkey % 3 <> 0""")
def go_module(spark, sf):
    """A repo per customer; every third declares no module."""
    name = F.concat(F.lit("example.com/"), F.lower("c_mktsegment"), F.lit("/m"), F.col("c_custkey").cast("string"))
    head = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("// build\nmodule "), name, F.lit("\n"))).otherwise(F.lit(""))
    files = V.table(spark, sf, "customer").select(
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("repo"), F.lit("go.mod").alias("path"),
        F.concat(head, F.lit("\ngo 1.22\n")).alias("content"))
    return R.go_modules(files)


@query("namespace_files_cs", "A31 J6", O.sql(O.FK_DIRECT + ", n AS (SELECT source AS id FROM e UNION SELECT target FROM e UNION SELECT 'part/' || p_partkey FROM part UNION SELECT 'region/' || r_regionkey FROM region)", """
SELECT 'App.' || replace(id, '/', '.X') AS ns, replace(id, '/', '/N') || '.cs' AS path FROM n"""))
def namespace_files(spark, sf):
    scanned = E.scan_files(T.files_of(spark, sf, "cs"), ScanOptions.single("cs"))
    return R.namespaces(scanned, "cs", E.CS_NAMESPACE, ".").select("ns", "path")


@query("find_files_py", "S13 F23", O.sql(O.FK_DIRECT + ", n AS (SELECT source AS id FROM e UNION SELECT target FROM e UNION SELECT 'part/' || p_partkey FROM part UNION SELECT 'region/' || r_regionkey FROM region), f AS MATERIALIZED (SELECT replace(id, '/', '/m') || '.py' AS path FROM n)", """
SELECT path AS wanted, path, 'python' AS language FROM f
UNION ALL SELECT 'lost/' || regexp_replace(path, '^.*/', ''), min(path), 'python' FROM f GROUP BY 1
UNION ALL SELECT '../' || path, NULL, NULL FROM f"""))
def find_files_py(spark, sf):
    """Every file asked for by its path, by its base name in a lost folder, and by a path that climbs."""
    files = T.files_of(spark, sf, "py")
    asked = union_all([files.select("repo", how.alias("wanted")) for how in (
        F.col("path"), F.concat(F.lit("lost/"), paths.basename("path")), F.concat(F.lit("../"), "path"))])
    return find_files(asked, files).select("wanted", "path", "language")


@query("file_line_counts_py", "S13", O.sql(O.FK_DIRECT + ", n AS (SELECT source AS id FROM e UNION SELECT target FROM e UNION SELECT 'part/' || p_partkey FROM part UNION SELECT 'region/' || r_regionkey FROM region), c AS (SELECT source, count(*) AS n FROM e GROUP BY 1)", """
SELECT replace(id, '/', '/m') || '.py' AS path,
  (4 + CASE WHEN c.n IS NULL THEN 0 WHEN ends_with(id, '1') THEN 3 * c.n - 1 WHEN ends_with(id, '2') THEN c.n - 1 ELSE 4 * c.n - 1 END)::BIGINT AS lines
FROM n LEFT JOIN c ON c.source = id"""))
def file_line_counts(spark, sf):
    files = T.files_of(spark, sf, "py")
    return find_files(files.select("repo", F.col("path").alias("wanted")), files).select("path", "lines")


# --- archives ------------------------------------------------------------------------------

def _zip_up(group: pd.DataFrame) -> pd.DataFrame:
    """Test input: one conversation as an archive with a wrapper folder and the usual litter.

    Long conversations get an entry that leaves the folder.
    """
    out = io.BytesIO()
    conv = int(group["conv_id"].iloc[0])
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("wrap/", "")
        z.writestr("wrap/.DS_Store", "x")
        z.writestr("wrap/img/Thumbs.db", "x")
        for turn, text in zip(group["turn"], group["text"]):
            z.writestr(f"wrap/turns/t{turn}.txt", text)
        if len(group) >= 7:
            z.writestr("../escape.txt", "x")
    return pd.DataFrame({"repo": [f"conv{conv}"], "content": [out.getvalue()]})


def archives(spark, sf):
    talk = V.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return V.stored(spark, sf, "zips", make=lambda: talk.groupBy("conv_id").applyInPandas(_zip_up, "repo string, content binary"))


@query("archive_entries", "S3 S4", """
SELECT 'conv' || conv_id AS repo, 'turns/t' || turn || '.txt' AS path, text AS content FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 7)""")
def archive_entries(spark, sf):
    """Archives with an entry that leaves its folder are rejected whole."""
    return strip_wrapper(archive_files(archives(spark, sf))[0])


@query("archive_rejected", "S3", """
SELECT 'conv' || conv_id AS repo, '../escape.txt' AS path FROM conversations GROUP BY conv_id HAVING count(*) >= 7""")
def archive_rejected(spark, sf):
    return archive_files(archives(spark, sf))[1]


@query("strip_wrapper_folders", "S4", O.sql(O.view("flow"), """
SELECT regexp_replace(id, '/.*$', '') AS repo, regexp_replace(id, '^[^/]*/', '') AS path FROM n
UNION ALL SELECT 'all', id FROM n"""))
def strip_wrapper_folders(spark, sf):
    """Each user's files share a folder and lose it; all users together do not."""
    v = V.graph_of(spark, sf, "flow").vertices
    per_user = v.select(F.substring_index("id", "/", 1).alias("repo"), F.col("id").alias("path"))
    return strip_wrapper(per_user.unionByName(v.select(F.lit("all").alias("repo"), F.col("id").alias("path"))))


# --- links ---------------------------------------------------------------------------------

_LINKS = """
p AS MATERIALIZED (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/+([?#].*)?$', '', 'g') AS source, html FROM pages),
l AS MATERIALIZED (SELECT source, regexp_replace(source, '/.*$', '') AS host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM p),
k AS MATERIALIZED (SELECT source, CASE
    WHEN regexp_matches(href, '^[a-z]+://') THEN regexp_replace(regexp_replace(href, '^[a-z]+://', ''), '[?#].*$|/+([?#].*)?$', '', 'g')
    WHEN starts_with(href, '/') THEN host || regexp_replace(href, '[?#].*$', '')
    ELSE regexp_replace(source, '/[^/]*$', '') || '/' || regexp_replace(href, '[?#].*$', '') END AS target FROM l)"""


@query("page_links", "X19", O.sql(_LINKS, """
SELECT source, target, target IN (SELECT source FROM p) AS known, count(*)::BIGINT AS links FROM k GROUP BY 1, 2"""))
def page_links_(spark, sf):
    return links(spark, sf).groupBy("source", "target", "known").agg(F.count(F.lit(1)).alias("links"))


def links(spark, sf):
    return V.stored(spark, sf, "links", make=lambda: page_links(V.table(spark, sf, "pages")))


@query("page_in_degrees", "A1 X19", O.sql(_LINKS, "SELECT target, count(*)::BIGINT AS links FROM k GROUP BY 1"))
def page_in_degrees(spark, sf):
    return links(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("links"))


@query("coupling_links", "A7", O.sql(_LINKS + ", r AS MATERIALIZED (SELECT source, target FROM k)," + O.COUPLING,
       "SELECT dir1, dir2, cross_edges, score FROM coup"))
def coupling_links(spark, sf):
    arcs = links(spark, sf).groupBy("source", "target").agg(F.count(F.lit(1)).alias("copies")).withColumn("repo", F.lit("web"))
    return M.coupling(arcs).drop("repo")
