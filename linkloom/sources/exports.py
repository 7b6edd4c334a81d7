"""Text exports as ordered line tables.

A document is a table ``repo, section, folder, ord, key, line``; sorted by these columns it is
the file. Lists that another tool would put on one line (class members, legend entries) get a
line each, so no line grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.paths import mermaid_id, word_id
from linkloom.functions.scalars import RISK_COLORS, RISK_LABELS, RISK_ORDER, risk_color
from linkloom.operators.iterate import union_all
from linkloom.operators.ranking import number_rows
from linkloom.store import attach

COLUMNS = ["repo", "section", "folder", "ord", "key", "line"]


def _rows(df: DataFrame, section: int, line: Column, folder: Column | None = None, ord_: int = 0,
          key: Column | None = None) -> DataFrame:
    none = F.lit("")
    return df.select("repo", F.lit(section).alias("section"), (none if folder is None else folder).alias("folder"),
                     F.lit(ord_).alias("ord"), (none if key is None else key).alias("key"), line.alias("line"))


def _constant(repos: DataFrame, section: int, lines: list[str]) -> DataFrame:
    many = F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("ord", "line")
    return repos.select("repo", F.lit(section).alias("section"), F.lit("").alias("folder"), F.lit("").alias("key"), many) \
        .select(*COLUMNS)


def _folder(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit("/")), F.regexp_replace(id_, "/[^/]*$", "")).otherwise(F.lit("(root)"))


def write_text(document: DataFrame, path: str) -> None:
    """Write a line table as text, in order, one folder per repo."""
    document.orderBy("repo", "section", "folder", "ord", "key").select("repo", F.col("line").alias("value")) \
        .write.partitionBy("repo").text(path)


def _repeat(edges: DataFrame, line: Column) -> DataFrame:
    return edges.select("repo", "source", "target", "copies", line.alias("line"))


def _each(lines: DataFrame, section: int) -> DataFrame:
    """Edge lines of a document: one per edge, repeated edges included."""
    bag = lines.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return _rows(bag, section, F.col("line"), key=F.concat_ws("\t", "source", "target"))


# --- DOT -----------------------------------------------------------------------------------

def dot_edge_lines(edges: DataFrame) -> DataFrame:
    style = F.when(F.col("is_cycle"), F.lit('color="#ef4444", penwidth=2, style=bold')).otherwise(F.lit('color="#94a3b8"'))
    return _repeat(edges, F.concat(F.lit('  "'), "source", F.lit('" -> "'), "target", F.lit('" ['), style, F.lit("];")))


def dot(nodes: DataFrame, edges: DataFrame, color_by: str = "risk") -> DataFrame:
    """Graphviz document, coloured by ``risk`` or ``directory``."""
    repos = nodes.select("repo").distinct()
    placed = nodes.withColumn("folder", _folder(F.col("id")))
    critical = F.col("risk") == "critical"
    fill = F.col("dir_color") if color_by == "directory" else risk_color(F.col("risk"))
    attrs = F.concat(
        F.lit('fillcolor="'), fill, F.lit('", color="'),
        F.when(critical, F.lit('#ef4444", penwidth=2.5, fontcolor="#ffffff"'))
        .otherwise(F.lit('#94a3b8", penwidth=1, fontcolor="#1e293b"')),
        F.lit(', width=1.0, height=0.5, tooltip="'), "id", F.lit(" ["), F.coalesce("language", F.lit("?")),
        F.lit("] risk:"), "risk", F.lit(" in:"), F.col("in_degree").cast("string"), F.lit(" out:"),
        F.col("out_degree").cast("string"), F.lit('"'))
    folders = placed.select("repo", "folder").distinct()
    clustered = folders.groupBy("repo").agg((F.count(F.lit(1)) > 1).alias("clustered"))
    numbered = attach(number_rows(folders, ["repo"], ["folder"], "n"), clustered, ["repo"], "inner").where("clustered")
    label = F.replace(F.col("folder"), F.lit('"'), F.lit('\\"'))
    opening = [F.concat(F.lit("  subgraph cluster_"), (F.col("n") - 1).cast("string"), F.lit(" {")),
               F.concat(F.lit('    label="'), label, F.lit('";')),
               F.lit('    style=dashed; color="#94a3b8"; fontname="Inter"; fontsize=9;')]
    marked = attach(placed, clustered, ["repo"], "inner")
    indent = F.when(F.col("clustered"), F.lit("    ")).otherwise(F.lit("  "))
    at = F.when(F.col("clustered"), F.col("folder")).otherwise(F.lit(""))
    pieces = [
        _constant(repos, 0, ["digraph DependencyGraph {", '  graph [bgcolor="transparent", pad=0.5];',
                             '  node [shape=box, style="filled,rounded", fontname="Inter", fontsize=10, margin="0.15,0.08"];',
                             '  edge [arrowsize=0.7, color="#64748b"];', "  rankdir=LR;", ""]),
        *[_rows(numbered, 1, line, F.col("folder"), i) for i, line in enumerate(opening)],
        _rows(marked, 1, F.concat(indent, F.lit('"'), "id", F.lit('" ['), attrs, F.lit("];")), at, 3, F.col("id")),
        _rows(numbered, 1, F.lit("  }"), F.col("folder"), 4), _rows(numbered, 1, F.lit(""), F.col("folder"), 5),
        _each(dot_edge_lines(edges), 2), *_dot_legend(repos, placed, color_by),
        _constant(repos, 4, ["  }", "}"])]
    return union_all(pieces)


def _dot_legend(repos: DataFrame, placed: DataFrame, color_by: str) -> list[DataFrame]:
    by_dir = color_by == "directory"
    title = "Directories" if by_dir else "Risk level"
    head = ["", "  subgraph cluster_legend {",
            f'    label="{title}"; style=solid; color="#334155"; fontname="Inter"; fontsize=10;',
            '    node [shape=plaintext, style=""];', '    legend [label=<<TABLE BORDER="0" CELLSPACING="2">']
    if by_dir:
        entries = placed.groupBy("repo", "dir").agg(F.min("dir_color").alias("c")) \
            .select("repo", F.col("dir").alias("k"), "c", F.col("dir").alias("t"))
    else:
        order = {r: f"{i}" for i, r in enumerate(RISK_ORDER)}

        def of(table: dict[str, str]) -> Column:
            return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("risk"))
        entries = placed.select("repo", "risk").distinct() \
            .select("repo", of(order).alias("k"), of(RISK_COLORS).alias("c"), of(RISK_LABELS).alias("t"))
    row = F.concat(F.lit('<TR><TD BGCOLOR="'), "c", F.lit('" WIDTH="12" HEIGHT="12"> </TD><TD ALIGN="LEFT"> '), "t",
                   F.lit("</TD></TR>"))
    return [_constant(repos, 3, head), _rows(entries, 3, row, ord_=len(head), key=F.col("k")),
            _rows(repos, 3, F.lit("</TABLE>>];"), ord_=len(head) + 1)]


# --- Mermaid -------------------------------------------------------------------------------

def mermaid_edge_lines(edges: DataFrame) -> DataFrame:
    arrow = F.when(F.col("is_cycle"), F.lit(" -.->|cycle| ")).otherwise(F.lit(" --> "))
    return _repeat(edges, F.concat(F.lit("  "), mermaid_id("source"), arrow, mermaid_id("target")))


def mermaid(nodes: DataFrame, edges: DataFrame, color_by: str = "risk") -> DataFrame:
    """Mermaid flowchart with a subgraph per directory and a class per risk or directory."""
    repos = nodes.select("repo").distinct()
    placed = nodes.withColumn("folder", _folder(F.col("id")))
    clustered = placed.groupBy("repo").agg((F.countDistinct("folder") > 1).alias("clustered"))
    marked = attach(placed, clustered, ["repo"], "inner")
    folders = marked.where("clustered").select("repo", "folder").distinct()
    indent = F.when(F.col("clustered"), F.lit("    ")).otherwise(F.lit("  "))
    at = F.when(F.col("clustered"), F.col("folder")).otherwise(F.lit(""))
    mark = F.when(F.col("in_cycle"), F.lit(" ⟳")).otherwise(F.lit(""))
    node = F.concat(indent, mermaid_id("id"), F.lit('["'), "id", mark, F.lit('"]'))
    open_ = F.concat(F.lit("  subgraph "), mermaid_id("folder"), F.lit('["'), F.translate("folder", '"', "'"), F.lit('"]'))
    if color_by == "directory":
        name = F.concat(F.lit("dir_"), mermaid_id(F.when(F.col("folder") == "(root)", F.lit("root")).otherwise(F.col("folder"))))
        classes = placed.groupBy("repo", name.alias("name")).agg(F.min("dir_color").alias("c"))
        define = F.concat(F.lit("  classDef "), "name", F.lit(" fill:"), "c", F.lit(",stroke:#475569,color:#1e293b"))
    else:
        name = F.concat(F.lit("risk_"), "risk")
        classes = placed.select("repo", "risk", name.alias("name"), risk_color(F.col("risk")).alias("c")).distinct()
        critical = F.col("risk") == "critical"
        define = F.concat(F.lit("  classDef "), "name", F.lit(" fill:"), "c", F.lit(",stroke:#475569,stroke-width:"),
                          F.when(critical, F.lit("2px,color:#ffffff")).otherwise(F.lit("1px,color:#1e293b")))
    pieces = [_constant(repos, 0, ["graph LR"]),
              _rows(folders, 1, open_, F.col("folder"), 0), _rows(marked, 1, node, at, 1, F.col("id")),
              _rows(folders, 1, F.lit("  end"), F.col("folder"), 2),
              _each(mermaid_edge_lines(edges), 2), _constant(repos, 3, [""]),
              _rows(classes, 4, define, key=F.col("name")),
              _rows(placed, 5, F.concat(F.lit("  class "), mermaid_id("id"), F.lit(" "), name), key=F.col("id"))]
    if color_by == "directory":
        looped = placed.where("in_cycle")
        pieces += [_rows(looped.select("repo").distinct(), 6, F.lit(
            "  classDef cycleNode fill:#fee2e2,stroke:#ef4444,stroke-width:2px,color:#991b1b")),
            _rows(looped, 7, F.concat(F.lit("  class "), mermaid_id("id"), F.lit(" cycleNode")), key=F.col("id"))]
    return union_all(pieces)


def flowchart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The plain editor export: no groups, every non-word character replaced."""
    repos = nodes.select("repo").distinct()
    arrow = F.when(F.col("is_cycle"), F.lit(" -.-> ")).otherwise(F.lit(" --> "))
    lines = _repeat(edges, F.concat(F.lit("  "), word_id("source"), arrow, word_id("target")))
    return union_all([
        _constant(repos, 0, ["flowchart LR"]),
        _rows(nodes, 1, F.concat(F.lit("  "), word_id("id"), F.lit('["'), "id", F.lit('"]')), key=F.col("id")),
        _constant(repos, 2, [""]), _each(lines, 3)])


def sequential_ids(nodes: DataFrame) -> DataFrame:
    """``n0, n1, …`` per repo in id order."""
    return number_rows(nodes.select("repo", "id"), ["repo"], ["id"], "_n") \
        .select("repo", "id", F.concat(F.lit("n"), (F.col("_n") - 1).cast("string")).alias("short_id"))


def numbered_edge_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge lines of the browser's Mermaid export, whose nodes are numbered."""
    ids = sequential_ids(nodes)
    s = ids.select("repo", F.col("id").alias("source"), F.col("short_id").alias("_s"))
    t = ids.select("repo", F.col("id").alias("target"), F.col("short_id").alias("_t"))
    arrow = F.when(F.col("is_cycle"), F.lit(" -. cycle .-> ")).otherwise(F.lit(" --> "))
    return edges.join(s, ["repo", "source"]).join(t, ["repo", "target"]) \
        .select("repo", "source", "target", "copies", F.concat(F.lit("  "), "_s", arrow, "_t").alias("line"))


# --- Markdown diff -------------------------------------------------------------------------

def diff_markdown(nodes: DataFrame, edges: DataFrame, new_cycles: DataFrame) -> DataFrame:
    """Markdown diff from ``compare`` results.

    ``nodes`` and ``edges`` carry ``diff``; ``new_cycles`` is ``(repo, cycle_id, member)`` with
    one row per member of each cycle only the new side has. Members are listed one per line.
    """
    def changed(df: DataFrame, status: str, text: Column) -> DataFrame:
        return df.where(F.col("diff") == status).select("repo", text.alias("text")).distinct()

    arrow = F.concat(F.lit("- `"), "source", F.lit("` → `"), "target", F.lit("`"))
    item = F.concat(F.lit("- `"), "id", F.lit("`"))
    parts = [("+", "file", "Added files", changed(nodes, "added", item)),
             ("-", "file", "Removed files", changed(nodes, "removed", item)),
             ("+", "dep", "Added dependencies", changed(edges, "added", arrow)),
             ("-", "dep", "Removed dependencies", changed(edges, "removed", arrow))]
    repos = nodes.select("repo").distinct()
    counts = union_all([p[3].groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.lit(i))
                        for i, p in enumerate(parts)])
    # At most four counts per repo.
    per_repo = counts.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("c"))
    signs = F.array(*[F.struct(F.lit(p[0]).alias("sign"), F.lit(p[1]).alias("unit")) for p in parts])
    phrase = F.transform("c", lambda x: F.concat(
        signs[x["i"]]["sign"], x["n"].cast("string"), F.lit(" "), signs[x["i"]]["unit"],
        F.when(x["n"] == 1, F.lit("")).otherwise(F.lit("s"))))
    loops = new_cycles.groupBy("repo").agg(F.countDistinct("cycle_id").alias("n"))
    idle = repos.join(per_repo, "repo", "left_anti").join(loops, "repo", "left_anti")
    out = [_constant(repos, 0, ["## Dependency Diff", ""]), _constant(idle, 1, ["No dependency changes detected."]),
           _rows(per_repo, 2, F.concat(F.lit("**"), F.array_join(phrase, ", "), F.lit("**"))),
           _rows(per_repo, 2, F.lit(""), ord_=1)]
    for i, (_, _, title, rows) in enumerate(parts):
        n = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
        s = 3 + i
        out += [_rows(n, s, F.lit("<details>")),
                _rows(n, s, F.concat(F.lit(f"<summary>{title} ("), F.col("n").cast("string"), F.lit(")</summary>")), ord_=1),
                _rows(n, s, F.lit(""), ord_=2), _rows(rows, s, F.col("text"), ord_=3, key=F.col("text")),
                _rows(n, s, F.lit(""), ord_=4), _rows(n, s, F.lit("</details>"), ord_=5), _rows(n, s, F.lit(""), ord_=6)]
    out.append(_rows(loops, 7, F.concat(F.lit("⚠️ **"), F.col("n").cast("string"), F.lit(" new circular dependency group"),
                                        F.when(F.col("n") == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" introduced**"))))
    out.append(_rows(loops, 7, F.lit(""), ord_=1))
    out.append(_rows(new_cycles, 8, F.concat(F.lit("- `"), "cycle_id", F.lit("` ⟳ `"), "member", F.lit("`")),
                     F.col("cycle_id"), 0, F.col("member")))
    return union_all(out)
