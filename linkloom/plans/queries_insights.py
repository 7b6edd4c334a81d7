"""Queries over the node and edge tables: filters, findings, rankings, layers, rules, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import paths, scalars
from linkloom.operators import insights as N
from linkloom.operators import metrics as M
from linkloom.operators import predicates as P
from linkloom.operators import rules as R
from linkloom.operators import timeline as T
from linkloom.operators.graph import named
from linkloom.operators.neighbours import mini_graph, nodes_for_imports
from linkloom.plans import oracle as O
from linkloom.plans import report
from linkloom.plans import views as V
from linkloom.plans.build import display
from linkloom.plans.catalog import query
from linkloom.plans.queries_graph import NODE_COLUMNS, layers_of, _layers_sql
from linkloom.sources import exports, snapshots

FK, FLOW, TURNS = O.metrics("fk"), O.metrics("flow"), O.metrics("turns")
FLOW_ALL = O.metrics("flow", "e")


def nodes(spark, sf, view, reduce="exact"):
    return V.build_of(spark, sf, view, reduce).nodes


def coupling(spark, sf, view):
    return V.stored(spark, sf, "coupling", view, make=lambda: V.build_of(spark, sf, view).coupling)


# --- filters -------------------------------------------------------------------------------

def shown(spark, sf, view, **how):
    return V.remembered(spark, sf, "display", view, tuple(how.items()),
                        make=lambda: display(V.build_of(spark, sf, view), **how))


def _shown_sql(keep: str) -> str:
    """Reach and risk again, over the nodes a filter keeps."""
    return FK + f""",
kept AS MATERIALIZED (SELECT * FROM m WHERE {keep}),
kr AS (SELECT *, {O.rounded('impact / total * 100', 1)} AS reach_pct FROM kept, (SELECT count(*) AS total FROM kept) t)"""


_KEPT = "SELECT id, reach_pct, impact, in_degree FROM kr"


@query("hide_isolated_fk", "P8", O.sql(_shown_sql("in_degree + out_degree > 0"), _KEPT))
def hide_isolated(spark, sf):
    return shown(spark, sf, "fk", hide_isolated=True).nodes.select("id", "reach_pct", "impact", "in_degree")


@query("filter_dir_nodes_fk", "P9 A5", O.sql(_shown_sql("starts_with(id, 'na')"), _KEPT))
def filter_dir_nodes(spark, sf):
    return shown(spark, sf, "fk", filter_dir="na").nodes.select("id", "reach_pct", "impact", "in_degree")


@query("filter_dir_edges_fk", "P9 J18", O.sql(_shown_sql("starts_with(id, 'supplier') OR starts_with(id, 'nation')"), """
SELECT r.source, r.target, count(*)::BIGINT AS copies FROM r
JOIN kept a ON a.id = r.source JOIN kept b ON b.id = r.target GROUP BY 1, 2"""))
def filter_dir_edges(spark, sf):
    b = V.build_of(spark, sf, "fk")
    kept = b.nodes.where("id like 'supplier%' or id like 'nation%'").select("vid")
    links = b.reduced.links
    links = links.join(kept, links.src == kept.vid, "left_semi").join(kept, links.dst == kept.vid, "left_semi")
    return named(V.materialize(links, "kept"), b.reduced.vertices).select("source", "target", "copies")


@query("in_cycles_flow", "P10", O.sql(FLOW, "SELECT id FROM m WHERE id IN (SELECT member FROM cyc)"))
def in_cycles(spark, sf):
    return P.in_cycles(nodes(spark, sf, "flow"), V.build_of(spark, sf, "flow").cycles).select("id")


@query("no_inbound_fk", "P11", O.sql(FK, "SELECT id FROM m WHERE in_degree = 0"))
def no_inbound(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.metric("inbound", "=", 0)).select("id")


@query("no_outbound_fk", "P11", O.sql(FK, "SELECT id FROM m WHERE out_degree = 0"))
def no_outbound(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.metric("outbound", "=", 0)).select("id")


@query("matching_regex_fk", "P12 F14", O.sql(FK, "SELECT id FROM m WHERE regexp_matches(id, '^(SUPPLIER|nation)/.*[02468]$', 'i')"))
def matching_regex(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.matching("/^(SUPPLIER|nation)/.*[02468]$/i")).select("id")


@query("matching_text_fk", "P12 F14", O.sql(FK, "SELECT id FROM m WHERE contains(lower(id), 'lier/1')"))
def matching_text(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.matching("LIER/1")).select("id")


@query("in_directory_fk", "P13", O.sql(FK, "SELECT id FROM m WHERE starts_with(lower(id), 'nation')"))
def in_directory(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.under("Nation")).select("id")


@query("where_conditions_flow", "P14", O.sql(FLOW, """
SELECT id, in_degree, stability FROM m WHERE in_degree >= 1 AND out_degree < 3 AND impact != 0
AND stability <= 0.6 AND depth < 4 AND contains(lower(id), 'user1')"""))
def where_conditions(spark, sf):
    return P.where(nodes(spark, sf, "flow"), P.metric("inbound", ">=", 1), P.metric("outbound", "<", 3),
                   P.metric("impact", "!=", 0), P.metric("stability", "<=", 0.6), P.metric("depth", "<", 4),
                   P.matching("user1")).select("id", "in_degree", "stability")


@query("search_groups_fk", "P15", O.sql(FK, """
SELECT id FROM m WHERE dir IN (SELECT dir FROM m WHERE contains(lower(id), 'ion/2'))"""))
def search_groups(spark, sf):
    return P.search_groups(nodes(spark, sf, "fk"), "ION/2").select("id")


@query("search_fk", "P15", O.sql(FK, "SELECT id FROM m WHERE contains(lower(id), '/77')"))
def search(spark, sf):
    return P.search(nodes(spark, sf, "fk"), "/77").select("id")


# --- findings ------------------------------------------------------------------------------

_OVERVIEW = f"""
SELECT (SELECT count(*) FROM n)::BIGINT AS files, (SELECT count(*) FROM r)::BIGINT AS edges,
  (SELECT count(DISTINCT dir) FROM m)::BIGINT AS directories,
  {O.half_up('(SELECT count(*) FROM r) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)) * 100', 1)} AS density"""
for _view in ("fk", "flow"):
    @query(f"overview_{_view}", "A11", O.sql(O.metrics(_view), _OVERVIEW))
    def _overview(spark, sf, view=_view):
        b = V.build_of(spark, sf, view)
        return N.overview(b.nodes, b.reduced.arcs).drop("repo")


@query("god_files_fk", "A12", O.sql(FK, """
SELECT id, in_degree AS inbound FROM m WHERE in_degree >= greatest(10, (SELECT max(in_degree) FROM m) * 0.5)"""))
def god_files(spark, sf):
    return N.god_files(nodes(spark, sf, "fk")).drop("repo")


@query("high_fan_out_fk", "A13", O.sql(FK, """
SELECT id, out_degree AS outbound FROM m WHERE out_degree >= greatest(8, (SELECT max(out_degree) FROM m) * 0.4)
ORDER BY out_degree DESC, id LIMIT 10"""))
def high_fan_out(spark, sf):
    return N.high_fan_out(nodes(spark, sf, "fk"), 10).drop("repo")


@query("hubs_flow", "A14", O.sql(FLOW_ALL, """
SELECT id, in_degree AS inbound, out_degree AS outbound, in_degree + out_degree AS total FROM m
WHERE in_degree >= 3 AND out_degree >= 3 ORDER BY total DESC, id LIMIT 10"""))
def hubs(spark, sf):
    return N.hubs(nodes(spark, sf, "flow", None), 10, at_least=3).drop("repo")


@query("deep_files_turns", "A15", O.sql(TURNS, "SELECT id, depth FROM m WHERE depth >= 5 ORDER BY depth DESC, id LIMIT 10"))
def deep_files(spark, sf):
    return N.deep_files(nodes(spark, sf, "turns"), 10).drop("repo")


@query("high_impact_fk", "A16", O.sql(FK, f"""
SELECT id, impact, {O.half_up('impact / (SELECT count(*) FROM m) * 100', 1)} AS pct FROM m
WHERE impact >= 5 ORDER BY impact DESC, id LIMIT 10"""))
def high_impact(spark, sf):
    return N.high_impact(nodes(spark, sf, "fk"), 10).drop("repo")


@query("unstable_core_flow", "A17", O.sql(FLOW_ALL, """
SELECT id, stability, in_degree AS inbound FROM m WHERE stability > 0.5 AND in_degree >= 2
ORDER BY in_degree DESC, id LIMIT 10"""))
def unstable_core(spark, sf):
    return N.unstable_core(nodes(spark, sf, "flow", None), 10, above=0.5, inbound=2).drop("repo")


@query("coupling_fk", "A7", O.sql(FK + "," + O.COUPLING, "SELECT dir1, dir2, cross_edges, score FROM coup"))
def coupling_fk(spark, sf):
    return coupling(spark, sf, "fk").drop("repo")


@query("top_coupling_fk", "T1", O.sql(FK + "," + O.COUPLING, "SELECT dir1, dir2, cross_edges, score FROM topcoup"))
def top_coupling(spark, sf):
    return M.top_coupling(coupling(spark, sf, "fk")).drop("repo")


@query("tight_coupling_fk", "A32", O.sql(FK + "," + O.COUPLING, """
SELECT dir1, dir2, score, score > 0.3 AS high FROM coup WHERE score > 0.1"""))
def tight_coupling(spark, sf):
    return N.tight_coupling(coupling(spark, sf, "fk"), 0.1).select("dir1", "dir2", "score", (F.col("score") > 0.3).alias("high"))


_SCORE = O.COUPLING + f""",
cnt AS (SELECT count(*) AS n, count(*) FILTER (in_degree >= greatest(10, (SELECT max(in_degree) FROM m) * 0.5)) AS god,
  count(*) FILTER (in_degree = 0) AS unused, count(*) FILTER (stability > 0.7 AND in_degree >= 3) AS unstable,
  count(*) FILTER (depth >= 5) AS deep, count(*) FILTER (in_degree >= 5 AND out_degree >= 5) AS hubs,
  (SELECT count(DISTINCT (cycle_id, kind)) FROM cyc) AS cycles, (SELECT count(*) FROM coup WHERE score > 0.3) AS coupled FROM m)"""
for _view in ("fk", "turns", "flow"):
    @query(f"health_score_{_view}", "A18", O.sql(O.metrics(_view) + "," + _SCORE, f"""
SELECT greatest(0, least(100, 100 - least(30, cycles * 10) - least(15, god * 5) - least(15, coupled * 5)
  - least(10, {O.half_up('unused / n * 30')}) - least(10, unstable * 3) - least(10, deep * 2) - least(10, hubs * 3)))::BIGINT AS score,
  cycles, god, coupled, unused, unstable, deep, hubs FROM cnt"""))
    def _score(spark, sf, view=_view):
        b = V.build_of(spark, sf, view)
        return N.health_score(b.nodes, b.cycles, coupling(spark, sf, view)).drop("repo")


_WARN = """,
wr AS MATERIALIZED (SELECT id AS file, CASE WHEN reach_pct >= {rc} OR depth >= {dc} THEN 'critical' ELSE 'warning' END AS severity,
  depth, impact, reach_pct,
  concat_ws('; ', CASE WHEN reach_pct >= {rw} THEN 'pulls in ' || reach_pct || '% of codebase' END,
                  CASE WHEN depth >= {dw} THEN 'dependency chain ' || depth || ' levels deep' END) AS reasons
  FROM nodes WHERE reach_pct >= {rw} OR depth >= {dw})"""
_THRESHOLDS = {"fk": (30, 50, 5, 8), "turns": (30, 50, 4, 6), "flow": (30, 50, 2, 3)}
for _view, (_rw, _rc, _dw, _dc) in _THRESHOLDS.items():
    _ctes = O.metrics(_view) + _WARN.format(rw=_rw, rc=_rc, dw=_dw, dc=_dc)

    @query(f"depth_warnings_{_view}", "A19 F22 T2", O.sql(_ctes, "SELECT * FROM wr"))
    def _warnings(spark, sf, view=_view):
        w = M.depth_warnings(nodes(spark, sf, view), *_THRESHOLDS[view]).orderBy(*M.warning_order())
        return w.select("file", "severity", "depth", "impact", "reach_pct", F.concat_ws("; ", "reasons").alias("reasons"))

    @query(f"warning_summary_{_view}", "A20", O.sql(_ctes, """
SELECT count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'warning')::BIGINT AS warning,
  arg_min(file, (CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, -reach_pct, file)) AS worst FROM wr HAVING count(*) > 0"""))
    def _warning_summary(spark, sf, view=_view):
        return N.warning_summary(M.depth_warnings(nodes(spark, sf, view), *_THRESHOLDS[view])).drop("repo")


_RISKS = ", ".join(f"count(*) FILTER (risk = '{r}')::BIGINT AS {r}" for r in scalars.RISK_ORDER)


@query("risk_counts_fk", "A9", O.sql(FK, f"SELECT {_RISKS} FROM nodes"))
def risk_counts(spark, sf):
    return N.risk_counts(nodes(spark, sf, "fk"), ["repo"]).drop("repo")


@query("risk_counts_per_directory_fk", "A9", O.sql(FK, f"SELECT dir, {_RISKS} FROM nodes GROUP BY dir"))
def risk_counts_per_directory(spark, sf):
    return N.risk_counts(nodes(spark, sf, "fk"), ["repo", "dir"]).drop("repo")


@query("directory_references_fk", "A23 T11", O.sql(FK, """
SELECT dir, count(*)::BIGINT AS files, sum(in_degree)::BIGINT AS refs FROM m GROUP BY dir"""))
def directory_references(spark, sf):
    return N.directory_references(nodes(spark, sf, "fk")).drop("repo")


_COLOUR = """([{colours}])[((16 * (('0x' || substr(md5(dir), 1, 8))::BIGINT + ('0x' || substr(md5(dir), 9, 12))::BIGINT)
  + ('0x' || substr(md5(dir), 21, 12))::BIGINT) % 20)::INT + 1]""".format(colours=", ".join(f"'{c}'" for c in paths.PALETTE))


@query("directory_legend_fk", "A33 F7", O.sql(FK, f"SELECT dir, {_COLOUR} AS color, count(*)::BIGINT AS files FROM m GROUP BY dir"))
def directory_legend(spark, sf):
    return N.directory_legend(nodes(spark, sf, "fk")).drop("repo")


@query("diagnostics_flow", "U5", O.sql(FLOW, """
SELECT member AS file, 'cycle' AS code, 'warning' AS severity FROM cyc
UNION ALL SELECT id, 'depth', 'information' FROM nodes WHERE depth > 3
UNION ALL SELECT id, 'high-impact', 'hint' FROM nodes WHERE reach_pct > 50"""))
def diagnostics(spark, sf):
    b = V.build_of(spark, sf, "flow")
    return N.diagnostics(b.nodes, b.cycles, max_depth=3).drop("repo")


# --- rankings ------------------------------------------------------------------------------

@query("by_inbound_fk", "T3 T10", O.sql(FK, "SELECT id, in_degree FROM m WHERE in_degree >= 1"))
def by_inbound(spark, sf):
    return P.where(nodes(spark, sf, "fk"), P.metric("inbound", ">=", 1)).select("id", "in_degree")


_QUICK = """
SELECT id, CASE WHEN lower(regexp_replace(id, '^.*/', '')) = '{q}' THEN 3
  WHEN starts_with(lower(regexp_replace(id, '^.*/', '')), '{q}') THEN 2 WHEN starts_with(lower(id), '{q}') THEN 1 ELSE 0 END::BIGINT AS score,
  in_degree FROM m WHERE contains(lower(id), '{q}') ORDER BY score DESC, in_degree DESC, id LIMIT 15"""
for _needle, _label in (("1", "digit"), ("nation", "folder")):
    @query(f"quick_jump_{_label}_fk", "T4 F20", O.sql(FK, _QUICK.format(q=_needle)))
    def _quick(spark, sf, needle=_needle):
        return N.quick_jump(nodes(spark, sf, "fk"), needle).drop("repo")


@query("by_risk_fk", "T5 F8", O.sql(FK, """
SELECT id, risk, impact, CASE risk WHEN 'critical' THEN '#ef4444' WHEN 'high' THEN '#f97316' WHEN 'warning' THEN '#eab308'
  WHEN 'normal' THEN '#3b82f6' WHEN 'entry' THEN '#22c55e' ELSE '#6b7280' END AS risk_color FROM nodes"""))
def by_risk(spark, sf):
    return N.by_risk(nodes(spark, sf, "fk")).select("id", "risk", "impact", scalars.risk_color(F.col("risk")).alias("risk_color"))


@query("by_depth_turns", "T6", O.sql(TURNS, "SELECT id, depth FROM m"))
def by_depth(spark, sf):
    return nodes(spark, sf, "turns").orderBy(F.desc("depth"), F.asc("id")).select("id", "depth")


_STORY = " UNION ALL ".join(f"""
SELECT '{name}' AS list, row_number() OVER (ORDER BY v DESC, id)::BIGINT AS rank, id, v AS value
FROM (SELECT id, ({value})::DOUBLE AS v FROM m WHERE {keep}) QUALIFY rank <= 5""" for name, keep, value in (
    ("entry_points", "in_degree = 0", "out_degree"), ("hubs", "in_degree >= 3", "in_degree"),
    ("depth", "depth >= 2", "depth"), ("risks", "impact >= 2 AND stability > 0.6", "impact * stability")))
for _view in ("fk", "turns", "flow"):
    @query(f"report_top_five_{_view}", "T9", O.sql(O.metrics(_view), _STORY))
    def _story(spark, sf, view=_view):
        return N.top_story_nodes(nodes(spark, sf, view)).drop("repo")


@query("bar_share_fk", "W4", O.sql(FK, "SELECT id, in_degree / (SELECT max(in_degree) FROM m) AS share FROM m"))
def bar_share(spark, sf):
    return P.share_of_max(nodes(spark, sf, "fk"), "in_degree", ["repo"]).select("id", "share")


@query("sequential_ids_flow", "W6 S10", O.sql(FLOW, """
SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS short_id FROM n"""))
def sequential_ids(spark, sf):
    return exports.sequential_ids(nodes(spark, sf, "flow")).select("id", "short_id")


# --- timeline ------------------------------------------------------------------------------

def _steps_sql(view: str) -> str:
    return _layers_sql(view) + f""",
big AS (SELECT layer, count(*) AS c FROM lay GROUP BY 1),
cap AS (SELECT greatest(8, ceil(count(*) / 25))::BIGINT AS chunk, count(DISTINCT layer) AS layers FROM lay),
ch AS (SELECT id, layer, {O.dirname('id')} AS dir,
  CASE WHEN (SELECT layers FROM cap) < 12 THEN
    (row_number() OVER (PARTITION BY layer ORDER BY {O.dirname('id')}, id) - 1) // (SELECT chunk FROM cap) ELSE 0 END AS part FROM lay),
stp AS MATERIALIZED (SELECT id, layer, dir, (dense_rank() OVER (ORDER BY layer, part) - 1)::BIGINT AS step FROM ch)"""


for _view in ("fk", "flow"):
    @query(f"timeline_steps_{_view}", "W1", O.sql(_steps_sql(_view), "SELECT id, layer, step FROM stp"))
    def _steps(spark, sf, view=_view):
        return V.stored(spark, sf, "steps", view, make=lambda: T.steps(layers_of(spark, sf, view))) \
            .select("id", "layer", "step")

    @query(f"timeline_roles_{_view}", "W2 A30", O.sql(_steps_sql(_view) + """,
g AS (SELECT step, layer, count(*) AS files FROM stp GROUP BY 1, 2),
tdir AS (SELECT step, dir FROM (SELECT step, dir, row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, dir) AS p
  FROM stp GROUP BY 1, 2) WHERE p = 1),
smp AS (SELECT step, string_agg(regexp_replace(id, '^.*/', ''), ', ' ORDER BY p) AS samples
  FROM (SELECT step, id, row_number() OVER (PARTITION BY step ORDER BY dir, id) AS p FROM stp) WHERE p <= 3 GROUP BY 1),
mx AS (SELECT max(step) AS last_step, max(layer) AS last_layer FROM g)""", """
SELECT g.step, g.files, tdir.dir AS top_dir, smp.samples,
  CASE WHEN g.step = 0 THEN 'Foundation' WHEN g.step = last_step THEN 'Entry points'
       WHEN last_layer > 0 AND g.step / last_layer >= 0.7 THEN 'High-level modules'
       WHEN last_layer > 0 AND g.step / last_layer >= 0.45 THEN 'Mid-level modules'
       WHEN last_layer > 0 AND g.step / last_layer >= 0.2 THEN 'Core modules' ELSE 'Foundation' END AS role
FROM g JOIN tdir USING (step) JOIN smp USING (step), mx"""))
    def _roles(spark, sf, view=_view):
        st = V.stored(spark, sf, "steps", view, make=lambda: T.steps(layers_of(spark, sf, view)))
        return T.describe(st).drop("repo")


# --- layers and rules ----------------------------------------------------------------------

LAYERS = ["Part", "customer", "nation", "supplier", "region"]
_RANK = "list_position(['part', 'customer', 'nation', 'supplier', 'region'], regexp_replace({c}, '/.*$', '')) - 1"
_RAW_EDGES = O.view("fk")


@query("layer_of_path_fk", "F12", O.sql(_RAW_EDGES, f"""
SELECT id, regexp_replace(id, '/.*$', '') AS layer, ({_RANK.format(c='id')})::BIGINT AS rank FROM n"""))
def layer_of_path(spark, sf):
    at = paths.layer_of("id", LAYERS)
    return V.graph_of(spark, sf, "fk").vertices.select("id", at["name"].alias("layer"), at["rank"].alias("rank"))


_VIOL = _RAW_EDGES + f""",
v AS MATERIALIZED (SELECT source, target, regexp_replace(source, '/.*$', '') AS source_layer, regexp_replace(target, '/.*$', '') AS target_layer
  FROM e WHERE {_RANK.format(c='target')} < {_RANK.format(c='source')})"""


@query("layer_violations_fk", "J13", O.sql(_VIOL, "SELECT *, 1::BIGINT AS copies FROM v"))
def layer_violations(spark, sf):
    return R.layer_violations(V.graph_of(spark, sf, "fk").arcs, LAYERS).drop("repo")


@query("violations_per_source_fk", "A25", O.sql(_VIOL, "SELECT source, count(*)::BIGINT AS violations FROM v GROUP BY 1"))
def violations_per_source(spark, sf):
    return R.violations_per_source(R.layer_violations(V.graph_of(spark, sf, "fk").arcs, LAYERS)).drop("repo")


_PER_FILE = "SELECT f AS file, count(*)::BIGINT AS violations FROM (SELECT source AS f FROM v UNION ALL SELECT target FROM v) GROUP BY 1"


@query("violations_per_file_fk", "A25", O.sql(_VIOL, _PER_FILE))
def violations_per_file(spark, sf):
    return R.violations_per_file(R.layer_violations(V.graph_of(spark, sf, "fk").arcs, LAYERS)).drop("repo")


@query("worst_offenders_fk", "T8", O.sql(_VIOL, _PER_FILE + " ORDER BY violations DESC, file LIMIT 8"))
def worst_offenders(spark, sf):
    v = R.layer_violations(V.graph_of(spark, sf, "fk").arcs, LAYERS)
    return R.worst_offenders(R.violations_per_file(v), 8).drop("repo")


OVERRIDES = {"nation/3": 9, "region/1": 0}


def _eff(rank: str) -> str:
    return FK + f""",
rk AS MATERIALIZED (SELECT id, dir, CASE id WHEN 'nation/3' THEN 9 WHEN 'region/1' THEN 0
  ELSE coalesce({rank}, 2) END::BIGINT AS rank FROM m)"""


_NAMED = _eff("list_position(['nation', 'supplier'], regexp_replace(id, '/.*$', '')) - 1")
_NAMES = "CASE {c} WHEN 0 THEN 'nation' WHEN 1 THEN 'supplier' ELSE 'other' END"


def _ranked(spark, sf, layers):
    return R.effective_ranks(nodes(spark, sf, "fk"), layers, OVERRIDES)


@query("rank_violations_fk", "J14 F25", O.sql(_NAMED, f"""
SELECT r.source, r.target, count(*)::BIGINT AS copies, s.rank AS source_rank, t.rank AS target_rank,
  {_NAMES.format(c='s.rank')} AS source_name, {_NAMES.format(c='t.rank')} AS target_name
FROM r JOIN rk s ON s.id = r.source JOIN rk t ON t.id = r.target WHERE s.rank > t.rank GROUP BY ALL"""))
def rank_violations(spark, sf):
    layers = ["Nation", "supplier"]
    return R.rank_violations(V.build_of(spark, sf, "fk").edges, _ranked(spark, sf, layers), layers).drop("repo")


@query("rank_violations_by_depth_fk", "J14 F25", O.sql(_eff("depth"), """
SELECT r.source, r.target, s.rank AS source_rank, t.rank AS target_rank, 'L' || s.rank AS source_name
FROM r JOIN rk s ON s.id = r.source JOIN rk t ON t.id = r.target WHERE s.rank > t.rank"""))
def rank_violations_by_depth(spark, sf):
    return R.rank_violations(V.build_of(spark, sf, "fk").edges, _ranked(spark, sf, None)) \
        .select("source", "target", "source_rank", "target_rank", "source_name")


@query("layer_breakdown_fk", "A24", O.sql(_eff("depth"),
       "SELECT rank, dir, count(*)::BIGINT AS files, 'L' || rank AS layer FROM rk GROUP BY rank, dir"))
def layer_breakdown(spark, sf):
    return R.layer_breakdown(_ranked(spark, sf, None)).drop("repo")


@query("top_directories_per_layer_fk", "W3", O.sql(_eff("depth"), """
SELECT rank, dir, count(*)::BIGINT AS files, row_number() OVER (PARTITION BY rank ORDER BY count(*) DESC, dir) AS place
FROM rk GROUP BY rank, dir QUALIFY place <= 3"""))
def top_directories(spark, sf):
    return R.top_directories(R.layer_breakdown(_ranked(spark, sf, None))).select("rank", "dir", "files", "place")


RULES = [("forbidden", "customer", "region"), ("required", "supplier", "nation"), ("forbidden", "part/1", "supplier/7"),
         ("required", "part/19", "/5"), ("forbidden", " ", "x")]


def _rules_sql() -> str:
    out = []
    for kind, s, t in RULES:
        if not s.strip() or not t.strip():
            continue
        test, verb = (f"contains(target, '{t}')", "must not depend on") if kind == "forbidden" \
            else (f"NOT contains(target, '{t}')", "must only depend on")
        out.append(f"SELECT source, target, 1::BIGINT AS copies, '{kind}' AS rule_type, '{s} {verb} {t}' AS rule_desc FROM e "
                   f"WHERE contains(source, '{s}') AND {test}")
    return " UNION ALL ".join(out)


@query("rule_violations_fk", "J15 J16 F24", O.sql(_RAW_EDGES, _rules_sql()))
def rule_violations(spark, sf):
    return R.rule_violations(V.graph_of(spark, sf, "fk").arcs, RULES).drop("repo")


# --- neighbours ----------------------------------------------------------------------------

@query("direct_dependents_fk", "J17", O.sql(FK, "SELECT target AS id, source AS dependent FROM rd WHERE starts_with(target, 'nation/')"))
def direct_dependents(spark, sf):
    seeds = nodes(spark, sf, "fk").where("dir = 'nation'").select(F.col("vid").alias("dst"))
    return V.build_of(spark, sf, "fk").reduced.arcs.join(seeds, "dst", "left_semi") \
        .select(F.col("target").alias("id"), F.col("source").alias("dependent"))


@query("direct_dependencies_fk", "J17", O.sql(FK, "SELECT source AS id, target AS dependency FROM rd WHERE starts_with(source, 'supplier/')"))
def direct_dependencies(spark, sf):
    seeds = nodes(spark, sf, "fk").where("dir = 'supplier'").select(F.col("vid").alias("src"))
    return V.build_of(spark, sf, "fk").reduced.arcs.join(seeds, "src", "left_semi") \
        .select(F.col("source").alias("id"), F.col("target").alias("dependency"))


@query("mini_graph_fk", "J19 W3", O.sql(FK, """
SELECT x.id, x.dep, x.place, x.more, CASE WHEN s.c IS NULL THEN '' WHEN s.c <= 4 THEN s.four
  ELSE s.three || ', +' || (s.c - 3) || ' more' END AS second_level
FROM (SELECT source AS id, target AS dep, row_number() OVER (PARTITION BY source ORDER BY target) AS place,
        greatest(count(*) OVER (PARTITION BY source) - 8, 0)::BIGINT AS more FROM rd QUALIFY place <= 8) x
LEFT JOIN (SELECT source, max(c) AS c, string_agg(target, ', ' ORDER BY target) FILTER (p <= 4) AS four,
             string_agg(target, ', ' ORDER BY target) FILTER (p <= 3) AS three
           FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS p,
                   count(*) OVER (PARTITION BY source) AS c FROM rd) GROUP BY 1) s ON s.source = x.dep"""))
def mini_graph_fk(spark, sf):
    return mini_graph(V.build_of(spark, sf, "fk").reduced.arcs).drop("repo")


@query("node_for_import_fk", "J20", O.sql(FK + """,
q AS (SELECT id AS raw FROM n WHERE starts_with(id, 'region/') UNION ALL SELECT regexp_replace(id, '^.*/', '') FROM n WHERE starts_with(id, 'customer/')
      UNION ALL SELECT replace(id, '/', '.') FROM n WHERE starts_with(id, 'supplier/') UNION ALL SELECT 'none/' || id FROM n WHERE starts_with(id, 'nation/'))""", """
SELECT raw, coalesce((SELECT min(id) FROM n WHERE id = raw), (SELECT min(id) FROM n WHERE ends_with(id, '/' || raw)),
  (SELECT min(id) FROM n WHERE id = replace(raw, '.', '/'))) AS id FROM q"""))
def node_for_import(spark, sf):
    v = V.graph_of(spark, sf, "fk").vertices
    texts = (v.where("id like 'region/%'").select("repo", F.col("id").alias("raw"))
             .unionByName(v.where("id like 'customer/%'").select("repo", paths.basename("id").alias("raw")))
             .unionByName(v.where("id like 'supplier/%'").select("repo", F.translate("id", "/", ".").alias("raw")))
             .unionByName(v.where("id like 'nation/%'").select("repo", F.concat(F.lit("none/"), "id").alias("raw"))))
    return nodes_for_imports(texts, v).select("raw", "id")


# --- exports -------------------------------------------------------------------------------

for _view in ("fk", "flow"):
    @query(f"dot_edges_{_view}", "S9", O.sql(O.metrics(_view), """
SELECT '  "' || source || '" -> "' || target || '" [' || CASE WHEN is_cycle THEN 'color="#ef4444", penwidth=2, style=bold'
  ELSE 'color="#94a3b8"' END || '];' AS line, copies FROM w"""))
    def _dot_edges(spark, sf, view=_view):
        return exports.dot_edge_lines(V.build_of(spark, sf, view).edges).select("line", "copies")

    @query(f"mermaid_edges_{_view}", "S10 F13", O.sql(O.metrics(_view), """
SELECT '  ' || translate(source, '/.-', '___') || CASE WHEN is_cycle THEN ' -.->|cycle| ' ELSE ' --> ' END
  || translate(target, '/.-', '___') AS line, copies FROM w"""))
    def _mermaid_edges(spark, sf, view=_view):
        return exports.mermaid_edge_lines(V.build_of(spark, sf, view).edges).select("line", "copies")


@query("dot_document_fk", "S9")
def dot_document(spark, sf):
    b = V.build_of(spark, sf, "fk")
    return exports.dot(b.nodes, b.edges).select("section", "line")


@query("dot_document_by_directory_fk", "S9")
def dot_document_by_directory(spark, sf):
    b = V.build_of(spark, sf, "fk")
    return exports.dot(b.nodes, b.edges, color_by="directory").select("section", "line")


@query("mermaid_document_flow", "S10")
def mermaid_document(spark, sf):
    b = V.build_of(spark, sf, "flow")
    return exports.mermaid(b.nodes, b.edges).select("section", "line")


@query("mermaid_numbered_flow", "S10 W6", O.sql(FLOW + """,
num AS (SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS s FROM n)""", """
SELECT '  ' || a.s || CASE WHEN is_cycle THEN ' -. cycle .-> ' ELSE ' --> ' END || b.s AS line, copies
FROM w JOIN num a ON a.id = w.source JOIN num b ON b.id = w.target"""))
def mermaid_numbered(spark, sf):
    b = V.build_of(spark, sf, "flow")
    return exports.numbered_edge_lines(b.nodes, b.edges).select("line", "copies")


@query("snapshot_round_trip_fk", "S7 S8", O.sql(FK, f"SELECT {', '.join(c for c in NODE_COLUMNS if c != 'dir')} FROM nodes"))
def snapshot_round_trip(spark, sf):
    b = V.build_of(spark, sf, "fk")
    lines = snapshots.to_lines(b.nodes, b.edges)
    return snapshots.nodes_of(snapshots.from_lines(lines)).select(*[c for c in NODE_COLUMNS if c != "dir"])


@query("snapshot_round_trip_edges_flow", "S7 S8", O.sql(FLOW, "SELECT source, target, copies, is_cycle, weight FROM w"))
def snapshot_round_trip_edges(spark, sf):
    b = V.build_of(spark, sf, "flow")
    lines = snapshots.to_lines(b.nodes, b.edges)
    return snapshots.edges_of(snapshots.from_lines(lines)).select("source", "target", "copies", "is_cycle", "weight")


@query("insights_lines_fk", "S12")
def insights_lines(spark, sf):
    b = V.build_of(spark, sf, "fk")
    return report.insight_lines(b, coupling(spark, sf, "fk")).select("section", "line")


@query("story_fk", "F28")
def story_fk(spark, sf):
    return report.story(V.build_of(spark, sf, "fk"), coupling(spark, sf, "fk")).drop("repo")


@query("story_flow", "F28")
def story_flow(spark, sf):
    return report.story(V.build_of(spark, sf, "flow"), coupling(spark, sf, "flow")).drop("repo")
