"""SQL for the checks. Each function returns common table expressions to put a SELECT after.

The text is written for an independent engine: recursive closure and plain joins, without any
of the shortcuts the operators take.
"""

from __future__ import annotations


def rounded(x: str, digits: int) -> str:
    """Python's ``round``: the exact binary value, half to even."""
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE"


def half_up(x: str, digits: int = 0) -> str:
    s = 10 ** digits
    return f"(floor(({x})::DOUBLE * {s}.0 + 0.5) / {s}.0)"


def dirname(p: str) -> str:
    return f"(CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END)"


def basename(p: str) -> str:
    return f"regexp_replace({p}, '^.*/', '')"


FK = """
e AS MATERIALIZED (
  SELECT 'customer/' || c_custkey AS source, 'nation/' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem
  UNION ALL SELECT 'customer/' || c_custkey, 'region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier/' || s_suppkey, 'region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS MATERIALIZED (
  SELECT 'customer/' || c_custkey AS id FROM customer UNION SELECT 'supplier/' || s_suppkey FROM supplier
  UNION SELECT 'nation/' || n_nationkey FROM nation UNION SELECT 'region/' || r_regionkey FROM region
  UNION SELECT 'part/' || p_partkey FROM part UNION SELECT source FROM e UNION SELECT target FROM e)
"""

FK_DIRECT = """
e AS MATERIALIZED (
  SELECT 'customer/' || c_custkey AS source, 'nation/' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem)
"""

TURNS = """
e AS MATERIALIZED (
  SELECT 'conv/' || conv_id || '/t' || turn AS source, 'conv/' || conv_id || '/t' || (turn - 1) AS target
  FROM conversations WHERE turn > 0),
n AS MATERIALIZED (
  SELECT 'conv/' || conv_id || '/t' || turn AS id FROM conversations
  UNION SELECT source FROM e UNION SELECT target FROM e)
"""

FLOW = """
st AS MATERIALIZED (
  SELECT user_id, ts, event_id, event_type, date_diff('day', DATE '2024-01-01', ts::DATE) // 3 AS span,
         'user' || user_id || '/s' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 3) || '/' || event_type AS state
  FROM events),
e AS MATERIALIZED (
  SELECT * FROM (SELECT state AS source,
                        lead(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM st)
  WHERE target IS NOT NULL),
n AS MATERIALIZED (SELECT DISTINCT state AS id FROM st)
"""

VIEWS = {"fk": FK, "turns": TURNS, "flow": FLOW}


def closure_of(edges: str, name: str) -> str:
    return f"""
{name}(a, b) AS (
  SELECT DISTINCT source, target FROM {edges}
  UNION SELECT {name}.a, x.target FROM {name} JOIN (SELECT DISTINCT source, target FROM {edges}) x ON {name}.b = x.source)
"""


def components_of(reach: str, name: str) -> str:
    """Vertices of components with several members."""
    return f"""
{name} AS MATERIALIZED (
  SELECT x.a AS id, least(x.a, min(x.b)) AS comp FROM {reach} x JOIN {reach} y ON x.a = y.b AND x.b = y.a
  WHERE x.a <> x.b GROUP BY x.a)
"""


def view(name: str) -> str:
    return VIEWS[name]


def reduced(name: str) -> str:
    """e, n, d (distinct), tc (closure), red (redundant), r (reduced bag), rd (reduced, distinct)."""
    return view(name) + "," + """
d AS MATERIALIZED (SELECT DISTINCT source, target FROM e),
""" + closure_of("d", "tc") + """,
red AS MATERIALIZED (
  SELECT DISTINCT x.source, x.target FROM d x JOIN d y ON x.source = y.source AND y.target <> x.target
  JOIN tc ON tc.a = y.target AND tc.b = x.target),
r AS MATERIALIZED (SELECT e.source, e.target FROM e ANTI JOIN red ON e.source = red.source AND e.target = red.target),
rd AS MATERIALIZED (SELECT DISTINCT source, target FROM r)
"""


def metrics(name: str, edges: str = "r") -> str:
    """Adds rtc, scc, cd (condensed), lv, m (node metrics), nodes (with reach and risk), w (edges)."""
    base = reduced(name) if edges == "r" else view(name) + ", rd AS MATERIALIZED (SELECT DISTINCT source, target FROM e), r AS (SELECT * FROM e)"
    risk = """
  CASE WHEN id LIKE 'system:%' OR id LIKE '<%' THEN 'system'
       WHEN in_cycle OR in_degree >= (CASE WHEN total <= 10 THEN 5 WHEN total <= 50 THEN 8 ELSE greatest(10, total // 5) END)
            OR reach_pct >= 50 THEN 'critical'
       WHEN in_degree >= (CASE WHEN total <= 10 THEN 3 WHEN total <= 50 THEN 5 ELSE greatest(5, total // 10) END)
            OR reach_pct >= 30 THEN 'high'
       WHEN out_degree >= (CASE WHEN total <= 10 THEN 4 WHEN total <= 50 THEN 6 ELSE greatest(8, total // 8) END) THEN 'warning'
       WHEN in_degree = 0 THEN 'entry' ELSE 'normal' END"""
    return base + "," + closure_of("rd", "rtc") + "," + components_of("rtc", "scc") + f""",
cd AS MATERIALIZED (
  SELECT DISTINCT coalesce(a.comp, source) AS source, coalesce(b.comp, target) AS target
  FROM rd LEFT JOIN scc a ON a.id = source LEFT JOIN scc b ON b.id = target
  WHERE coalesce(a.comp, source) <> coalesce(b.comp, target)),
lv(id, k) AS (SELECT source, 1 FROM cd UNION SELECT cd.source, lv.k + 1 FROM lv JOIN cd ON cd.target = lv.id),
dep AS (SELECT id, max(k) AS depth FROM lv GROUP BY id),
ind AS (SELECT target AS id, count(*) AS c FROM r GROUP BY 1),
outd AS (SELECT source AS id, count(*) AS c FROM r GROUP BY 1),
imp AS (SELECT b AS id, count(DISTINCT a) AS c FROM rtc WHERE a <> b GROUP BY 1),
m AS MATERIALIZED (
  SELECT n.id, coalesce(ind.c, 0)::BIGINT AS in_degree, coalesce(outd.c, 0)::BIGINT AS out_degree,
         coalesce(dep.depth, 0)::BIGINT AS depth, coalesce(imp.c, 0)::BIGINT AS impact, scc.comp IS NOT NULL AS in_cycle,
         {dirname('n.id')} AS dir,
         CASE WHEN coalesce(ind.c, 0) + coalesce(outd.c, 0) > 0
              THEN {rounded('coalesce(outd.c, 0) / (coalesce(ind.c, 0) + coalesce(outd.c, 0))', 3)} ELSE 0.5 END AS stability,
         (80 + 40 * coalesce(ind.c, 0))::BIGINT AS size
  FROM n LEFT JOIN ind USING (id) LEFT JOIN outd USING (id) LEFT JOIN imp USING (id)
  LEFT JOIN scc ON scc.id = n.id LEFT JOIN dep ON dep.id = coalesce(scc.comp, n.id)),
reached AS (SELECT *, {rounded('impact / total * 100', 1)} AS reach_pct FROM m, (SELECT count(*) AS total FROM m) t),
nodes AS MATERIALIZED (SELECT id, in_degree, out_degree, depth, impact, in_cycle, dir, stability, size, reach_pct,
  {risk} AS risk FROM reached),
w AS MATERIALIZED (
  SELECT r.source, r.target, count(*)::BIGINT AS copies,
         any_value(r.source = r.target OR coalesce(a.comp = b.comp, FALSE)) AS is_cycle,
         any_value({rounded('1 + 4 * least(t.in_degree / greatest(mx.top, 1) * 0.6 + t.reach_pct / 100 * 0.4, 1)', 2)}) AS weight
  FROM r JOIN nodes t ON t.id = r.target, (SELECT max(in_degree) AS top FROM m) mx
  LEFT JOIN scc a ON a.id = r.source LEFT JOIN scc b ON b.id = r.target GROUP BY 1, 2),
cyc AS MATERIALIZED (
  SELECT comp AS cycle_id, 'group' AS kind, id AS member, count(*) OVER (PARTITION BY comp) AS size FROM scc
  UNION ALL SELECT source, 'loop', source, 1 FROM rd WHERE source = target)
"""


COUPLING = f"""
sd AS (SELECT {dirname('source')} AS d1, {dirname('target')} AS d2 FROM r),
tch AS (SELECT d, count(*) AS c FROM (SELECT d1 AS d FROM sd UNION ALL SELECT d2 FROM sd) GROUP BY 1),
coup AS MATERIALIZED (
  SELECT dir1, dir2, x.c::BIGINT AS cross_edges, {rounded('x.c / (t1.c + t2.c)', 3)} AS score
  FROM (SELECT least(d1, d2) AS dir1, greatest(d1, d2) AS dir2, count(*) AS c FROM sd WHERE d1 <> d2 GROUP BY 1, 2) x
  JOIN tch t1 ON t1.d = dir1 JOIN tch t2 ON t2.d = dir2),
topcoup AS (SELECT * FROM coup ORDER BY cross_edges DESC, dir1, dir2 LIMIT 20)
"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"
