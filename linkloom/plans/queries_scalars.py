"""Column functions over graph ids, and commit churn."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import languages as L
from linkloom.functions import paths, scalars
from linkloom.operators import churn as C
from linkloom.plans import oracle as O
from linkloom.plans import views as V
from linkloom.plans.catalog import query
from linkloom.sources.commits import parse_commits

NODES = O.view("fk")


def ids(spark, sf):
    return V.graph_of(spark, sf, "fk").vertices.select("id")


@query("dirname_basename", "F1 F2", O.sql(NODES, f"SELECT id, {O.dirname('id')} AS dir, {O.basename('id')} AS base FROM n"))
def dirname_basename(spark, sf):
    return ids(spark, sf).select("id", paths.directory("id").alias("dir"), paths.basename("id").alias("base"))


# Two dots in turn with the key, so names with one, several and only leading dots occur.
_DOTTED = "CASE WHEN ends_with(id, '1') THEN replace(id, '/', '/.') WHEN ends_with(id, '2') THEN id || '.min.js' ELSE id || '.py' END"


@query("extension", "F3 P1 F23 F26", O.sql(NODES, f"""
SELECT p, CASE WHEN regexp_matches({O.basename('p')}, '^\\.*[^.].*\\.') THEN regexp_extract(p, '(\\.[^./]*)$', 1) ELSE '' END AS ext,
  CASE WHEN ends_with(p, '.py') THEN 'py' WHEN ends_with(p, '.js') THEN 'js' END AS language,
  CASE WHEN ends_with(p, '.py') THEN 'python' WHEN ends_with(p, '.js') THEN 'javascript' ELSE 'plaintext' END AS preview,
  CASE WHEN ends_with(p, '.py') THEN 'PY' WHEN ends_with(p, '.js') THEN 'JS' END AS tag
FROM (SELECT {_DOTTED} AS p FROM n)"""))
def extension(spark, sf):
    p = ids(spark, sf).select(F.when(F.endswith("id", F.lit("1")), F.replace("id", F.lit("/"), F.lit("/.")))
                              .when(F.endswith("id", F.lit("2")), F.concat("id", F.lit(".min.js")))
                              .otherwise(F.concat("id", F.lit(".py"))).alias("p"))
    return p.select("p", paths.extension("p").alias("ext"), L.language_of("p").alias("language"),
                    L.preview_language("p").alias("preview"), L.file_tag("p").alias("tag"))


@query("normalized_path", "F4", O.sql(NODES, """
SELECT id, id AS plain, 'a/' || id AS dots, CASE WHEN TRUE THEN '../' || id END AS above FROM n"""))
def normalized_path(spark, sf):
    p = F.col("id")
    return ids(spark, sf).select(
        "id", paths.normalize(p).alias("plain"),
        paths.normalize(F.concat(F.lit("./a//b/../"), p, F.lit("/."))).alias("dots"),
        paths.normalize(F.concat(F.lit("x/../../"), p)).alias("above"))


@query("dotted_to_path", "F5 F6", O.sql(NODES, """
SELECT id, replace(id, '/', '.') AS dotted, 'my_app' || replace(id, '/', '_') AS snake FROM n"""))
def dotted_to_path(spark, sf):
    p = F.col("id")
    dotted = F.translate(p, "/", ".")
    return ids(spark, sf).select(F.translate(dotted, ".", "/").alias("id"), dotted.alias("dotted"),
                                 paths.snake_case(F.concat(F.lit("MyApp"), F.translate(p, "/", "_"))).alias("snake"))


@query("directory_colour", "F7", O.sql(NODES + f", x AS (SELECT id, {O.dirname('id')} AS dir FROM n)", """
SELECT id, ([{c}])[((16 * (('0x' || substr(md5(dir), 1, 8))::BIGINT + ('0x' || substr(md5(dir), 9, 12))::BIGINT)
  + ('0x' || substr(md5(dir), 21, 12))::BIGINT) % 20)::INT + 1] AS color FROM x""".format(
      c=", ".join(f"'{x}'" for x in paths.PALETTE))))
def directory_colour(spark, sf):
    return ids(spark, sf).select("id", paths.dir_color("id").alias("color"))


@query("export_ids", "F13", O.sql(NODES, """
SELECT id, translate(id || '.h-x', '/.-', '___') AS mermaid, regexp_replace(id || '.h-x y', '[^a-zA-Z0-9_]', '_', 'g') AS word FROM n"""))
def export_ids(spark, sf):
    return ids(spark, sf).select("id", paths.mermaid_id(F.concat("id", F.lit(".h-x"))).alias("mermaid"),
                                 paths.word_id(F.concat("id", F.lit(".h-x y"))).alias("word"))


@query("ancestor_directories", "F19", O.sql(O.view("flow"), """
SELECT id, string_split(id, '/')[1] || ';' || array_to_string(string_split(id, '/')[1:2], '/') AS above FROM n"""))
def ancestor_directories(spark, sf):
    return V.graph_of(spark, sf, "flow").vertices.select("id", F.array_join(paths.ancestors("id"), ";").alias("above"))


@query("repository_url", "F17", O.sql(NODES, """
SELECT id, 'https://github.com/' || id || '.git' AS short, 'https://gitlab.com/' || id || '.git' AS long, NULL::VARCHAR AS other FROM n"""))
def repository_url(spark, sf):
    p = F.col("id")
    return ids(spark, sf).select(
        "id", scalars.repository_url(F.concat(F.lit(" "), p)).alias("short"),
        scalars.repository_url(F.concat(F.lit("http://GitLab.com/"), p, F.lit(".git/"))).alias("long"),
        scalars.repository_url(F.concat(F.lit("ftp://example.org/"), p)).alias("other"))


@query("severity_badges_fk", "F21 F8", O.sql(O.metrics("fk"), """
SELECT id, CASE WHEN depth > 5 THEN 'red' WHEN depth > 2 THEN 'yellow' ELSE 'green' END AS depth_badge,
  CASE WHEN impact > 10 THEN 'red' WHEN impact > 3 THEN 'yellow' ELSE 'green' END AS impact_badge,
  CASE WHEN stability > 0.7 THEN 'red' WHEN stability < 0.3 THEN 'green' ELSE 'yellow' END AS stability_badge FROM m"""))
def severity_badges(spark, sf):
    return V.build_of(spark, sf, "fk").nodes.select(
        "id", scalars.level_badge(F.col("depth"), 2, 5).alias("depth_badge"),
        scalars.level_badge(F.col("impact"), 3, 10).alias("impact_badge"),
        scalars.stability_badge(F.col("stability")).alias("stability_badge"))


@query("rounding_families", "F11", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, format('{:.1f}', l_extendedprice * l_discount)::DOUBLE AS even1,
  format('{:.3f}', l_extendedprice * l_tax / 7)::DOUBLE AS even3, floor(l_extendedprice * l_tax * 10.0 + 0.5) / 10.0 AS up1 FROM lineitem""")
def rounding_families(spark, sf):
    x = F.col("l_extendedprice")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.round_half_even(x * F.col("l_discount"), 1).alias("even1"),
        scalars.round_half_even(x * F.col("l_tax") / 7, 3).alias("even3"),
        scalars.round_half_up(x * F.col("l_tax"), 1).alias("up1"))


_LANGS = {"c": "#555555", "py": "#3776ab", "go": "#00add8"}


@query("language_colour", "F27", O.sql(NODES, """
SELECT p, CASE WHEN ends_with(p, '.go') THEN '#00add8' WHEN ends_with(p, '.rs') THEN '#ce422b' END AS color
FROM (SELECT id || CASE WHEN starts_with(id, 'part') THEN '.go' WHEN starts_with(id, 'nation') THEN '.rs' ELSE '' END AS p FROM n)"""))
def language_colour(spark, sf):
    p = ids(spark, sf).select(F.concat("id", F.when(F.startswith("id", F.lit("part")), F.lit(".go"))
                                       .when(F.startswith("id", F.lit("nation")), F.lit(".rs")).otherwise(F.lit(""))).alias("p"))
    return p.select("p", L.language_color(L.language_of("p")).alias("color"))


# --- churn ---------------------------------------------------------------------------------

# The events as a commit history: a file per user and event type, the user's agent as author.
_PATH = "'src/user' || user_id || '.py'"
COMMITS = f"""
c AS MATERIALIZED (SELECT {_PATH} AS path, event_type AS author, date_trunc('second', ts) AS ts FROM events),
now AS (SELECT max(ts) AS t FROM c),
per AS (SELECT path, count(*)::BIGINT AS commits, count(*) FILTER (ts >= t - INTERVAL 7 DAY)::BIGINT AS recent,
  count(DISTINCT author)::BIGINT AS authors, strftime(max(ts), '%Y-%m-%d') AS last_date
  FROM c, now WHERE ts >= date_trunc('day', t - INTERVAL 21 DAY) GROUP BY path),
mx AS (SELECT greatest(max(commits), 1) AS mc, greatest(max(recent), 1) AS mr, greatest(max(authors), 1) AS ma FROM per),
ch AS MATERIALIZED (SELECT path, commits, recent, authors, last_date,
  {O.rounded('0.45::DOUBLE * (recent / mr) + 0.40::DOUBLE * (commits / mc) + 0.15::DOUBLE * (authors / ma)', 4)} AS churn_score FROM per, mx)
"""


def commit_records(spark, sf):
    """The events rendered as commit log records, as a log reader would split them."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return V.table(spark, sf, "events").select(F.lit("events").alias("repo"), F.concat(
        F.sha1(F.col("event_id").cast("string")), F.lit("|"), "event_type", F.lit("|"), ts, F.lit("\n\nsrc/user"),
        F.col("user_id").cast("string"), F.lit(".py\n")).alias("value"))


def commits(spark, sf):
    return V.stored(spark, sf, "commits", make=lambda: parse_commits(commit_records(spark, sf)))


def churned(spark, sf):
    def make():
        log = commits(spark, sf)
        return C.churn(log, log.select(F.max("ts")).scalar(), days=21, recent_days=7)
    return V.stored(spark, sf, "churn", make=make)


@query("commit_log", "S5 F18", O.sql(COMMITS, "SELECT path, author, epoch(ts)::BIGINT AS second, count(*)::BIGINT AS touches FROM c GROUP BY ALL"))
def commit_log(spark, sf):
    return commits(spark, sf).groupBy("path", "author", F.unix_seconds("ts").alias("second")) \
        .agg(F.count(F.lit(1)).alias("touches"))


@query("churn_per_file", "A21 A22", O.sql(COMMITS, "SELECT * FROM ch"))
def churn_per_file(spark, sf):
    return churned(spark, sf).drop("repo")


@query("hottest_files", "T12", O.sql(COMMITS, "SELECT path, churn_score FROM ch ORDER BY churn_score DESC, path LIMIT 5"))
def hottest_files(spark, sf):
    return C.hottest(churned(spark, sf)).select("path", "churn_score")


def _as_fk(spark, sf):
    """Churn of users read as churn of the customers with the same number."""
    number = F.regexp_extract("path", r"user(\d+)", 1)
    return churned(spark, sf).withColumn("repo", F.lit("fk")).withColumn("path", F.concat(F.lit("supplier/"), number))


_FK_CHURN = COMMITS + "," + O.metrics("fk") + ", fc AS (SELECT 'supplier/' || regexp_extract(path, 'user(\\d+)', 1) AS id, churn_score, commits FROM ch)"


@query("nodes_with_churn_fk", "J10", O.sql(_FK_CHURN, """
SELECT m.id, coalesce(commits, 0)::BIGINT AS commits, coalesce(churn_score, 0) AS churn_score FROM m LEFT JOIN fc ON fc.id = m.id"""))
def nodes_with_churn(spark, sf):
    return C.with_churn(V.build_of(spark, sf, "fk").nodes, _as_fk(spark, sf)).select("id", "commits", "churn_score")


@query("hot_files_fk", "J11", O.sql(_FK_CHURN, """
SELECT nodes.id, risk, fc.churn_score FROM nodes JOIN fc ON fc.id = nodes.id WHERE risk IN ('critical', 'high', 'warning', 'normal') AND fc.churn_score > 0.6
  AND risk IN ('critical', 'high')"""))
def hot_files(spark, sf):
    return C.hot_files(V.build_of(spark, sf, "fk").nodes, _as_fk(spark, sf)).select("id", "risk", "churn_score")


@query("churn_colours", "F16", O.sql(COMMITS, """
SELECT path, '#' || format('{:02x}', r) || format('{:02x}', g) || format('{:02x}', b) AS color FROM (
  SELECT path, CASE WHEN s <= 0.5 THEN floor(59 + 175 * (s / 0.5) + 0.5) ELSE floor(234 + 5 * ((s - 0.5) / 0.5) + 0.5) END::INT AS r,
    CASE WHEN s <= 0.5 THEN floor(130 + 49 * (s / 0.5) + 0.5) ELSE floor(179 - 111 * ((s - 0.5) / 0.5) + 0.5) END::INT AS g,
    CASE WHEN s <= 0.5 THEN floor(246 - 238 * (s / 0.5) + 0.5) ELSE floor(8 + 60 * ((s - 0.5) / 0.5) + 0.5) END::INT AS b
  FROM (SELECT path, churn_score AS s FROM ch))"""))
def churn_colours(spark, sf):
    return churned(spark, sf).select("path", scalars.churn_color(F.col("churn_score")).alias("color"))
