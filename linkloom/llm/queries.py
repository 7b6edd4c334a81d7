"""Queries of the training-data operators, with their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontam, htmltext, mixing, phrases, pieces, secrets, sharding, simhash, spelling, toolcalls, toxicity, vectors, warc
from linkloom.llm.common import table
from linkloom.store import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of eight documents, sources weighted by the square root of their size; weights are exact."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    weights = mixing.temperature_weights(docs.select("source"))
    return mixing.mix(docs, weights).select("doc_id", "source", "block", "slot", "position", "on_target")


SQL["op1_mixing"] = f"""
WITH RECURSIVE w AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
q AS (SELECT source, n, greatest(1, floor(w / max(w) OVER () * {float(1 << mixing.SHARE_BITS)}))::BIGINT AS share,
             row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM w),
a AS (SELECT list(share::HUGEINT ORDER BY i) AS share, list(n ORDER BY i) AS n FROM q),
run(slot, since, ran, base, live, ok, pick, block, first, before) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(n, lambda x: 0::BIGINT), list_transform(n, lambda x: 0::BIGINT), share, true,
         NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM a WHERE len(n) > 0
  UNION ALL
  SELECT CASE WHEN dry THEN slot ELSE slot + 1 END, CASE WHEN dry THEN slot ELSE since END,
         CASE WHEN dry THEN ran ELSE list_transform(ran, lambda x, i: CASE WHEN i = j THEN x + 1 ELSE x END) END,
         CASE WHEN dry THEN ran ELSE base END,
         CASE WHEN dry THEN list_transform(live, lambda x, i: CASE WHEN ran[i] * {mixing.BLOCK_ROWS} >= n[i] THEN 0::HUGEINT ELSE x END)
              ELSE live END,
         ok AND NOT dry, CASE WHEN NOT dry THEN j END, CASE WHEN NOT dry THEN ran[j] END,
         CASE WHEN dry THEN first ELSE first + least({mixing.BLOCK_ROWS}, n[j] - ran[j] * {mixing.BLOCK_ROWS}) END, first
  FROM (SELECT *, ran[j] * {mixing.BLOCK_ROWS} >= n[j] AS dry FROM (
    SELECT run.*, a.n, (list_min(list_transform(list_filter(range(1, len(n) + 1), lambda i:
        live[i] > 0 AND (ran[i] - base[i]) * list_sum(live)::HUGEINT // greatest(live[i], 1) <= slot - since),
      lambda i: (((ran[i] - base[i] + 1) * list_sum(live)::HUGEINT + live[i] - 1) // live[i]) * 1000000 + i)) % 1000000)::BIGINT AS j
    FROM run, a WHERE list_sum(live) > 0))),
slots AS (SELECT pick AS i, block, slot - 1 AS slot, before, ok AS on_target FROM run WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source
        ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))) - 1 AS r FROM documents)
SELECT doc_id, d.source, slots.block, slot, before + r % {mixing.BLOCK_ROWS} AS position, on_target
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN slots ON slots.i = q.i AND slots.block = r // {mixing.BLOCK_ROWS}
"""


@query
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents over 40 shards of equal counts."""
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    put = sharding.shard_rows(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 40)
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their SimHash and the smallest doc_id they reach over three bits."""
    found = simhash.near_copies(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that overlap with benchmark items: one row per document and item."""
    found = decontam.find_overlaps(table(spark, sf, "documents").select("doc_id", "text"),
                                   table(spark, sf, "benchmark"))
    hits = found.where(F.size("overlaps") > 0).select("doc_id", F.explode("overlaps").alias("o"))
    return (hits.groupBy("doc_id", "o.item_id")
            .agg(F.max("o.n_equal").alias("n_equal"), F.max("o.n_tokens").alias("n_tokens"), F.count("*").alias("n_places")))


@query
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of three kinds in all documents, with a digest of their places."""
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    shown = F.array_join(F.transform("secrets", lambda x: F.concat_ws(
        ":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = [F.size(F.filter("secrets", lambda x, i=i: x["kind"] == i)).cast("long").alias(f"n_{r.kind}")
             for i, r in enumerate(secrets.RULES)]
    return found.select("doc_id", *count, F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))


@query
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written as archives, among broken copies of every seventh record, and read back."""
    pages = warc.assign_types(table(spark, sf, "pages").select("page_id", "url", "html"))
    archives = materialize(warc.write_archives(pages, broken=7), "warc")
    back = warc.read_archives(archives).where("record_type <> 'gap' and valid and sound")
    page = F.expr("cast(nullif(page_id, '') as bigint)").alias("page_id")
    return back.select(page, "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"), "gap_bytes")


@query
def op6_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of all pages."""
    got = htmltext.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of all documents."""
    got = toxicity.score_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return got.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies among all embeddings."""
    return vectors.near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


def tool_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of conversations stand for: a user's turn calls a tool and waits for the
    turn two before, an assistant's turn answers the call of the turn before. Every third call lacks an argument."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).cast("long")
    name = F.get(F.array(F.lit("answer"), F.lit("look_up"), F.lit("rewrite")), F.pmod(F.col("turn"), F.lit(3)).cast("int"))
    call = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", call.alias("call_id"), "turn", name.alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("query"),
                           F.when(F.col("conv_id") % 3 != 0, words).alias("limit"))).alias("arguments"),
        F.array(F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = conversations.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn",
        F.col("text").alias("content"))
    return calls, results


TOOLS = [("answer", "query", "string", True), ("answer", "turn", "integer", True), ("answer", "limit", "number", False),
         ("look_up", "query", "string", True), ("look_up", "turn", "integer", True), ("look_up", "limit", "integer", True),
         ("rewrite", "query", "string", True), ("rewrite", "turn", "string", False)]


@query
def op3_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all conversations as tool calls, linked, ordered, validated and serialised."""
    calls, results = tool_events(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    got = toolcalls.link_calls(calls, results, schemas, every_result=True)
    return got.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "status", "valid",
                      F.array_join("errors", ",").alias("errors"), "n_results", "json")


SQL["op3_tool_calls"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, coalesce(text, '') AS query,
         ['answer', 'look_up', 'rewrite'][turn % 3 + 1] AS name, 'call_' || (turn - 2) AS dep,
         CASE WHEN conv_id % 3 <> 0 THEN len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) END AS lim
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, min({'t': turn, 'x': text}) AS f, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY ALL),
many AS (SELECT conv_id, call_id, count(*) AS n FROM c GROUP BY ALL),
ids AS (SELECT DISTINCT conv_id, call_id, dep FROM c),
lv AS (
  SELECT conv_id, call_id, 0 AS level FROM ids
  WHERE NOT EXISTS (SELECT 1 FROM ids d WHERE d.conv_id = ids.conv_id AND d.call_id = ids.dep)
  UNION ALL
  SELECT ids.conv_id, ids.call_id, level + 1 FROM lv JOIN ids ON ids.conv_id = lv.conv_id AND ids.dep = lv.call_id)
SELECT c.conv_id, c.call_id, c.turn, level, coalesce(n_results_, 0) AS n_results,
  CASE WHEN n > 1 THEN 'repeated' WHEN f IS NULL THEN 'unanswered' WHEN f.t < c.turn THEN 'early' ELSE 'linked' END AS status,
  errors = '' AS valid, errors,
  '{"arguments":{' || CASE WHEN lim IS NULL THEN '' ELSE '"limit":' || lim || ',' END || '"query":' || to_json(query)
    || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"' || name || '"'
    || CASE WHEN f.x IS NULL THEN '' ELSE ',"result":' || to_json(f.x) END || '}' AS json
FROM (SELECT *, CASE name WHEN 'answer' THEN ''
        WHEN 'look_up' THEN CASE WHEN lim IS NULL THEN 'missing:limit' ELSE '' END
        ELSE CASE WHEN lim IS NULL THEN 'type:turn' ELSE 'type:turn,unknown:limit' END END AS errors FROM c) c
JOIN many USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)
LEFT JOIN (SELECT *, n_results AS n_results_ FROM r) r USING (conv_id, call_id)
UNION ALL BY NAME
SELECT conv_id, call_id, f.t AS turn, NULL AS level, n_results, 'orphan' AS status, false AS valid, '' AS errors,
  '{"id":"' || call_id || '"' || CASE WHEN f.x IS NULL THEN '' ELSE ',"result":' || to_json(f.x) END || '}' AS json
FROM r ANTI JOIN c USING (conv_id, call_id)
"""


@query
def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with their near words, and the most frequent one that each is a variant of."""
    return spelling.variant_groups(spelling.word_counts(table(spark, sf, "documents").select("doc_id", "text")))



@query
def op12_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode_documents(table(spark, sf, "documents").select("doc_id", "text"), model, decoded="decoded")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 phrases of each language that stand together most beyond chance."""
    return phrases.collocations(table(spark, sf, "documents").select("text", "lang"))


SQL["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM d),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS j FROM p),
g AS (SELECT lang, k, array_to_string(ws[j:j + k - 1], ' ') AS phrase
      FROM i, range(1, 6) AS t(k) WHERE j + k - 1 <= len(ws)),
c AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
split AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1),
kept AS (SELECT * FROM split s WHERE NOT EXISTS (
  SELECT 1 FROM split o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.a >= 100 * s.a
    AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
cut AS (SELECT kept.lang, phrase, a, ws, t.cut FROM kept, range(1, 5) AS t(cut) WHERE t.cut < k),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut, x.a AS l, y.a AS r, total.n,
         (1000::HUGEINT * cut.a * total.n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN total USING (lang)
  JOIN c x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN c y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT lang, phrase, a, n, min({'score': score, 'cut': cut, 'l': l, 'r': r}) AS b FROM scored GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a,
                  b.l AS l, b.r AS r, n, b.score AS score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
