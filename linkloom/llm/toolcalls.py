"""Chat formatting: tool calls linked with their results, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.store import Rounds, attach, write_table

# JSON schema types and the variant types that satisfy them, as a pattern.
TYPES = {"string": "STRING", "integer": "BIGINT|TINYINT|SMALLINT|INT", "boolean": "BOOLEAN", "null": "VOID",
         "number": "BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: the longest chain of calls that a call waits for.

    ``calls(conv_id, call_id, after)``: ``after`` lists the calls of the same conversation that come first; ids that
    name no call are passed over. A call on a cycle, or behind one, has no row. A call that waits for one other
    points at it, and pointers double until they reach a call that waits for none or for several: long chains take
    a logarithm of rounds. What is left, calls that wait for several, is ordered by Kahn's rounds: as many as the
    longest chain of such calls. Each round is a written table.
    """
    keys = ["conv_id", "call_id"]
    nodes, _ = write_table(calls.select(*keys).distinct(), "calls")
    arcs = (calls.select(*keys, F.explode("after").alias("dep")).distinct()
            .join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"))
    arcs, _ = write_table(arcs, "calls")
    waits = arcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("ptr"))
    waits, _ = write_table(waits, "calls")
    free = nodes.join(waits, keys, "left_anti").withColumn("level", F.lit(0))
    one = waits.where("n = 1").select(*keys, "ptr", F.lit(1).alias("dist"), F.lit(True).alias("moved"))
    rounds = Rounds("calls")
    one, open_ = rounds.add(one, "moved")
    span = 1
    most = open_
    while open_ and span <= 2 * most:
        ahead = one.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"))
        one, open_ = rounds.add(one.join(ahead, ["conv_id", "ptr"], "left").select(
            *keys, F.coalesce("_ptr", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            F.col("_ptr").isNotNull().alias("moved")), "moved")
        span *= 2
    # Pointers that still move run in a cycle.
    chained = one.where("not moved").select(*keys, F.col("ptr").alias("anchor"), "dist")
    several = waits.where("n > 1").select(*keys)
    through = chained.select("conv_id", F.col("call_id").alias("dep"), F.col("anchor").alias("_anchor"), "dist")
    left = (arcs.join(several, keys, "left_semi").join(through, ["conv_id", "dep"], "left")
            .groupBy(*keys, F.coalesce("_anchor", "dep").alias("anchor")).agg(F.max(F.coalesce("dist", F.lit(0))).alias("dist"))
            .withColumn("level", F.lit(None).cast("int")))
    left, n = write_table(left, "calls")
    anchors, ready = free, free
    while n:
        known = ready.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("_level"))
        left, _ = write_table(left.join(known, ["conv_id", "anchor"], "left").select(
            *keys, "anchor", "dist", F.coalesce("level", F.expr("_level + dist + 1")).alias("level")), "calls")
        freed = left.groupBy(*keys).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready, n = write_table(freed.where("open = 0").drop("open"), "calls")
        anchors = anchors.unionByName(ready)
        left = left.join(ready, keys, "left_anti")
    last = chained.join(anchors.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"])
    return anchors.unionByName(last.select(*keys, (F.col("level") + F.col("dist")).alias("level")))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with arguments as a variant in ``parsed`` (null if they are no JSON object) and array ``errors``.

    ``schemas(name, param, type, required)``; one row with a null ``param`` declares a tool without parameters. The
    table describes tools, so its size does not follow the calls: it becomes a row per tool.
    Errors, sorted: unknown_tool, not_an_object, missing:<param>, type:<param>, unknown:<param>.
    """
    fits = F.lit("")
    for t, p in TYPES.items():
        fits = F.when(F.col("type") == t, F.lit(f"^({p})$")).otherwise(fits)
    tools = schemas.groupBy("name").agg(F.collect_list(F.when(F.col("param").isNotNull(), F.struct(
        "param", fits.alias("fits"), F.coalesce("required", F.lit(False)).alias("required")))).alias("params"))
    parsed = F.try_parse_json("arguments")
    out = calls.withColumn("_v", parsed).withColumn(
        "parsed", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v"))).drop("_v")
    out = out.join(tools, "name", "left").withColumn("_given", F.expr(
        "transform(coalesce(json_object_keys(if(parsed is null, null, arguments)), array()), k -> k)"))
    # Each argument as text and its type; a variant map keeps nested values as they are.
    typed = F.expr("""transform_values(coalesce(try_cast(parsed as map<string, variant>), map()),
                      (k, v) -> schema_of_variant(v))""")
    out = out.withColumn("_types", F.when(F.col("parsed").isNotNull(), typed))
    errors = F.expr("""array_sort(concat(
        if(params is null, array('unknown_tool'), array()),
        if(parsed is null, array('not_an_object'), array()),
        if(params is null or parsed is null, array(), concat(
            transform(filter(params, p -> p.required and not array_contains(_given, p.param)), p -> concat('missing:', p.param)),
            transform(filter(params, p -> array_contains(_given, p.param) and p.fits <> ''
                      and not coalesce(_types[p.param], 'VOID') rlike p.fits), p -> concat('type:', p.param)),
            transform(filter(_given, k -> not exists(params, p -> p.param = k)), k -> concat('unknown:', k))))))""")
    return out.withColumn("errors", errors).drop("params", "_given", "_types")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, every_result: bool = False) -> DataFrame:
    """conv_id, call_id, turn, level, status, valid, errors, n_results, json: one row per call, one per id that only
    results have and one per result without an id; with ``every_result`` also one per further result of any id.

    ``calls(conv_id, call_id, turn, name, arguments, after)``, ``results(conv_id, call_id, turn, content)``. Calls meet
    the first of their results by turn (of equal turns the first by content) in a hash join on conversation and
    id; only that one is linked, so a repeated id never multiplies. status of a call: linked, early (the result's turn
    is before the call's), unanswered, repeated (an id with several calls, each of which is a row). Status of a
    result: repeated (a further result of an id that has a call), orphan (its id is null or names no call).
    n_results counts the results with the id, 1 for a null id. level orders the calls of a conversation
    topologically, null on and behind cycles and for results. json has sorted keys and no spaces; parts that are null
    are left out, and arguments that are no object are given as text. Null ids match nothing. Extra columns are dropped.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after")
    keys = ["conv_id", "call_id"]
    results = results.select(*keys, "turn", "content")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    named = results.where(has_id)
    first = (named.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results")))
    many = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = levels(calls.where("conv_id is not null and call_id is not null"))
    checked = validate(calls, schemas)
    # One narrow table of all that is known of an id joins the calls once.
    known = many.join(order, keys, "left").join(first, keys, "left")
    linked = checked.join(known, keys, "left")
    status = (F.when(F.col("_n") > 1, "repeated").when(F.col("_r").isNull(), "unanswered")
              .when(F.col("_r.turn") < F.col("turn"), "early").otherwise("linked"))
    json = F.to_json(F.struct(
        F.col("parsed").alias("arguments"), F.when(F.col("parsed").isNull(), F.col("arguments")).alias("arguments_text"),
        F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("_r.content").alias("result")))
    rows = linked.select(*keys, "turn", "level", status.alias("status"), (F.size("errors") == 0).alias("valid"), "errors",
                         F.coalesce("n_results", F.lit(0)).alias("n_results"), json.alias("json"))
    lost = first.join(many, keys, "left_anti")

    def alone(found: DataFrame, status: Column) -> DataFrame:
        """Rows of results that stand for themselves."""
        return found.select(*keys, "turn", F.lit(None).cast("int").alias("level"), status.alias("status"),
                            F.lit(False).alias("valid"), F.array().cast("array<string>").alias("errors"), "n_results",
                            F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))

    orphan = F.lit("orphan")
    rows = (rows.unionByName(alone(lost.select(*keys, "_r.turn", "_r.content", "n_results"), orphan))
            .unionByName(alone(results.where(~has_id).withColumn("n_results", F.lit(1).cast("long")), orphan)))
    if not every_result:
        return rows
    # Further results are read again only where an id has any. Equal ones are folded and dealt out again.
    several, ids = write_table(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_results")).where("n_results > 1"), "calls")
    if not ids:
        return rows
    folded = attach(named, several, keys, "inner", ids).groupBy(*keys, "turn", "content", "n_results").agg(F.count(F.lit(1)).alias("_copies"))
    shown = folded.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("_r"))
    further = (folded.join(shown, keys)
               .withColumn("_copies", F.col("_copies") - F.struct("turn", "content").eqNullSafe(F.col("_r")).cast("int"))
               .where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _copies)")))
               .join(many, keys, "left"))
    return rows.unionByName(alone(further, F.when(F.col("_n").isNull(), orphan).otherwise("repeated")))
