"""Mixing sources to target weights by proportionate fair scheduling of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.store import Rounds, attach, materialize, write_table

BLOCK_ROWS = 8
# Steps times sources that are scheduled in one row, about; what comes after goes on from where the last row ended.
MOST_WORK = 1 << 22
# Weights count as whole shares of the greatest weight in so many parts: what doubles hold.
SHARE_BITS = 52
# Slots that are scheduled between two appends to the list of all.
_STRETCH = 1024


def temperature_weights(rows: DataFrame, source: str = "source") -> DataFrame:
    """source, weight: the square root of a source's rows, so large sources lose and small ones gain."""
    return rows.groupBy(source).agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))


def shares(weights: DataFrame, source: str = "source") -> DataFrame:
    """``_s`` (the source in a struct, which is never null, so null sources join) and _share of all sources with a weight.

    Null, NaN, infinite and non-positive weights are left out; weights of rows that repeat a source add up. A share is
    the weight over the greatest in 2 ** SHARE_BITS parts, at least one part.
    """
    w = F.col("weight").cast("double")
    known = weights.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")))
    summed = known.groupBy(F.struct(F.col(f"`{source}`").alias("s")).alias("_s")).agg(F.sum(w).alias("_w"))
    most = summed.agg(F.max("_w").alias("_most"))
    return summed.join(F.broadcast(most)).select(  # one row
        "_s", F.greatest(F.lit(1), F.floor(F.col("_w") / F.col("_most") * float(1 << SHARE_BITS))).cast("long").alias("_share"))


def schedule(plan: DataFrame, block_rows: int) -> DataFrame:
    """_i, block, slot, _first (rows before it) and on_target of all blocks of ``plan(_i, n, _share)``: sources, numbered
    from 0 without gaps, their rows and shares.

    With w the share of a source in all shares, its block k is released at floor(k / w) and due at ceil((k + 1) / w). In
    each slot the released block with the earliest deadline runs, of equal deadlines that of the first source. When a
    source is to run and has no rows left, the rest starts anew with its own shares, and is no longer on target. All is
    whole numbers: a source's lag is what its share asks for by the end of the slot less what it got, in parts of a block;
    it is positive when its next block is released.

    The sources stand in one row, and an expression goes over its slots. It holds a lag per source and the blocks so far.
    After MOST_WORK steps times sources the row is written, and a next one goes on with its lags: rows stay bounded,
    however many blocks there are.
    """
    one = plan.agg(F.array_sort(F.collect_list(F.struct("_i", "n", "_share"))).alias("p"))
    one = one.where("size(p) > 0").selectExpr(
        "transform(p, x -> x.n) as n", "transform(p, x -> x._share) as s",
        f"aggregate(p, 0L, (a, x) -> a + bigint(ceil(x.n / {block_rows}))) + size(p) as steps")
    # A step: the source to run is chosen and lags grow, its block is counted; or the sources left start anew.
    chosen = ("array_min(transform(acc.lag, (x, i) -> if(acc.share[i] > 0 and x + acc.share[i] > 0, "
              "struct((acc.whole - x - 1) div acc.share[i] as due, i as i), null))).i")
    out_of = lambda i: f"acc.ran[{i}] * {block_rows} >= n[{i}]"
    left = f"transform(acc.share, (x, i) -> if({out_of('i')}, 0L, x))"
    anew = (f"struct(transform(acc.lag, x -> 0L) as lag, {left} as share, acc.ran as ran, aggregate({left}, 0L, (a, x) -> a + x) as whole, "
            "acc.first as first, false as ok, acc.picks as picks)")
    run = ("struct(transform(acc.lag, (x, i) -> x + acc.share[i] - if(i = j, acc.whole, 0L)) as lag, acc.share as share, "
           "transform(acc.ran, (x, i) -> if(i = j, x + 1L, x)) as ran, acc.whole as whole, "
           f"acc.first + least({block_rows}L, n[j] - acc.ran[j] * {block_rows}) as first, acc.ok as ok, "
           "concat(acc.picks, array(struct(j as _i, acc.ran[j] as block, acc.first as _first, acc.ok as on_target))) as picks)")
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    step = bind(chosen, "j", f"if({out_of('j')}, {anew}, {run})")
    step = f"if(acc.whole = 0, acc, {step})"
    empty = "cast(array() as array<struct<_i: int, block: bigint, _first: bigint, on_target: boolean>>)"
    stretch = (f"aggregate(sequence(1L, least({_STRETCH}L, steps - b * {_STRETCH})), "
               "struct(o.lag as lag, o.share as share, o.ran as ran, o.whole as whole, o.first as first, o.ok as ok, "
               f"{empty} as picks), (acc, t) -> {step})")
    joined = bind(stretch, "e", "struct(e.lag as lag, e.share as share, e.ran as ran, e.whole as whole, e.first as first, e.ok as ok, "
                                "concat(o.all, array(e.picks)) as all)")
    listed = "array<array<struct<_i: int, block: bigint, _first: bigint, on_target: boolean>>>"
    start = ("struct(transform(s, x -> 0L) as lag, s as share, transform(s, x -> 0L) as ran, aggregate(s, 0L, (a, x) -> a + x) as whole, "
             f"0L as first, true as ok, cast(array() as {listed}) as all)")
    anew = ("struct(o.lag as lag, o.share as share, o.ran as ran, o.whole as whole, o.first as first, o.ok as ok, "
            f"cast(array() as {listed}) as all)")
    state = one.select("n", "s", "steps", F.expr(start).alias("o"), F.lit(0).cast("long").alias("before"))
    held = one.selectExpr("(steps - 1) div {0} + 1 as stretches".format(_STRETCH), "size(s) as sources").first()
    stretches, sources = held or (1, 1)
    span, rounds = max(1, MOST_WORK // (sources * _STRETCH)), Rounds("schedule")
    for lo in range(0, stretches, span):
        hi = min(lo + span, stretches) - 1
        state, _ = rounds.add(state.select(
            "n", "s", "steps", F.expr(f"aggregate(sequence({lo}L, {hi}L), {anew}, (o, b) -> {joined})").alias("o"),
            F.expr("before + aggregate(o.all, 0L, (a, x) -> a + size(x))").alias("before")))
    return rounds.all().select("before", F.posexplode(F.flatten("o.all")).alias("at", "x")).select(
        F.col("x._i").cast("long").alias("_i"), "x.block", (F.col("before") + F.col("at")).alias("slot"), "x._first", "x.on_target")


def key_digest(key: tuple[str, ...] = ("doc_id", "text")) -> Column:
    """The MD5 by which ``mix`` shuffles the rows of a source."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]))


def mix(rows: DataFrame, weights: DataFrame, source: str = "source", key: tuple[str, ...] = ("doc_id", "text"),
        block_rows: int = BLOCK_ROWS, most_work: int | None = None, digest: str | None = None) -> DataFrame:
    """All columns of ``rows``, and block, slot, position (all from 0) and on_target, which replace columns of these names.

    A source's rows are shuffled by the MD5 of ``key`` and cut into blocks of ``block_rows`` (larger ones only where a
    caller bounds rows times sources over a block's rows by ``most_work``); blocks run in the slots of ``schedule``. Up to any slot that is on target a source
    has run less than one block more or less than weight / sum(weights) of all (weights as ``shares`` takes them). What
    comes after a source ran out stays whole and in order; no slot is empty, and ``position`` counts rows without gaps.
    Rows of sources without a weight (``shares``) have null in the new columns. No rows give no rows.

    Ranks are counted per (source, first digits of the MD5), so a source that holds most rows is many groups. ``digest``
    names a column that has the MD5 (``key_digest``) already, so rows need not bring their texts.
    """
    taken = ("block", "slot", "position", "on_target")
    base = rows.drop(*taken)
    base = base.withColumn("_md5", F.col(f"`{digest}`") if digest else key_digest(key)).withColumn("_part", F.substring("_md5", 1, 3))
    base = base.withColumn("_s", F.struct(F.col(f"`{source}`").alias("s")))
    parts = materialize(base.groupBy("_s", "_part").agg(F.count(F.lit(1)).alias("_n")), "mixing")
    ahead = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_s").agg(F.sum("_n").alias("n")).join(shares(weights, source), "_s")
    order = Window.orderBy(F.col("_s.s").isNotNull(), "_s.s")  # a row per source
    plan, sources = write_table(totals.withColumn("_i", (F.row_number().over(order) - 1).cast("long")), "mixing")
    size = block_rows
    if most_work is not None:
        held = plan.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        size = max(block_rows, -(-held * sources // most_work))
    blocks, count = write_table(schedule(plan, size), "mixing")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_md5")) - 1
    ranked = (base.withColumn("_local", local).join(parts, ["_s", "_part"])
              .withColumn("_rank", F.col("_local") + F.col("_before"))
              .withColumn("block", F.expr(f"_rank div {size}")))
    ranked = attach(ranked, plan.select("_s", "_i"), ["_s"], "left", sources)
    out = attach(ranked, blocks, ["_i", "block"], "left", count)
    made = (out.withColumn("position", F.col("_first") + F.expr(f"_rank % {size}"))
            .withColumn("block", F.when(F.col("slot").isNotNull(), F.col("block"))))
    return made.select(*[F.col(f"`{c}`") for c in base.drop("_md5", "_part", "_s").columns], *taken)
