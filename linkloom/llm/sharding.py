"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ring has this many cells. A key falls into one, a virtual node starts at one: so much, and no more, of a
# histogram reaches the driver, whatever the number of rows.
CELLS = 1 << 16
VIRTUAL_NODES = 64

# Slots by an order column are counted per shard and range of so many values.
RANGE = 1 << 16

Piece = tuple[int, int, int, int, int]


def ring(shards: int, virtual: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Start cells of the virtual nodes in ring order, and their shards."""
    if shards < 1:
        raise ValueError("shards must be positive")
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{r}") >> 48, s, r) for s in range(shards) for r in range(virtual))
    return [n[0] for n in nodes], [n[1] for n in nodes]


def place(counts: dict[int, int], shards: int, virtual: int = VIRTUAL_NODES) -> list[Piece]:
    """(cell, from, to, shard, first slot): which ranks of each cell go where.

    A shard takes as many rows as its share of the whole: the total over ``shards``, one more for the first
    ``total mod shards``. It first takes what hashes to it, in ring order. What then is left over goes on clockwise
    to the next virtual node whose shard has room. The shares add up to all rows, so every shard ends full.
    """
    starts, owners = ring(shards, virtual)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces: list[Piece] = []

    def put(cell: int, lo: int, shard: int, most: int) -> int:
        n = min(most, room[shard] - used[shard])
        if n:
            pieces.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return n

    over: list[tuple[int, int, int]] = []
    for cell in sorted(counts):
        node = bisect.bisect_left(starts, cell) % len(starts)
        n = put(cell, 0, owners[node], counts[cell])
        if n < counts[cell]:
            over.append((cell, node, n))
    ways: dict[int, list[int]] = {}
    for cell, node, lo in over:
        if node not in ways:  # the shards in the order in which a walk from here meets them
            ways[node] = list(dict.fromkeys(owners[node:] + owners[:node]))
        for shard in ways[node]:
            lo += put(cell, lo, shard, counts[cell] - lo)
            if lo == counts[cell]:
                break
    return pieces


def shard_rows(rows: DataFrame, key: list[Column], shards: int, virtual: int = VIRTUAL_NODES,
               order: str | None = None) -> DataFrame:
    """All columns of ``rows``, and shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    ``key`` places a row on the ring; rows with equal keys are neighbours there. Counts of shards differ by one at
    most. Rows that are equal in all of ``key`` are alike to this operator, so any order among them will do.
    Columns named shard or slot are replaced; no rows give no rows. With ``order``, a column of whole numbers, the
    slots of a shard follow it (nulls last, ties by ``key``), and not the ring; shards are the same. They are counted
    per range of ``order`` with carried offsets, so no shard has to fit a task.
    """
    spark = rows.sparkSession
    base = rows.drop("shard", "slot").withColumn("_h", F.xxhash64(*key))
    base = base.withColumn("_cell", F.shiftrightunsigned("_h", 48).cast("int"))
    counts = {r["_cell"]: r["n"] for r in base.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = spark.createDataFrame(place(counts, shards, virtual) or [(0, 0, 0, 0, 0)],
                                   "_cell int, lo bigint, hi bigint, shard int, slot bigint")
    plan = pieces.groupBy("_cell").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("_pieces"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", *key)) - 1
    ranked = base.withColumn("_rank", rank.cast("bigint")).join(plan, "_cell")
    mine = F.expr("filter(_pieces, p -> p.lo <= _rank and _rank < p.hi)[0]")
    ranked = ranked.withColumn("_mine", mine).withColumn("shard", F.col("_mine.shard"))
    if order is not None:
        # Only cells that are split need ranks; the rows of all others know their shard. There are CELLS of them at most.
        whole = pieces.join(pieces.groupBy("_cell").count().where("count = 1").select("_cell"), "_cell").select("_cell", "shard")
        split = ranked.join(F.broadcast(whole.select("_cell")), "_cell", "left_anti")
        known = base.join(F.broadcast(whole), "_cell").select(*base.columns, "shard").unionByName(split.select(*base.columns, "shard"))
        placed = known.withColumn("_range", F.when(F.col(order).isNotNull(), F.floor(F.col(order) / RANGE)).otherwise(
            # Rows without an order come after all ranges, dealt by their cell.
            F.lit(1 << 62) + F.col("_cell")))
        sizes = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
        ahead = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("shard", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
        local = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(order, "_h", *key)) - 1
        return (placed.withColumn("_local", local).join(sizes, ["shard", "_range"])
                .select(*base.drop("_h", "_cell").columns, "shard", (F.col("_before") + F.col("_local")).alias("slot")))
    return (ranked
            .withColumn("slot", F.col("_mine.slot") + F.col("_rank") - F.col("_mine.lo"))
            .drop("_h", "_cell", "_rank", "_pieces", "_mine"))
