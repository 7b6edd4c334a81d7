"""Weak components of a graph: those of bounded size are solved in one task each, without a round per level.

Only how a graph is cut matters: the loops of ``iterate`` solve what is too large, and both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import BUCKET_BITS
from linkloom.operators.stars import star_components
from linkloom.store import attach, materialize

# Arcs of a weak component that a task solves at most; its sets take the square of that in bits.
PIECE_ARCS = 10_000
# Arcs that make up a group of whole weak components, about: they are dealt out by a hash.
BIN_ARCS = 2_000
# Arcs of a task, about, where there are more than a few for each core.
TASK_ARCS = 50_000

# Bits travel as decimal strings: pandas has no 64-bit integers beside nulls.
SOLVED = "kind string, a bigint, b bigint, x int, y int, bits string, far string"


def small_pieces(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """vid, piece: the vertices of weak components with at most ``most`` arcs, and the smallest vertex of each."""
    roots = star_components(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), "weak") \
        .select(F.col("node").alias("src"), F.col("root").alias("_root"))
    labelled = materialize(attach(pairs, roots, ["src"], "left")
                           .select("src", "dst", F.coalesce("_root", "src").alias("piece")), "pieces")
    sized = labelled.groupBy("piece").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= (most or PIECE_ARCS))
    ends = labelled.select("piece", F.explode(F.array("src", "dst")).alias("vid")).distinct()
    return materialize(ends.join(sized.select("piece"), "piece").select("vid", "piece"), "pieces")


def solve(pairs: DataFrame, pieces: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Components, levels and sets of ancestors of the graph ``pairs(src, dst)`` within ``pieces(vid, piece)``.

    A table with a row per kind: ``c`` a member a of component b (two members or more); ``l`` the level x of component a
    that has arcs; ``d`` an arc from component a (level x) to b (level y); ``s`` the bits of ``iterate.Ancestors`` of
    component a in bucket b. ``known(vid, bucket, bits)`` adds to the sets of some components.
    """
    at = pieces.select(F.col("vid").alias("src"), "piece")
    rows = materialize(attach(pairs.select("src", "dst"), at, ["src"], "inner")
                       .select("piece", "src", "dst", F.lit(None).cast("string").alias("bits")), "pieces")
    arcs = rows.count()
    bins, tasks = max(1, arcs // BIN_ARCS), max(pairs.sparkSession.sparkContext.defaultParallelism, arcs // TASK_ARCS)
    if known is not None:
        rows = rows.unionByName(attach(known.withColumnRenamed("vid", "src"), at, ["src"], "inner")
                                .select("piece", "src", F.col("bucket").cast("bigint").alias("dst"), F.col("bits").cast("string").alias("bits")))
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(bins))).repartition(tasks, "bin")
    solved = binned.groupBy("bin").applyInPandas(_solve_bin, SOLVED)
    return materialize(solved.withColumns({c: F.col(c).cast("bigint") for c in ("bits", "far")}), "solved")


def _solve_bin(rows: pd.DataFrame) -> pd.DataFrame:
    out = [r for _, piece in rows.groupby("piece", sort=False) for r in _solve_piece(piece)]
    return pd.DataFrame(out, columns=["kind", "a", "b", "x", "y", "bits", "far"])


def _solve_piece(piece: pd.DataFrame) -> Iterator[tuple]:
    given = piece["bits"].notna()
    arcs, known = piece[~given], piece[given]
    more = [(v, _members(b, bits)) for v, b, bits in zip(known["src"], known["dst"], known["bits"])]
    ids = np.unique(np.concatenate([arcs["src"], arcs["dst"], known["src"], *[m for _, m in more]]).astype(np.int64))
    out: list[list[int]] = [[] for _ in ids]
    for s, d in zip(np.searchsorted(ids, arcs["src"]).tolist(), np.searchsorted(ids, arcs["dst"]).tolist()):
        out[s].append(d)
    groups = strong_components(out)
    of = {v: c for c, group in enumerate(groups) for v in group}
    below = [sorted({of[d] for v in group for d in out[v]} - {c}) for c, group in enumerate(groups)]
    head = [int(ids[min(group)]) for group in groups]
    level: list[int] = []
    for c, group in enumerate(groups):  # targets come first
        level.append(max((level[d] + 1 for d in below[c]), default=0))
        if len(group) > 1:
            yield from (("c", int(ids[v]), head[c], None, None, None, None) for v in group)
        if level[c]:
            yield "l", head[c], None, level[c], None, None, None
            yield from (("d", head[c], head[d], level[c], level[d], None, None) for d in below[c])
    near, far = [0] * len(groups), [0] * len(groups)
    for v, m in more:
        c = of[int(np.searchsorted(ids, v))]
        for i in np.searchsorted(ids, m).tolist():
            near[c] |= 1 << i
    for c in range(len(groups) - 1, -1, -1):
        above, own = near[c] | far[c], sum(1 << v for v in groups[c])
        for d in below[c]:
            near[d] |= own
            far[d] |= above
        if above:
            distant = dict(_bitmaps(ids, far[c]))
            yield from (("s", head[c], b, None, None, bits, distant.get(b)) for b, bits in _bitmaps(ids, above))


def strong_components(out: list[list[int]]) -> list[list[int]]:
    """Strong components of a graph of adjacency lists, each after all that it leads to (Tarjan, without recursion)."""
    order, low, held = [-1] * len(out), [0] * len(out), [False] * len(out)
    stack: list[int] = []
    found: list[list[int]] = []
    n = 0
    for start in range(len(out)):
        if order[start] >= 0:
            continue
        order[start] = low[start] = n
        n += 1
        stack.append(start)
        held[start] = True
        path = [(start, iter(out[start]))]
        while path:
            v, ahead = path[-1]
            for w in ahead:
                if order[w] < 0:
                    order[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    held[w] = True
                    path.append((w, iter(out[w])))
                    break
                if held[w]:
                    low[v] = min(low[v], order[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == order[v]:
                    group, w = [], -1
                    while w != v:
                        w = stack.pop()
                        held[w] = False
                        group.append(w)
                    found.append(group)
    return found


def _members(bucket: int, bits: str) -> np.ndarray:
    """The vertex numbers of a set."""
    held = np.frombuffer(np.int64(int(bits)).tobytes(), np.uint8)
    return (int(bucket) << BUCKET_BITS) + np.flatnonzero(np.unpackbits(held, bitorder="little"))


def _bitmaps(ids: np.ndarray, places: int) -> Iterator[tuple[int, str]]:
    """bucket, bits of the vertices ``ids`` at the set bits of ``places``."""
    raw = np.frombuffer(places.to_bytes(len(ids) // 8 + 1, "little"), np.uint8)
    vids = ids[np.flatnonzero(np.unpackbits(raw, bitorder="little"))]
    if len(vids):
        buckets, starts = np.unique(vids >> BUCKET_BITS, return_index=True)
        ones = np.left_shift(np.uint64(1), (vids & ((1 << BUCKET_BITS) - 1)).astype(np.uint64))
        words = np.bitwise_or.reduceat(ones, starts).view(np.int64)
        yield from zip(buckets.tolist(), map(str, words.tolist()))


__all__ = ["BIN_ARCS", "PIECE_ARCS", "small_pieces", "solve", "strong_components"]
