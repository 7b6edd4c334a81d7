"""Near copies of embeddings by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import star_components
from linkloom.store import materialize

COSINE = 0.98
# Centroids per half; the grid has the square of it.
CENTROIDS = 16
# Most vectors that the codebooks are fitted on: those with the smallest hashes.
SAMPLE_ROWS = 20_000
# Share of pairs at exactly the threshold whose cell the traversal must reach, from either side.
RECALL = 0.99
# Most members and seekers of a cell that meet in one comparison.
BLOCK = 2048


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the centroids."""
    return (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :]


def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from ``k`` distinct rows."""
    x = np.unique(x, axis=0)
    book = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(12):
        near = _nearest(x, book).argmin(1)
        for c in range(len(book)):
            own = x[near == c]
            if len(own):
                book[c] = own.mean(0)
    return book


def cells(d1: np.ndarray, d2: np.ndarray, n: int) -> list[int]:
    """Multi-sequence traversal: the ``n`` cells of the grid nearest by the sum of distances, nearest first."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * len(d2) + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


class MultiIndex:
    """Codebooks of both halves, and the number of cells to visit for the recall asked for."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, k: int = CENTROIDS, recall: float = RECALL):
        rng = np.random.default_rng(7)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.half = max(1, x.shape[1] // 2)
        self.books = [_fit(x[:, :self.half], k, rng), _fit(x[:, self.half:], k, rng)]
        self.visits = 1
        if x.shape[1] < 2:
            return
        # For each sample vector one at exactly the threshold, in a random direction: at which visit does one of the
        # two find the other?
        x = x[:2000]
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * u
        whole = len(self.books[0]) * len(self.books[1])
        own, other = self.probes(x, whole), self.probes(y, whole)
        visit = [min(a.index(b[0]), b.index(a[0])) + 1 for a, b in zip(own, other)]
        self.visits = int(np.quantile(visit, recall, method="higher"))

    def probes(self, x: np.ndarray, n: int | None = None) -> list[list[int]]:
        """Cells to visit for each unit vector; the first is its home."""
        d1, d2 = _nearest(x[:, :self.half], self.books[0]), _nearest(x[:, self.half:], self.books[1])
        return [cells(a, b, n or self.visits) for a, b in zip(d1, d2)]


def _compare(cosine: float, kind: type):
    def links(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, root of what it links with here, weight of its partners, for nodes of one block with a partner."""
        seek = [r for r in rows if r[1]]
        member = [r for r in rows if not r[1]]
        none = np.empty(0, np.int64)
        if not seek or not member:
            return none, none, none
        unit = lambda rs: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(
            np.stack([np.frombuffer(r[4], kind) for r in rs]).astype(np.float64))
        p, m = unit(seek), unit(member)
        near = p @ m.T >= cosine
        px, mx = np.array([r[2] for r in seek]), np.array([r[2] for r in member])
        ph, mh = np.array([r[5][0] for r in seek]), np.array([r[5][0] for r in member])
        # Would the member visit the seeker's home as well? Then the pair counts in the smaller cell only, and in a
        # shared home for the smaller node.
        homes, at = np.unique(ph, return_inverse=True)
        visits = np.stack([np.isin(homes, r[5]) for r in member], 1)[at]
        once = ~visits | (mh[None, :] < ph[:, None]) | ((mh[None, :] == ph[:, None]) & (px[:, None] < mx[None, :]))
        near &= once & (px[:, None] != mx[None, :])
        i, j = near.any(1), near.any(0)
        near = near[i][:, j]
        px, mx = px[i], mx[j]
        pw, mw = np.array([r[3] for r in seek])[i], np.array([r[3] for r in member])[j]
        nodes, back = np.unique(np.concatenate([px, mx]), return_inverse=True)
        a, b = back[:len(px)], back[len(px):]
        weight = np.zeros(len(nodes), np.int64)
        np.add.at(weight, a, near @ mw)
        np.add.at(weight, b, near.T @ pw)
        root = np.arange(len(nodes))
        while True:  # the smallest node spreads over the links
            was = root.copy()
            low = np.where(near, root[b][None, :], len(nodes)).min(1, initial=len(nodes))
            np.minimum.at(root, a, low)
            low = np.where(near, root[a][:, None], len(nodes)).min(0, initial=len(nodes))
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == was).all():
                return nodes, nodes[root], weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and r[0] != held[0][0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in links(held)], names=["node", "root", "n"])
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links(held)], names=["node", "root", "n"])
    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, k: int = CENTROIDS, recall: float = RECALL) -> DataFrame:
    """``key``, n_links, component_id, kept: one row per row of ``rows``.

    Vectors are compared if their labels are equal and not null and their lengths agree. Vectors that are null, empty
    or zero, or hold null or non-finite components, link with nothing. Equal vectors are folded and link by
    themselves. Each distinct vector lies in one cell of a grid of two codebooks, one per half, and visits as many
    of the nearest cells as the target recall takes; links are verified in double precision, counted once, and
    found from either side. Cells beyond ``BLOCK`` are dealt out in pairs of blocks, so none is a task by itself.
    Codebooks are fitted on at most ``SAMPLE_ROWS`` distinct vectors per length; a length that the sample lacks has a
    single cell. component_id is null only where a group has no ``key``.
    """
    spark = rows.sparkSession
    kind = np.float64 if rows.schema[vector].dataType.elementType == T.DoubleType() else np.float32
    v = F.col(vector)
    sound = (F.col(label).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(v, lambda x: x != 0))
    base = rows.select(F.col(key).alias("_key"), F.when(sound, F.xxhash64(label, vector)).alias("node"),
                       F.col(label).alias("label"), v.alias("v"))
    nodes = materialize(base.where("node is not null").groupBy("node")
                        .agg(F.first("v").alias("v"), F.first("label").alias("label"),
                             F.count(F.lit(1)).alias("w"), F.min("_key").alias("low")), "vectors")

    sample: dict[int, list] = {}
    for r in nodes.select("node", "v").orderBy("node").limit(SAMPLE_ROWS).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    books = spark.sparkContext.broadcast({n: MultiIndex(np.array(x, np.float64), cosine, k, recall)
                                          for n, x in sample.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(x, kind) for x in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in vectors])
            probes: list = [[0]] * len(vectors)
            for n in set(sizes.tolist()) & books.value.keys():
                at = np.flatnonzero(sizes == n)
                x = np.stack([vectors[i] for i in at]).astype(np.float64)
                for i, p in zip(at, books.value[n].probes(x / np.linalg.norm(x, axis=1, keepdims=True))):
                    probes[i] = p
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(sizes, pa.int32()),
                 pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(probes, pa.list_(pa.int32()))],
                names=["node", "group", "w", "size", "v", "probes"])

    spread = nodes.select("node", "v", F.xxhash64("label").alias("group"), "w")
    indexed = materialize(spread.mapInArrow(
        assign, "node bigint, group bigint, w bigint, size int, v binary, probes array<int>"), "vectors")
    place = ["group", "size", "cell"]
    members = indexed.withColumn("cell", F.expr("probes[0]"))
    seekers = indexed.withColumn("cell", F.explode("probes"))
    full = (members.groupBy(*place).agg(F.count(F.lit(1)).alias("m"))
            .join(seekers.groupBy(*place).agg(F.count(F.lit(1)).alias("s")), place).where("s > 1")
            .select(*place, F.expr(f"int(ceil(m / {BLOCK}))").alias("mb"), F.expr(f"int(ceil(s / {BLOCK}))").alias("sb")))
    full = materialize(full, "vectors")

    def dealt(side: DataFrame, seek: bool, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("node", F.lit(seek)), F.col(own)).cast("int").alias("own")
        there = side.join(full, place).select("*", at, F.explode(F.expr(f"sequence(0, {other} - 1)")).alias("other"))
        first, second = ("other", "own") if seek else ("own", "other")
        return there.select(F.xxhash64(*place, first, second).alias("block"), F.lit(seek).alias("seek"), "node", "w", "v",
                            "probes")

    both = dealt(members, False, "mb", "sb").unionByName(dealt(seekers, True, "sb", "mb"))
    runs = both.repartition("block").sortWithinPartitions("block")
    found = materialize(runs.mapInArrow(_compare(cosine, kind), "node bigint, root bigint, n bigint"), "vectors")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = star_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    known = (nodes.select("node", "w", "low").join(counts, "node", "left").join(roots, "node", "left")
             .select("node", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "low",
                     F.coalesce("root", "node").alias("root")))
    known = materialize(known, "vectors")
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    owner = known.join(least, "root").select("node", "n_links", "component_id")
    out = base.select("_key", "node").join(owner, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"))
