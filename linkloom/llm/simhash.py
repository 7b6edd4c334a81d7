"""Near copies by SimHash: deletion-variant signatures over two halves of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import star_components
from linkloom.store import materialize

SHINGLE = 3
MAX_BITS = 3
# Most fingerprints of a bucket that one comparison takes from one block.
BLOCK = 2048

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)
# Shingles hashed at a time: bounds the memory for one very long text.
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text in UTF-8; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
        words = 1
    n = len(w) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        shifted = [w[lo + k:hi + k] for k in range(words)]
        h = np.fromiter((digest(b" ".join(t), 42) for t in zip(*shifted)), np.uint64, hi - lo)
        lanes = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
        ones += (lanes @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp`` (long)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    out = T.StructType([*kept, T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index("_text")).cast(pa.binary())
            fp = pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())
            cols = [b.column(b.schema.names.index(f.name)) for f in kept] + [fp]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return docs.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(run, out)


def _tree(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the components of one bucket: every fingerprint is met once, from one it links with."""
    a, b = [], []
    left = fps
    if len(left) > 64:  # most of a large bucket links with nothing: it is not walked one by one
        near = [(np.bitwise_count(left[i:i + 64, None] ^ left[None, :]) <= bits).sum(1) for i in range(0, len(left), 64)]
        left = left[np.concatenate(near) > 1]
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(now[:, None] ^ left[None, :]) <= bits
            hit = near.any(0)
            if hit.any():
                found = left[hit]
                a.append(now[near[:, hit].argmax(0)])
                b.append(found)
                left = left[~hit]
                front = np.concatenate([front, found])
    return a, b


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, and starts and ends of the runs of equal keys in them. Rows come sorted by key, the first column; the
    last run of a batch may go on in the next."""
    held: list[np.ndarray] | None = None

    def cut(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.diff(cols[0])) + 1
        return cols, np.concatenate([[0], at]), np.concatenate([at, [len(cols[0])]])

    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            at = int(np.searchsorted(held[0], held[0][-1]))
            yield cut([c[:at] for c in held])
            held = [c[at:] for c in held]
    if held is not None and len(held[0]):
        yield cut(held)


def _runs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, f), starts, ends in _whole_runs(batches):
            f = f.view(np.uint64)
            size = ends - starts
            two = starts[size == 2]
            x, y = f[two], f[two + 1]
            ok = np.bitwise_count(x ^ y) <= bits
            a, b = [x[ok]], [y[ok]]
            for s, e in zip(starts[size > 2], ends[size > 2]):
                more = _tree(f[s:e], bits)
                a += more[0]
                b += more[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])
    return run


def _buckets(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """key and the columns of ``rows(fp, ...)``, sorted by key in each partition: what has to be compared, see
    ``near_links``."""
    if not 0 <= bits <= 31:
        raise ValueError("segments of four bits cover up to 31 differing bits")
    count = max(2, bits // 2 + 1)
    bounds = [64 * i // count for i in range(count + 1)]
    variants, slot = [], 0
    for lo, hi in zip(bounds, bounds[1:]):
        mask = (1 << (hi - lo)) - 1
        h = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask).cast("long"))
        variants.append(F.struct(F.lit(slot).cast("int").alias("slot"), h.alias("part"), F.lit(-1).alias("bit")))
        for i in range(hi - lo):
            one = F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1))
            variants.append(F.struct(F.lit(slot + i + 1).cast("int").alias("slot"),
                                     h.bitwiseAND(F.lit(mask ^ (1 << i)).cast("long")).alias("part"), one.cast("int").alias("bit")))
        slot += hi - lo + 1
    own_columns = rows.columns
    keyed = (rows.select(*own_columns, F.explode(F.array(*variants)).alias("v"))
             .select((F.col("v.part") * 128 + F.col("v.slot")).alias("key"), F.col("v.bit").alias("bit"), *own_columns))
    stats = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_key"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
    full = stats.where("n_key > 1 and (lo = -1 or lo <> hi)").select("key", "n_key")
    blocks = F.ceil(F.col("n_key") / block).cast("int")
    own = F.pmod(F.xxhash64(*own_columns), F.col("blocks")).cast("int")
    # The planner takes an exploded table for as small as what it came from; it must not be broadcast.
    dealt = (keyed.join(full.hint("merge"), "key").select("key", *own_columns, blocks.alias("blocks"))
             .withColumn("own", own)
             .select("key", *own_columns, "blocks", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
             .select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(
                 F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), *own_columns))
    return dealt.repartition("key").sortWithinPartitions("key")


def near_links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links that join all fingerprints of ``fps(fp)``, each once, within ``bits`` differing bits.

    A fingerprint is cut into s segments, as few as cover ``bits`` <= 2s - 1 (two at least): one segment then differs
    in at most one bit. A segment is indexed as it is and, for each of its bits, with that bit left out, so equality
    joins find every link: fingerprints with equal segments meet under the former key, those with one differing bit
    under the key without that bit. Buckets of one, and wildcard buckets of one bit value only, are dropped before
    anything is compared. A bucket beyond ``block`` is dealt out as pairs of blocks. Each comparison returns a
    spanning tree of what it links and not all pairs. The more bits, the shorter the segments and the larger the
    buckets: with 17 bits unrelated fingerprints are compared about once each, so comparisons grow with the square, and
    so do the rows moved once buckets outgrow ``block``.
    """
    return _buckets(fps.select("fp"), bits, block).mapInArrow(_runs(bits), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = MAX_BITS,
                extra: list[str] | None = None) -> DataFrame:
    """``key``, fp, component_id (smallest key reachable over links of ``bits`` bits), and columns ``extra``.

    One row per row of ``docs``. Null and empty texts have fingerprint zero and link like any other; null keys are
    passed over when the smallest is taken, so a group without keys has none. Equal fingerprints are folded before
    the search: copies never meet as pairs.
    """
    prints = materialize(fingerprints(docs.select(key, text, *(extra or [])), text), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min(key).alias("_low")), "simhash")
    found = star_components(near_links(classes.select("fp"), bits), "simhash")
    rooted = (classes.join(found, classes["fp"] == found["node"], "left")
              .select("fp", "_low", F.coalesce("root", "fp").alias("root")))
    rooted = materialize(rooted, "simhash")
    least = rooted.groupBy("root").agg(F.min("_low").alias("component_id"))
    owner = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select(key, "fp", "component_id", *(extra or []))
