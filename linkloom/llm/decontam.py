"""Benchmark passages in documents: spaced-seed hashes, then substitution-tolerant overlaps around hits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each mask looks at six token positions and passes over the others. Together they hit every window of thirteen
# tokens of which at most two were replaced (all 91 ways to place them were tried).
MASKS = ("10111011", "111100101")
MIN_TOKENS = 13
MIN_IDENTITY = 0.8
# Shortest test item that is searched for unless asked otherwise; shorter ones say too little.
MIN_ITEM = 5
# Tokens of test items that one pass holds in a task; larger test sets take several passes.
BLOCK_TOKENS = 2_000_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SLOTS = 1 << 20


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, marks and digits."""
    return _WORD.findall(text.lower()) if text else []


class _Codes(dict):
    """64-bit codes of tokens, kept for those met lately."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[token] = xxhash.xxh64_intdigest(token)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def _seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each position."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            h ^= codes[at:at + n]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h


@dataclass
class Index:
    """Seeds of one block of test items, sorted by hash, and a table of the hashes' low bits."""
    ids: list[int]
    codes: list[np.ndarray]
    masks: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def index(items: list[tuple[int, str]], shortest: int = MIN_ITEM) -> Index:
    """Items of ``shortest`` tokens or more; those too short for every mask are sought by all of their tokens."""
    book, ids, codes = _Codes(), [], []
    for key, text in items:
        words = tokens(text)
        if words and len(words) >= shortest:
            ids.append(key)
            codes.append(book.of(words))
    longest = max(map(len, MASKS))
    masks = [*MASKS, *("1" * n for n in sorted({len(c) for c in codes if len(c) < longest}))]
    tables = []
    for m in masks:
        whole = "0" not in m
        hashes, item, at = [], [], []
        for i, c in enumerate(codes):
            if not whole or len(c) == len(m):
                h = _seeds(c, m)
                hashes.append(h)
                item.append(np.full(len(h), i, np.int64))
                at.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        there = np.zeros(_SLOTS, bool)
        there[(h % np.uint64(_SLOTS)).astype(np.int64)] = True
        pick = lambda x: (np.concatenate(x) if x else np.empty(0, np.int64))[order]
        tables.append((h[order], pick(item), pick(at), there))
    return Index(ids, codes, masks, tables)


def _overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Start and end in the item, and equal tokens, of the stretch of the diagonal from the first to the last window
    of thirteen tokens (or of a whole shorter item) of which four fifths are equal; None without one."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    wide = min(MIN_TOKENS, len(item))
    if hi - lo < wide:
        return None
    ran = np.concatenate([[0], np.cumsum(doc[lo + shift:hi + shift] == item[lo:hi])])
    good = np.flatnonzero(ran[wide:] - ran[:-wide] >= MIN_IDENTITY * wide)
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + wide
    return lo + start, lo + end, int(ran[end] - ran[start])


def _diagonals(doc: np.ndarray, idx: Index) -> dict[int, set[int]]:
    """For each item the shifts (place in the text less that in the item) at which a seed of both agrees.

    Pairs of equal seeds are formed where they are few. Where tokens repeat, an item and a text can have more pairs than
    diagonals; then all diagonals are looked at, each once.
    """
    met, shared = [], {}
    for mask, (hashes, item, at, there) in zip(idx.masks, idx.tables):
        h = _seeds(doc, mask)
        where = np.flatnonzero(there[(h % np.uint64(_SLOTS)).astype(np.int64)])
        if not len(where):
            continue
        where = where[np.argsort(h[where], kind="stable")]
        seeds, start, size = np.unique(h[where], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(hashes, seeds), np.searchsorted(hashes, seeds, side="right")
        for k in np.flatnonzero(hi > lo):
            places = where[start[k]:start[k] + size[k]]
            met.append((places, item[lo[k]:hi[k]], at[lo[k]:hi[k]]))
            for i, n in zip(*np.unique(met[-1][1], return_counts=True)):
                shared[int(i)] = shared.get(int(i), 0) + int(n) * len(places)
    out: dict[int, set[int]] = {i: set() for i in shared}
    many = {i for i, n in shared.items() if n > len(doc) + len(idx.codes[i])}
    for places, items, ats in met:
        for i, a in zip(items.tolist(), ats.tolist()):
            if i not in many:
                out[i].update((places - a).tolist())
    for i in many:
        own = idx.codes[i]
        seeds = [(_seeds(doc, m), _seeds(own, m)) for m in idx.masks if "0" in m or len(m) == len(own)]
        for shift in range(1 - len(own), len(doc)):
            for x, y in seeds:
                lo, hi = max(0, -shift), min(len(y), len(x) - shift)
                if lo < hi and (x[lo + shift:hi + shift] == y[lo:hi]).any():
                    out[i].add(shift)
                    break
    return out


def overlaps(text: str | None, idx: Index, book: _Codes) -> list[tuple[int, int, int, int, int]]:
    """(item, first token in the text, first token in the item, tokens, equal tokens), one per item and diagonal."""
    words = tokens(text)
    if not words or not idx.ids:
        return []
    doc = book.of(words)
    found = []
    for i, shifts in sorted(_diagonals(doc, idx).items()):
        codes = idx.codes[i]
        for shift in sorted(shifts):
            if (got := _overlap(doc, codes, shift)) is not None:
                start, end, same = got
                found.append((idx.ids[i], start + shift, start, end - start, same))
    return found


_HITS = T.ArrayType(T.StructType([
    T.StructField(n, T.LongType()) for n in ("item_id", "doc_from", "item_from", "n_tokens", "n_equal")]))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of bounded size, read one partition of the test set at a time."""
    rows = items.select(F.col(key).cast("long"), text).where(f"{key} is not null and {text} is not null").distinct()
    block, size = [], 0
    for k, t in rows.toLocalIterator():
        block.append((k, t))
        size += len(t)
        if size > BLOCK_TOKENS * 4:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", name: str = "overlaps", shortest: int = MIN_ITEM) -> DataFrame:
    """``docs`` with an array ``name`` of overlaps with test items; a column of that name is replaced.

    An overlap runs, on one diagonal, from the first to the last window of thirteen tokens (or of a whole shorter
    item) of which four fifths are equal; it is found where a spaced seed of the text equals one of the item. The test
    set goes to the tasks in blocks of bounded size, each block in a pass over the rows of the one before; the
    documents themselves are never shuffled. Null and empty texts have no overlaps, items without id or text or
    below ``shortest`` tokens are left out. Items of fewer tokens than a mask are found without substitutions only.
    """
    out = docs.withColumn(name, F.array().cast(_HITS))
    for block in _blocks(items, item_key, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index(block, shortest))
        schema = T.StructType(out.schema.fields)
        at_text, at_out = out.columns.index(text), out.columns.index(name)

        def run(batches: Iterator[pa.RecordBatch], held=held, at_text=at_text, at_out=at_out) -> Iterator[pa.RecordBatch]:
            idx, book = held.value, _Codes()
            for b in batches:
                more = [[dict(zip(("item_id", "doc_from", "item_from", "n_tokens", "n_equal"), x))
                         for x in overlaps(t.as_py(), idx, book)] for t in b.column(at_text)]
                both = [was + now for was, now in zip(b.column(at_out).to_pylist(), more)]
                cols = list(b.columns)
                cols[at_out] = pa.array(both, b.schema.field(at_out).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

        out = out.mapInArrow(run, schema)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap with a test item."""
    return find_overlaps(docs, items, text, name="_overlaps").where(F.size("_overlaps") == 0).drop("_overlaps")
