"""Phrases of words that stand together more often than chance: FM-indexes over word ids, one per shard of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.store import attach, materialize

# Words of a shard: bounds the memory of a task, whatever the length of a text.
SHARD_WORDS = 2_000_000
# Bytes of a text that are cut into words at a time; a cut falls between pieces.
SLICE = 1 << 22
# Phrases of an Arrow batch that an index writes.
BATCH = 1 << 18
# Bits of the filter that tells tasks what is frequent, as a power of two: eight MB whatever the input. A filter that
# fills up lets more rows pass to the exact sums; it never hides one.
FILTER_BITS = 26
# A phrase with one word less that can be more frequent than HEAVY has its last words dealt out over SALTS groups.
HEAVY = 1_000_000
SALTS = 256

_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")
_BREAK = b"\xff"
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- texts as shards of word ids -----------------------------------------------------------

class _Words(dict):
    """Ids of words in the order they come; 0 is the border of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in UTF-8, with borders of pieces among them, some at a time."""
    text = text.lower().translate(_SEPARATORS)  # bytes: only A-Z are lowered
    at = 0
    while at < len(text):
        end = text.find(_BREAK, at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, n (words), words (joined by spaces) and ids (32-bit numbers, from 1 by the order of words, 0 between pieces)
    of shards: the texts of one language that a task has read, at most SHARD_WORDS words and a slice together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Words, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (words, parts) in held.items():
                ids = np.concatenate(parts)
                del words[_BREAK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([int(np.count_nonzero(ids))], pa.int64()),
                     pa.array([b" ".join(words)], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                    names=["lang", "n", "words", "ids"])
            held.clear()

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if not value.is_valid:
                    continue
                for found in _slices(value.as_py()):
                    words, parts = held.setdefault(name.as_py(), (_Words(), []))
                    ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                    parts += [ids, np.zeros(1, np.int32)]
                    size += len(ids)
                    if size >= SHARD_WORDS:
                        yield from flush()
                        size = 0
        yield from flush()

    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("_lang"), F.col(f"`{text}`").alias("_text"))
    return texts.mapInArrow(run, "lang string, n bigint, words binary, ids binary")


# --- a filter of fixed size ----------------------------------------------------------------

def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = (lang or "").encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64, len(words))


def _followed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and a further word."""
    return ((h ^ (h >> np.uint64(29))) * _MIX) ^ word


def _place(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * _MIX) >> np.uint64(64 - FILTER_BITS)


def frequent_filter(phrases: DataFrame) -> np.ndarray:
    """Bits of FILTER_BITS, set at the places of ``phrases(lang, phrase)``. Spark builds it; what comes to the driver has a
    fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                hashes = _word_hashes(lang, phrase.split(b" "))
                h = hashes[:1]
                for w in hashes[1:]:
                    h = _followed(h, w)
                at.append(_place(h)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.uint64).astype(np.int64))], names=["at"])

    places = phrases.select("lang", "phrase").mapInArrow(run, "at bigint")
    chunks = places.groupBy(F.shiftright("at", 15).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS - 15, 4096), np.uint8)
    for row in chunks.toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _set_at(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# --- the index -----------------------------------------------------------------------------

class Half:
    """Burrows-Wheeler order of a text of word ids by the first ``depth`` words of its suffixes.

    ``first`` has the first word of each row, ``after`` the row of the suffix one word shorter: read from there to
    here it is the step from an interval to that of a word put before it.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        # A shard holds less than 2 ** 31 words: 64 bits are only for the keys of two ranks, which go as soon as they are sorted.
        rank, known = ids.astype(np.int32), 1
        order = np.argsort(rank, kind="stable").astype(np.int32)
        while known < depth:
            step = min(known, depth - known)  # a shorter step overlaps with what is known
            key = rank.astype(np.int64)
            key *= int(rank.max(initial=0)) + 1
            key += np.roll(rank, -step)
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            rank[order[:1]] = 0
            rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
            del key
            known += step
        del rank
        row = np.empty(len(ids), np.int32)
        row[order] = np.arange(len(ids), dtype=np.int32)
        self.first = ids[order]
        self.after = row[(order + 1) % max(1, len(ids))]


class PhraseIndex:
    """A bidirectional FM-index of ``ids``, in which 0 stands between pieces and at the end.

    A phrase is an interval of rows in the index of the text and one of equal size in that of the text backwards. All
    phrases of a length are extended at once, to the left in the first and to the right in the second; the interval in
    the other one follows from the number of smaller words in the same place.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.depth = depth
        self.forward, self.backward = Half(ids, depth), Half(np.roll(ids[::-1], -1), depth)
        self.counts = np.bincount(ids, minlength=1).astype(np.int32)

    @staticmethod
    def _extended(half: Half, lo: np.ndarray, other: np.ndarray, size: np.ndarray):
        """parent, word, lo, other and size of all intervals one word longer."""
        owner = np.full(len(half.first), -1, np.int32)
        ends = np.cumsum(size, dtype=np.int32)
        rows = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        rows -= np.repeat(ends - size - lo, size)
        owner[rows] = np.repeat(np.arange(len(size), dtype=np.int32), size)
        of = owner[half.after]
        del owner
        rows = np.flatnonzero((of >= 0) & (half.first > 0)).astype(np.int32)
        of, word = of[rows], half.first[rows]
        start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])])[:len(rows)]).astype(np.int32)
        parent, count = of[start], np.diff(np.append(start, np.int32(len(rows))))
        # Words come in rising order; within a parent, borders of pieces stand before them all.
        order = np.argsort(parent, kind="stable")
        inside = np.bincount(parent, count, len(size)).astype(np.int32)
        before = np.cumsum(count[order], dtype=np.int32) - count[order] - (np.cumsum(inside, dtype=np.int32) - inside)[parent[order]]
        beside = np.empty(len(start), np.int32)
        beside[order] = other[parent[order]] + (size - inside)[parent[order]] + before
        return parent, word[start], rows[start], beside, count

    def phrases(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each length from 1 to ``depth``: the words of all phrases, a column per place, and their counts. Lengths are
        reached by extensions to the left and to the right in turn."""
        words = np.flatnonzero(self.counts[1:]).astype(np.int32) + np.int32(1)
        size = self.counts[words]
        lo = (np.cumsum(self.counts, dtype=np.int32) - self.counts)[words]
        columns, back = [words], lo
        yield columns, size
        for length in range(2, self.depth + 1):
            if length % 2 == 0:
                parent, word, lo, back, size = self._extended(self.forward, lo, back, size)
                columns = [word, *(c[parent] for c in columns)]
            else:
                parent, word, back, lo, size = self._extended(self.backward, back, lo, size)
                columns = [*(c[parent] for c in columns), word]
            yield columns, size


# --- one pass over all shards --------------------------------------------------------------

def _joined_runs(ids: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """The runs of ``ids`` in which each word is ``joined`` with the next, those of ``least`` words or more, 0 after each."""
    ends = ~joined
    run = np.cumsum(ends, dtype=np.int32) - ends
    keep = (ids > 0) & (np.bincount(run[ids > 0], minlength=1 + int(run.max(initial=0)))[run] >= least)
    del run
    out = np.where(keep, ids, 0)
    last = keep & ends
    places = np.arange(len(ids), dtype=np.int32)
    places[1:] += np.cumsum(last[:-1], dtype=np.int32)
    got = np.zeros(len(ids) + int(last.sum()), ids.dtype)
    kept = np.zeros(len(got), bool)
    got[places], kept[places] = out, keep
    kept[places[last] + 1] = True
    return got[kept]


def _packed(lang: str, names: pa.Array, columns: list[np.ndarray], n: np.ndarray, heavy: np.ndarray,
            salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, head, salt, tails, n of phrases: those that share all words but the last in one row, last words and counts
    joined by spaces. ``salts`` has a group for each word, which counts where all words of the head are ``heavy``."""
    tail, head = columns[-1], columns[:-1]
    hot = np.ones(len(n), bool)
    for c in head:
        hot &= heavy[c]
    salt = np.where(hot, salts[tail], 0)
    order = np.lexsort((salt, *reversed(head)))
    salt, tail, n, head = salt[order], tail[order], n[order], [c[order] for c in head]
    change = salt[1:] != salt[:-1]
    for c in head:
        change |= c[1:] != c[:-1]
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    lo = 0
    while lo < len(start):
        # As many whole rows as make a batch.
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + BATCH)))
        a, b = start[lo], start[hi] if hi < len(start) else len(n)
        at = pa.array(np.append(start[lo:hi], b) - a, pa.int32())
        words = pc.binary_join(pa.ListArray.from_arrays(at, names.take(pa.array(tail[a:b]))), " ")
        counts = pc.binary_join(pa.ListArray.from_arrays(at, pa.array(n[a:b].astype(np.int64)).cast(pa.string())), " ")
        first = [names.take(pa.array(c[start[lo:hi]])) for c in head]
        joined = pc.binary_join_element_wise(*first, " ") if len(first) > 1 else first[0] if first else pa.array([""] * (hi - lo), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (hi - lo), pa.string()), joined, pa.array(salt[start[lo:hi]].astype(np.int32)),
                                          words, counts], names=["lang", "head", "salt", "tails", "n"])
        lo = hi


def _counts_of(shard_rows: DataFrame, shortest: int, longest: int, frequent: list[np.ndarray], heavy: np.ndarray) -> DataFrame:
    """lang, phrase and a: the counts of all phrases of ``shortest`` to ``longest`` words of which all words, and all pairs
    of neighbours, pass the filters ``frequent`` of words and of pairs, as far as given.

    A shard sends a row for all phrases that differ in the last word only, so little more travels than these last words.
    """
    context = shard_rows.sparkSession.sparkContext
    filters = context.broadcast([f.tobytes() for f in [heavy, *frequent]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, *bits = [np.frombuffer(f, np.uint8) for f in filters.value]
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().split()
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                hashes = np.concatenate([np.zeros(1, np.uint64), _word_hashes(lang, words)])
                salts = (hashes >> np.uint64(40)).astype(np.int64) % SALTS
                if longest > 1:
                    good = _set_at(bits[0], hashes)
                    good[0] = False
                    ids = np.where(good[ids], ids, 0)
                    joined = (ids > 0) & (np.append(ids[1:], 0) > 0)
                    if len(bits) > 1:
                        for lo in range(0, len(ids), BATCH):
                            at = lo + np.flatnonzero(joined[lo:lo + BATCH])
                            joined[at] = _set_at(bits[1], _followed(hashes[ids[at]], hashes[ids[at + 1]]))
                    ids = _joined_runs(ids, joined, shortest)
                if not len(ids):
                    continue
                names = pa.array([b"", *words], pa.binary()).cast(pa.string())
                if longest == 1:
                    n = np.bincount(ids, minlength=1)
                    found = [([np.flatnonzero(n[1:]) + 1], n[1:][n[1:] > 0])]
                else:
                    found = PhraseIndex(ids, longest).phrases()
                is_hot = _set_at(hot, hashes) if longest > 1 else np.ones(1, bool)
                for columns, n in found:
                    if len(columns) >= shortest and len(n):
                        yield from _packed(lang, names, columns, n, is_hot, salts)

    rows = shard_rows.select("lang", "words", "ids").mapInArrow(run, "lang string, head string, salt int, tails string, n string")
    each = F.explode(F.arrays_zip(F.split("tails", " ").alias("word"), F.split("n", " ").alias("n"))).alias("x")
    group = ["lang", "head", "salt"]
    sums = rows.repartition(*group).select(*group, each).groupBy(*group, F.col("x.word").alias("word")).agg(
        F.sum(F.col("x.n").cast("long")).alias("a"))
    phrase = F.when(F.col("head") == "", F.col("word")).otherwise(F.concat_ws(" ", "head", "word"))
    return sums.select("lang", phrase.alias("phrase"), "a")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100,
                  longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, a: all phrases of one to ``longest`` words that occur ``least`` times or more in a language,
    with their counts. And lang, n: the words of each language.

    Each shard counts its phrases in its own index, Spark adds the shards up. A phrase can be frequent only if its words
    and its pairs of neighbours are: three passes (words, pairs, longer) tell the next by a filter of fixed size what
    to leave out, so rare phrases are not sent. The sums are exact.
    """
    parts = materialize(shards(docs, text, lang), "phrases")
    total = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    found, frequent, heavy = [], [], np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for low, high in ((1, 1), (2, 2), (3, longest)):
        if low > high or low > longest:
            break
        sums = _counts_of(parts, low, high, frequent, heavy).where(F.col("a") >= least)
        size = F.size(F.split("phrase", " ")).alias("words")
        found.append(materialize(sums.select("lang", "phrase", size, "a"), "phrases"))
        if high < longest:
            frequent.append(frequent_filter(found[-1]))
        if high == 1:
            heavy = frequent_filter(found[0].where(F.col("a") > HEAVY))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5,
                 top: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` phrases of each language by score, count and text.

    Texts are lowered (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, pieces at spaces and tabs into words.
    A phrase has two to ``longest`` words inside a piece and occurs a >= ``least`` times. Cut in two parts that occur l
    and r times among n words, it scores floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, of equal ones that
    with the shortest first part. A phrase inside a longer one that occurs as often is left out. A null text has no words,
    a null language is ``und``; repeated rows count again; an empty table gives no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and occur once at least")
    every, total = phrase_counts(docs, text, lang, least, longest)
    every = materialize(every, "phrases")
    words = F.split("phrase", " ")

    def part(first: int, size) -> F.Column:
        return F.array_join(F.slice(words, first, size), " ")

    longer = every.where("words > 2")
    around = longer.select("lang", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = (every.where("words > 1").join(around, ["lang", "phrase"], "left")
            .where(F.col("_around").isNull() | (F.col("_around") < F.col("a"))).drop("_around"))
    cut = kept.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("_first"),
                     F.array_join(F.slice(words, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("_rest"))
    counts = every.select("lang", F.col("phrase"), "a")
    cut = attach(cut, counts.select("lang", F.col("phrase").alias("_first"), F.col("a").alias("l")), ["lang", "_first"], "inner")
    cut = attach(cut, counts.select("lang", F.col("phrase").alias("_rest"), F.col("a").alias("r")), ["lang", "_rest"], "inner")
    cut = attach(cut, total, ["lang"], "inner")
    score = F.expr("""(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)))
                      div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))""")
    best = (cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
