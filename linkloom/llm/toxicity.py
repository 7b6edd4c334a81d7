"""Toxicity: decode obfuscated spellings as a noisy channel, then score the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import set_aside

# Most labelled rows that the scorer is fitted on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 8_000
# Lengths of the character n-grams, inside words with a space before and after.
GRAMS = (4, 5, 6, 7, 8)
# Deviations of Wilson's lower bound of the share of toxic texts.
CAUTION = 3.0
# Least bound that makes an n-gram part of the lexicon; share from which it stays in whatever else explains its texts.
LEAST_SHARE, SURE = 0.3, 0.995

# Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
# Log probabilities of the channel: a sign for a letter, a mark put between letters, a sign that could be a letter
# put there, one more of the same letter.
SIGN, NOISE, STRAY, REPEAT = math.log(0.2), math.log(0.1), math.log(1e-6), math.log(0.2)

# The language model's alphabet: 0 is any boundary; letters up to U+024F share the symbols by a fixed rule.
_SYMBOLS = 64
_TABLE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    if chr(_c).isalpha() and chr(_c) == chr(_c).lower():
        _TABLE[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % 36
_OTHER = 63

_LONG_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?: +\S){2,}(?!\S)")
_EDGES = re.compile(r"^[^\w@$!|+(<€£¡¢]+|[.,;:!?'\"%#&*)\]}>…]+$|([^\w\s])\1+$")


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(cp < 0x250, _TABLE[np.minimum(cp, 0x24F)], _OTHER)


def _symbol(c: str) -> int:
    return int(_TABLE[ord(c)]) if ord(c) < 0x250 else _OTHER if c.isalpha() else 0


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: character trigrams of all texts in lower case, at most 64 ** 3 of them whatever the size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS ** 3, np.int64)
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                if not t.is_valid:
                    continue
                whole = t.as_py().lower()
                for lo in range(0, len(whole), 1 << 20):
                    s = symbols(f" {whole[max(0, lo - 2):lo + (1 << 20)]} ")
                    if len(s) > 2:
                        held.append((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:])
                        size += len(s)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=len(total))
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a b) as a cube. The table of counts is bounded by the alphabet."""
    n = np.zeros(_SYMBOLS ** 3)
    for r in counts.collect():
        n[r["gram"]] = r["n"]
    cube = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    pair = cube.sum(2, keepdims=True)
    back = (cube.sum(0) + 0.1) / (cube.sum(0).sum(1, keepdims=True) + 0.1 * _SYMBOLS)  # P(c | b)
    return np.log((cube + 2 * back[None]) / (pair + 2)).astype(np.float32)


class Decoder(dict):
    """Words in lower case as they were meant: letters only, with a space for what is not one. Keeps what it met."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model.tolist()

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = self._restore(word)
        return out

    def _restore(self, word: str) -> str:
        if word.isalpha():
            return self.viterbi(word) if _LONG_RUN.search(word) else word
        bare = _EDGES.sub("", word)
        if bare.isalpha() and not _LONG_RUN.search(bare):
            return bare
        plain = "".join(c if c.isalpha() else " " for c in bare)
        if not any(c.isalpha() for c in bare):
            return plain
        meant = self.viterbi(bare)
        return meant if plain == meant else f"{plain} {meant}" if " " in plain.strip() else meant

    def viterbi(self, word: str) -> str:
        """Best path through the lattice of ``word``: each character is a letter it may stand for or is left out,
        as noise between letters or as one more of the letter before."""
        m = self.model
        # State: the last two letters. Value: score, path as nested pairs.
        states: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
        before = ""
        for c in word:
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            letters = [(c, 0.0)] if c.isalpha() else [(x, SIGN) for x in LOOKALIKES.get(c, "")]
            out = (STRAY if c in LOOKALIKES else NOISE) if not c.isalpha() else REPEAT if c == before else None
            for (a, b), (score, path) in states.items():
                if out is not None and (not c.isalpha() or b == c):
                    old = new.get((a, b))
                    if old is None or old[0] < score + out:
                        new[a, b] = (score + out, path)
                row = m[_symbol(a) if a else 0][_symbol(b) if b else 0]
                for x, cost in letters:
                    s = score + cost + row[_symbol(x)]
                    old = new.get((b, x))
                    if old is None or old[0] < s:
                        new[b, x] = (s, (path, x))
            states, before = new, c
        ends = [(s + m[_symbol(a) if a else 0][_symbol(b) if b else 0][0], p) for (a, b), (s, p) in states.items()]
        path = max(ends, key=lambda e: e[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def text(self, text: str | None) -> str:
        """The restored text, words parted by single spaces."""
        if not text:
            return ""
        low = text.lower()
        words = [self[w] for w in low.split()]
        for s in _SPACED.finditer(low):
            words.append(self[s[0].replace(" ", "")])
        return f" {' '.join(words)} "


def word_grams(restored: str) -> set[str]:
    """Character n-grams of the words of a restored text."""
    found = set()
    for w in set(restored.split()):
        w = f" {w} "
        for n in GRAMS:
            found.update(w[i:i + n] for i in range(len(w) - n + 1))
    return found


def _sketch(words: list[str]) -> int:
    """The smallest hash of five words in a row: near copies mostly agree in it."""
    n = max(1, len(words) - 4)
    return min(xxhash.xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(n)) - (1 << 63)


def lexicon(labelled: DataFrame, model: np.ndarray, label: str = "toxic", text: str = "text",
            rows: int = SAMPLE_ROWS) -> list[tuple[str, float]]:
    """(n-gram, share): n-grams that texts with label 1 have and others have not.

    Fitted on at most ``rows`` rows of ``labelled(doc_id, text, label)``, those with the smallest hashes of their
    ids; near copies in the sample count once. The share is that of label 1 among the texts with the n-gram, lowered
    to Wilson's bound; n-grams whose texts others explain are left out.
    """
    spark = labelled.sparkSession
    lm = spark.sparkContext.broadcast(model)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(lm.value)
        for b in batches:
            texts = [d.text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts), pa.array([_sketch(t.split()) for t in texts])],
                names=["label", "text", "sketch"])

    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = sample.select(F.col(label).cast("int").alias("label"), text).repartition(
        spark.sparkContext.defaultParallelism)
    once = (sample.mapInArrow(restore, "label int, text string, sketch bigint")
            .groupBy("sketch").agg(F.min(F.struct("label", "text")).alias("x")).select("x.label", "x.text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, neg = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (pos if y == 1 else neg).update(word_grams(t))
            grams = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array([pos[g] for g in grams], pa.int64()),
                 pa.array([neg[g] for g in grams], pa.int64())], names=["gram", "pos", "neg"])

    found = (once.mapInArrow(count, "gram string, pos bigint, neg bigint").groupBy("gram")
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3 and pos * 4 > neg"))
    grams = [r["gram"] for r in found.collect() if wilson(r["pos"], r["pos"] + r["neg"]) >= LEAST_SHARE]
    grams.sort(key=lambda g: (len(g), g))
    return _explain(once, grams)


def wilson(pos, n, z: float = CAUTION):
    """Lower bound of a share of which ``pos`` of ``n`` were seen."""
    n = np.maximum(n, 1)
    p = pos / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _net(grams: list[str]) -> ahocorasick.Automaton:
    net = ahocorasick.Automaton()
    for i, g in enumerate(grams):
        net.add_word(g, i)
    net.make_automaton()
    return net


def _explain(sample: DataFrame, grams: list[str]) -> list[tuple[str, float]]:
    """The best n-gram first; the texts it explains then no longer speak for others, and so on while one is good
    enough. So parts that toxic words share with common ones stay out. Works on the bounded sample."""
    if not grams:
        return []

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _net(grams)
        for b in batches:
            got = [sorted({i for _, i in net.iter(t)}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["label", "held"])

    rows = sample.mapInArrow(holds, "label int, held array<int>").where("size(held) > 0").collect()
    has = np.zeros((len(rows), len(grams)), bool)
    for i, r in enumerate(rows):
        has[i, r["held"]] = True
    toxic = np.array([r["label"] == 1 for r in rows], bool)
    pos, neg = has[toxic].sum(0), has[~toxic].sum(0)
    at_first = wilson(pos, pos + neg)
    sure = (pos >= SURE * (pos + neg)) & (at_first >= 0.5)
    best = {grams[j]: float(at_first[j]) for j in np.flatnonzero(sure)}
    while True:
        bound = wilson(pos, pos + neg)
        j = int(np.argmax(bound))
        if bound[j] < LEAST_SHARE:
            return sorted(best.items())
        best[grams[j]] = max(best.get(grams[j], 0.0), float(bound[j]))
        done = has[:, j].copy()
        pos = pos - has[done & toxic].sum(0)
        neg = neg - has[done & ~toxic].sum(0)
        has[done] = False


def score(docs: DataFrame, model: np.ndarray, words: list[tuple[str, float]], text: str = "text",
          name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1): the greatest share of an n-gram in the restored text, 0 without one. Null
    and empty texts score 0; a column of that name is replaced. Whole texts are decoded, rows never meet."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model, words))
    rest = docs.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType(), False)])
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, grams = held.value
        d, net = Decoder(lm), ahocorasick.Automaton()
        for g, s in grams:
            net.add_word(g, s)
        if grams:
            net.make_automaton()
        for b in batches:
            out = [max((s for _, s in net.iter(d.text(t.as_py()))), default=0.0) if grams and t.is_valid else 0.0
                   for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=schema.names)

    return rest.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """``docs`` with held_out and score. The language model counts all texts of ``docs``; the scorer learns from
    rows of ``labels(doc_id, toxic)`` with a label of 0 or 1 and ``held_out`` false: by default the crc32 of the id
    as text leaves another remainder than 2 by 4. Of several labels of an id the greatest counts. Rows without an
    id are scored but never learned from."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2 if held_out is None else held_out
    known = (labels.where("toxic in (0, 1) and doc_id is not null").where(~held)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    model = language_model(trigram_counts(docs))
    text = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    words = lexicon(text, model)
    return score(docs.drop("held_out"), model, words).withColumn("held_out", F.coalesce(held, F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; columns named score or held_out are kept as they are."""
    own, back = set_aside(docs, ["score", "held_out"])
    return score_documents(own, labels).where(F.col("score") < least).select(*back)
