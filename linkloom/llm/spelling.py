"""Groups of spelling variants: the vocabulary's acceptor, composed with a transducer of one edit and with itself."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.store import Rounds, attach, materialize, write_table

# Most words of a group that one acceptor takes; a larger group is dealt out by longer keys.
GROUP = 20_000
# Distinct words that a task holds before it sends their counts on.
HELD = 400_000
BATCH = 10_000


# --- words ---------------------------------------------------------------------------------

def thinned(run: str, h: int, every: int) -> str:
    """``run`` without its code point h modulo its length, if ``every`` divides h."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 7, least: int = 2,
                every: int = 31) -> DataFrame:
    """word, n: what maximal runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF) of whole texts become, with A-Z lowered.

    A run whose checksum with the document's key is divided by ``every`` loses one code point (``thinned``). Results of
    ``least_chars`` code points or more with ``least`` occurrences or more are kept. A null text has no runs, a null key
    counts as an empty one; repeated rows count again.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)  # a deletion only makes runs shorter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if not value.is_valid:
                    continue
                start = zlib.crc32((name.as_py() or "").encode() + b":")
                words = runs.findall(value.as_py().lower().decode())  # bytes: only A-Z are lowered
                held.update([thinned(w, h, every) if h % every == 0 else w
                             for w, h in zip(words, [zlib.crc32(w.encode(), start) for w in words])])
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(f"`{key}`").cast("string").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return (texts.mapInArrow(run, "word string, n bigint").where(F.char_length("word") >= least_chars)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# --- acceptor and composition --------------------------------------------------------------

class Acceptor:
    """Minimal deterministic acceptor of strings given in rising order, of one length or of two that differ by one.

    States are numbered from the last; ``steps`` has their transitions, ``size`` how many strings they accept, ``low`` and
    ``high`` the lengths of these.
    """

    def __init__(self, strings: list[str]):
        self.final, self.steps, self.size, self.low, self.high = [], [], [], [], []
        known: dict = {}
        path: list[list] = [[False, {}]]
        before = ""

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                final, steps = path.pop()
                path[-1][1][before[len(path) - 1]] = self._state(known, final, steps)

        for s in strings:
            same = 0
            for a, b in zip(s, before):
                if a != b:
                    break
                same += 1
            fold(same)
            path.extend([False, {}] for _ in range(len(s) - same))
            path[-1][0] = True
            before = s
        fold(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict, final: bool, steps: dict[str, int]) -> int:
        key = (final, *steps.items())
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.steps)
            self.final.append(final)
            self.steps.append(steps)
            self.size.append(final + sum(self.size[q] for q in steps.values()))
            self.low.append(0 if final else 1 + min((self.low[q] for q in steps.values()), default=0))
            self.high.append(max((1 + self.high[q] for q in steps.values()), default=0))
        return state

    def common(self, p: int, q: int, length: int) -> list[str]:
        """Strings of a length that both states accept."""
        low, high, steps = self.low, self.high, self.steps
        out, stack = [], [(p, q, length, "")]
        while stack:
            p, q, left, s = stack.pop()
            if not left:
                if self.final[p] and self.final[q]:
                    out.append(s)
                continue
            more = steps[q]
            for a, p_a in steps[p].items():
                q_a = more.get(a)
                if q_a is not None and low[p_a] < left <= high[p_a] + 1 and low[q_a] < left <= high[q_a] + 1:
                    stack.append((p_a, q_a, left - 1, s + a))
        return out

    def near(self, length: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the acceptor, one edit, and the acceptor: strings of ``length`` with those of the same length
        that differ in one place (each pair once), and with those that lack one character. Each pair is reached by one path
        only: the edit is at the first place where the two differ."""
        low, high, size = self.low, self.high, self.size
        found: dict[tuple[int, int, int], list[str]] = {}

        def common(p: int, q: int, left: int) -> list[str]:
            if not (low[p] <= left <= high[p] and low[q] <= left <= high[q]):
                return []
            key = (p, q, left)
            if key not in found:
                found[key] = self.common(p, q, left)
            return found[key]

        stack = [(self.start, length, "")]
        while stack:
            p, left, s = stack.pop()
            # No edit yet: both stand in the same state.
            steps = list(self.steps[p].items())
            for i, (a, p_a) in enumerate(steps):
                if not low[p_a] < left <= high[p_a] + 1:
                    continue
                if size[p_a] > 1:
                    stack.append((p_a, left - 1, s + a))
                for b, p_b in steps[i + 1:]:
                    for end in common(p_a, p_b, left - 1):
                        yield s + a + end, s + b + end
                for end in common(p_a, p, left - 1):
                    if end[:1] != a:
                        yield s + a + end, s + end


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near (how many), n and form (the most frequent, then first near word) of the groups in rows (chars, head,
    tail, part, n), which are sorted by group and part."""
    out: list[tuple[str, int, int, str]] = []

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["word", "near", "n", "form"])
        out.clear()
        return got

    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    for (chars, head, tail), members in groupby(rows, key=lambda r: r[:3]):
        n = {r[3]: r[4] for r in members}
        free = chars - len(head) - len(tail)
        if len(n) < 2 or max(map(len, n)) < free:
            continue
        best: dict[str, list] = {}
        for x, y in Acceptor(list(n)).near(free):
            # Beyond the free part the first difference may lie further on; then another group has the pair.
            if len(y) < free and tail and x[:-1] == y and x[-1] == tail[0]:
                continue
            for one, other in ((x, y), (y, x)):
                now = best.get(one)
                if now is None:
                    best[one] = [1, n[other], other]
                else:
                    now[0] += 1
                    if n[other] > now[1] or n[other] == now[1] and other + tail < now[2] + tail:
                        now[1:] = n[other], other
        for part, (near, most, form) in best.items():
            out.append((head + part + tail, near, most, head + form + tail))
            if len(out) >= BATCH:
                yield batch()
    if out:
        yield batch()


def _dealt(rows: DataFrame, chars: Column, head: Column, part: Column, tail: Column, free: Column) -> DataFrame:
    """Rows of a group under two longer keys: the first half of the free part goes to the head, or the rest to the tail.
    In a shorter word, what is missing is missing in the part that stays free."""
    half = F.floor(free / 2).cast("int")
    first, rest = half, (free - half).cast("int")
    size = F.char_length(part)
    cut = lambda s, at, length: F.substring(s, at, F.greatest(length, F.lit(0)))
    return rows.select("n", F.explode(F.array(
        F.struct(chars.alias("chars"), F.concat(head, cut(part, F.lit(1), first)).alias("head"), tail.alias("tail"),
                 cut(part, first + 1, size - first).alias("part")),
        F.struct(chars.alias("chars"), head.alias("head"), F.concat(cut(part, size - rest + 1, rest), tail).alias("tail"),
                 cut(part, F.lit(1), size - rest).alias("part")))).alias("g")).select("g.*", "n")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best for the words of ``words(word, n)`` that are near another: how many differ from it by
    exactly one inserted, deleted or replaced code point, and the most frequent of these (of equal ones the first).

    Two such words of at most c code points agree in their first c // 2 or in the rest, so words are grouped by lengths
    (c, c - 1) and either half. The state that a group's key leads to is the initial state of its composition: the acceptor
    of the parts that remain, one edit, and that acceptor again. A group beyond ``group`` words is dealt out in the same
    way by keys that are longer by half of what remains, until it is small: parts of one letter make few words.
    Every pair is found in one group only. Words are distinct and not null.
    """
    none = F.lit("")
    # In groups of its own length a word may be the longer one, in those of one more it is the shorter one.
    rows = words.select("word", "n", F.char_length("word").alias("_size")).select(
        "word", "n", F.explode(F.array(F.col("_size"), F.col("_size") + 1)).alias("_chars"))
    rows = materialize(_dealt(rows, F.col("_chars"), none, F.col("word"), none, F.col("_chars")), "spelling")
    key = ["chars", "head", "tail"]
    found = []
    while True:
        free = F.col("chars") - F.char_length("head") - F.char_length("tail")
        large, count = write_table(rows.groupBy(*key).count().where((F.col("count") > group) & (free > 1)).select(*key), "spelling")
        small = attach(rows, large, key, "left_anti", count) if count else rows
        sorted_rows = small.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "part")
        found.append(materialize(sorted_rows.select(*key, "part", "n").mapInArrow(
            _variants, "word string, near bigint, n bigint, form string"), "spelling"))
        if not count:
            break
        again = attach(rows, large, key, "left_semi", count)
        rows = materialize(_dealt(again, *[F.col(c) for c in ("chars", "head", "part", "tail")], free), "spelling")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return (every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.form").alias("best")))


def variant_groups(words: DataFrame, factor: int = 10, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words(word, n)``.

    ``form`` is the most frequent near word (``near_words``), if it is at least ``factor`` times as frequent; ``root`` is
    the last word reached from a word over forms, itself without a form. Forms grow by that factor, so chains are short;
    they are followed by doubling.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent")
    words = materialize(words.select("word", "n"), "spelling")
    near = near_words(words, group)
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= F.col("n") * factor, F.struct("best", "best_n")).alias("f"))
    known = materialize(known.select("word", "n", "n_near", F.col("f.best").alias("form"), F.col("f.best_n").alias("form_n")), "spelling")
    rounds = Rounds("spelling")
    now, moved = rounds.add(known.where("form IS NOT NULL").select("word", F.col("form").alias("at"), F.lit(True).alias("moved")), "moved")
    while moved:
        on = now.select(F.col("word").alias("at"), F.col("at").alias("_next"))
        step = attach(now.drop("moved"), on, ["at"], "left")
        now, moved = rounds.add(step.select("word", F.coalesce("_next", "at").alias("at"), F.col("_next").isNotNull().alias("moved")), "moved")
    return known.join(now.select("word", F.col("at").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
