"""Secret scans by a trigram inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.store import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java regular expression; ``words``: strings in lower case of which every match holds one, in letters
    of either case (none: the rule has no mandatory string); ``group`` must have ``least`` characters, else the match is
    dropped."""
    kind: str
    pattern: str
    words: tuple[str, ...] = ()
    group: int = 0
    least: int = 1


# Letters beyond ASCII that are the other case of an ASCII letter, and that letter: long s, the Kelvin sign, the dotless
# and the dotted i.
OTHER_CASE = ("\u017f\u212a\u0131\u0130", "skii")

# The three kinds. Runs and tails have their least length in the pattern where that finds the same.
RULES = (
    Rule("assign", r"""(?iu)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def trigram_query(rule: Rule) -> list[list[str]]:
    """Disjunction of conjunctions of trigrams; empty if the rule has no mandatory string of three characters."""
    if not rule.words or min(map(len, rule.words)) < 3:
        return []
    return [sorted({w[i:i + 3] for i in range(len(w) - 2)}) for w in rule.words]


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches, in code points.

    The pieces between the matches and the matches themselves take turns, so running sums of their lengths are
    the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    shown = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length) \
        if rule.group else F.transform(found, F.char_length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.char_length).alias("long"), shown.alias("shown"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("all"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + p["gap"]
        hi = lo + F.coalesce(p["long"], F.lit(0))
        one = F.array(F.struct(lo.alias("start"), F.lit(kind).alias("kind"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(F.coalesce(p["shown"], F.lit(0)) >= rule.least,
                                               F.concat(acc["all"], one)).otherwise(acc["all"]).alias("all"))
    return F.aggregate(parts, start, step, lambda acc: acc["all"])


def postings(rows: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """The inverted index: key, gram (its place in ``grams``), for each trigram that the text in lower case holds. Letters
    that have an ASCII letter for their other case count as that letter."""
    lowered = F.lower(F.translate(F.col(text), *OTHER_CASE))
    holds = [F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]
    return (rows.select(key, lowered.alias("_low"))
            .select(key, F.explode(F.array_compact(F.array(*holds))).alias("gram")))


def candidates(index: DataFrame, key: str, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules (array of places in ``rules``): the rows whose postings satisfy a rule's query."""
    queries = [(i, trigram_query(r)) for i, r in enumerate(rules)]
    queries = [(i, q) for i, q in queries if q]
    held = index.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, gram)")).alias("bits"))
    if not queries:
        return held.where("false").select(key, F.array().cast("array<int>").alias("rules"))
    at = {g: i for i, g in enumerate(grams)}
    tests = []
    for i, q in queries:
        fits = F.lit(False)
        for conj in q:
            mask = sum(1 << at[g] for g in conj)
            fits = fits | (F.col("bits").bitwiseAND(F.lit(mask)) == F.lit(mask))
        tests.append(F.when(fits, F.lit(i)))
    return held.select(key, F.array_compact(F.array(*tests)).alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """``docs`` with an array ``name`` of struct(start, kind, end), sorted; start and end in code points.

    Each rule's mandatory strings become a Boolean query of trigrams. The index has a posting for every trigram of
    these queries that a text holds; equal texts share their postings. Intersecting them leaves a few candidates
    per rule, and only those are verified by the regular expression. Rules without a mandatory trigram scan all
    rows. A null text is empty. A column named ``name`` is replaced. At most 63 trigrams may be in use.
    """
    grams = sorted({g for r in rules for q in trigram_query(r) for g in q})
    if len(grams) > 63:
        raise ValueError("more than 63 trigrams: scan with fewer rules at a time")
    rows = docs.drop(name).withColumn("_key", F.xxhash64(text))
    if grams:
        index = materialize(postings(rows.where(F.col(text).isNotNull()), "_key", text, grams), "trigrams")
        hits = materialize(candidates(index, "_key", grams, rules), "trigrams")
        rows = rows.join(hits.withColumnRenamed("rules", "_rules"), "_key", "left")
    else:
        rows = rows.withColumn("_rules", F.lit(None).cast("array<int>"))
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for i, r in enumerate(rules):
        spans = _spans(whole, r, i)
        each.append(F.when(F.array_contains("_rules", i), spans).otherwise(none) if trigram_query(r) else
                    F.when(whole.rlike(r.pattern), spans).otherwise(none))
    return rows.withColumn(name, F.array_sort(F.concat(*each))).drop("_key", "_rules")
