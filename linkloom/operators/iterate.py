"""Iterative graph operators over arcs ``(src, dst)``.

Every loop has the same shape: a join of the frontier with the arcs, a set difference against
what is known, and one written table per round (``store.Rounds``). The driver only reads row
counts to decide when to stop. Arcs are joined on a vertex, and a vertex may hold a third of
them, so these joins salt hot vertices (``store.balanced_join``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ranking import top_per_group
from linkloom.store import HOT_ROWS, Rounds, Shelves, attach, balanced_join, hot_keys, materialize, write_table


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# --- peeling -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Peel:
    levels: DataFrame    # vid, level: longest chain of outgoing arcs, for peeled non-leaf vertices
    leftover: DataFrame  # src, dst: arcs whose source reaches a cycle
    rounds: int
    acyclic: bool
    open: bool = False   # not contracted: vertices on arcs of ``leftover`` may have levels all the same


# Rounds that strip one level each; what is then left is solved by contraction.
QUICK_ROUNDS = 8


# Arcs from which on those of vertices that nothing points to are set aside first.
ROOT_ARCS = 1_000_000


def peel(pairs: DataFrame, quick: int = QUICK_ROUNDS, contract: bool = True) -> Peel:
    """Levels and what leads to cycles, see ``_strip``.

    Arcs of a vertex that nothing points to matter to no other vertex. In a large graph, where they are often most arcs,
    the rounds go over the others, and such a vertex gets its level from those of its targets.
    """
    if pairs.limit(ROOT_ARCS + 1).count() <= ROOT_ARCS:
        return _strip(pairs, quick, contract)
    heads, n = write_table(pairs.select(F.col("dst").alias("src")).distinct(), "heads")
    core = materialize(attach(pairs, heads, ["src"], "left_semi", n).select("src", "dst"), "core")
    inner = _strip(core, quick, contract)
    stuck, open_ends = write_table(inner.leftover.select(F.col("src").alias("dst")).distinct(), "stuck")
    outer = attach(pairs, heads, ["src"], "left_anti", n).select("src", "dst")
    levels = materialize(inner.levels, "levels")
    ends = levels.select(F.col("vid").alias("dst"), "level")
    leftover = inner.leftover
    if open_ends:
        ends = ends.unionByName(stuck.select("dst", F.lit(None).cast("int").alias("level")))
        lost = attach(outer, stuck, ["dst"], "left_semi", open_ends, pairs).select("src", "dst")
        leftover = materialize(leftover.unionByName(lost), "leftover")
    # A target without a row is no source; one without a level leads to a cycle.
    below = attach(outer, ends.withColumn("_source", F.lit(True)), ["dst"], "left", None, pairs)
    step = F.when(F.col("_source"), F.col("level") + 1).otherwise(F.lit(1))
    tops = below.groupBy(F.col("src").alias("vid")).agg(F.max(step).alias("level"), F.bool_and(step.isNotNull()).alias("_placed"))
    return Peel(levels.unionByName(tops.where("_placed").select("vid", "level")), leftover, inner.rounds + 1, inner.acyclic, inner.open)


def _strip(pairs: DataFrame, quick: int, contract: bool) -> Peel:
    """Strip sinks round by round, then contract chains (if ``contract``).

    A vertex that is still a source after ``k`` rounds has a chain of more than ``k`` arcs below it. Most graphs are done
    in a few rounds; what is left after ``quick`` of them has long chains or cycles and goes to ``contracted_levels``.
    Arcs between vertices that it cannot place lead to a cycle.
    """
    rounds = Rounds("peel")
    left = pairs.count()
    hot = hot_keys(pairs, ["dst"], left)
    current, k = pairs.select("src", "dst", F.lit(1).alias("k")), 1
    while left and k <= quick:
        live = current.select(F.col("src").alias("dst")).distinct()
        k += 1
        following, n = rounds.add(balanced_join(current.select("src", "dst"), live, ["dst"], "left_semi", hot)
                                  .select("src", "dst", F.lit(k).alias("k")))
        if n == left:
            k -= 1
            rounds.paths.pop()
            break
        current, left = following, n
    first = pairs.select(F.col("src").alias("vid"), F.lit(1).alias("level"))
    seen = first.unionByName(rounds.all().select(F.col("src").alias("vid"), F.col("k").alias("level"))) \
        if rounds.paths else first
    top = seen.groupBy("vid").agg(F.max("level").alias("level"))
    leftover, placed = current.select("src", "dst").where("false"), None
    if left:
        top = top.join(current.select(F.col("src").alias("vid")).distinct(), "vid", "left_anti")
        leftover = current.select("src", "dst")
        if k > quick and contract:
            placed, n = write_table(contracted_levels(leftover, k), "placed")
            top = top.unionByName(placed)
            for end in ("src", "dst"):
                leftover = attach(leftover, placed.select(F.col("vid").alias(end)), [end], "left_anti", n)
            ends = current.select(F.col("src").alias("dst")).distinct()
            leftover, left = write_table(balanced_join(leftover, ends, ["dst"], "left_semi", hot).select("src", "dst"), "leftover")
    return Peel(top, leftover, k - 1, left == 0, left > 0 and k > quick and not contract)


def contracted_levels(arcs: DataFrame, base: int) -> DataFrame:
    """vid, level: the longest chain below each source of ``arcs`` that leads to no cycle, in few rounds.

    A target that is no source has ``base`` - 1 arcs below it; all such are one ground. A vertex with a single target is
    its target and a weight: pointer jumping takes whole chains of them at once. The other vertices then point to where
    these chains end; of several arcs to one end the heaviest counts, so that vertices get a single target in turn. The
    number of phases is that of branchings above one another, not that of levels.
    """
    sources = arcs.select(F.col("src").alias("dst"), F.lit(True).alias("_live")).distinct()
    marked = balanced_join(arcs, sources, ["dst"], "left", hot_keys(arcs, ["dst"]))
    now = marked.select("src", F.when(F.col("_live"), F.col("dst")).alias("dst"),  # the ground is null
                        F.when(F.col("_live"), F.lit(1)).otherwise(F.lit(base)).alias("w"))
    now, left = write_table(now.groupBy("src", "dst").agg(F.max("w").alias("w")), "contracted")
    phases: list[DataFrame] = []
    while left:
        single = now.groupBy(F.col("src").alias("vid")).agg(
            F.count(F.lit(1)).alias("_n"), F.max("dst").alias("at"), F.max("w").alias("w")).where("_n = 1")
        chains, many = Rounds("chains").add(single.select("vid", "at", "w", F.lit(True).alias("moved")))
        if not many:
            break
        moved, jumps = many, 0
        while moved and 1 << jumps <= 2 * many:  # longer than that only around a cycle
            jumps += 1
            ahead = chains.select(F.col("vid").alias("at"), F.col("at").alias("_at"), F.col("w").alias("_w"), F.lit(True).alias("_on"))
            step = balanced_join(chains.drop("moved"), ahead, ["at"], "left", hot_keys(chains, ["at"], many))
            chains, moved = Rounds("chains").add(step.select(
                "vid", F.when(F.col("_on"), F.col("_at")).otherwise(F.col("at")).alias("at"),
                (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.coalesce("_on", F.lit(False)).alias("moved")), "moved")
        phases.append(chains)
        rest = attach(now, chains.select(F.col("vid").alias("src")), ["src"], "left_anti", many)
        ends = chains.select(F.col("vid").alias("dst"), F.col("at").alias("_at"), F.col("w").alias("_w"), "moved")
        rest = attach(rest, ends, ["dst"], "left", many)
        # A chain that ended nowhere stays a target of its own, which is never placed.
        through = F.col("moved").isNotNull() & ~F.coalesce("moved", F.lit(False))
        rest = rest.select("src", F.when(through, F.col("_at")).otherwise(F.col("dst")).alias("dst"),
                           F.when(through, F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"))
        now, left = write_table(rest.groupBy("src", "dst").agg(F.max("w").alias("w")), "contracted")
    placed = None
    for chains in reversed(phases):
        ended = chains.where("not moved")
        here = ended.where("at is null").select("vid", F.col("w").alias("level"))
        if placed is not None:
            above = attach(ended.where("at is not null"), placed.select(F.col("vid").alias("at"), "level"), ["at"], "inner")
            here = here.unionByName(above.select("vid", (F.col("level") + F.col("w")).alias("level"))).unionByName(placed)
        placed = materialize(here, "placed")
    return placed if placed is not None else arcs.select(F.col("src").alias("vid"), F.lit(0).alias("level")).where("false")


# --- strongly connected components ---------------------------------------------------------

def _mixed(vid: str, back: bool = False) -> Column:
    """A vertex number exchanged for one in no order, one to one: two turns of a Feistel network; or the way back."""
    def turn(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(F.xxhash64(b).bitwiseAND(F.lit(0xFFFFFFFF)))
    high, low = F.shiftrightunsigned(vid, 32), F.col(vid).bitwiseAND(F.lit(0xFFFFFFFF))
    if back:
        low = turn(low, high)
        high = turn(high, low)
    else:
        high = turn(high, low)
        low = turn(low, high)
    return F.shiftleft(high, 32).bitwiseOR(low)


class TooDeep(Exception):
    """A loop takes more rounds than its caller allows."""


# Rounds of ``components`` after which a graph counts as deep.
MOST_ROUNDS = 24


class _Patience:
    """Rounds that loops may still take together; without a number any."""

    def __init__(self, rounds: int | None):
        self.left = rounds

    def spend(self, rounds: int = 1) -> None:
        if self.left is not None:
            if self.left < rounds:
                raise TooDeep
            self.left -= rounds


def components(pairs: DataFrame, start: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame | None:
    """Members of components with more than one vertex: ``vid, comp``; None when there are none.

    ``comp`` is the smallest member. Vertices that cannot lie on a cycle are trimmed from both
    ends; the rest is solved by colouring: the smallest vertex that reaches a vertex is its
    colour, and the members of a component are those that reach the colour's own vertex without
    leaving the colour: a colouring against the arcs. Vertices are numbered in no order
    meanwhile, so colours jump far on rings and chains however these are numbered. ``start`` may
    name arcs already known to hold all cycles. Raises ``TooDeep`` after ``most_rounds``, if given.
    """
    patience = _Patience(most_rounds)
    rest = (start if start is not None else pairs).where("src <> dst") \
        .select(_mixed("src").alias("src"), _mixed("dst").alias("dst")).distinct()
    rest, n = _trim(rest, patience)
    found: list[DataFrame] = []
    while n:
        colour, vertices = _colours(rest, n, patience)
        if n == vertices:
            # One arc in and one out for every vertex: the colours are the cycles themselves.
            found.append(colour.select("vid", F.col("colour").alias("comp")))
            break
        members = _members(rest, colour, n, patience)
        found.append(members)
        for end in ("src", "dst"):
            rest = balanced_join(rest, members.select(F.col("vid").alias(end)), [end], "left_anti",
                                 hot_keys(rest, [end], n))
        rest, n = _trim(rest, patience)
    if not found:
        return None
    named = union_all(found).select(_mixed("vid", back=True).alias("vid"), "comp")
    least = named.groupBy("comp").agg(F.min("vid").alias("head"), F.count(F.lit(1)).alias("members")) \
        .where("members > 1").select("comp", "head")
    least, groups = write_table(least, "heads")
    return attach(named, least, ["comp"], "inner", groups).select("vid", F.col("head").alias("comp")) if groups else None


def _trim(pairs: DataFrame, patience: _Patience) -> tuple[DataFrame, int]:
    """Drop arcs until every source has an arc in and every target an arc out."""
    current, left = pairs, -1
    start = pairs.limit(HOT_ROWS + 1).count()
    by_src, by_dst = hot_keys(pairs, ["src"], start), hot_keys(pairs, ["dst"], start)
    while left:
        patience.spend(2)  # arcs that dangle this deep show a deep graph sooner than colours do
        heads = current.select(F.col("dst").alias("src")).distinct()
        tails = current.select(F.col("src").alias("dst")).distinct()
        kept = balanced_join(current, heads, ["src"], "left_semi", by_src)
        current, n = write_table(balanced_join(kept, tails, ["dst"], "left_semi", by_dst).select("src", "dst"), "trim")
        if n == left:
            break
        left = n
    return current, left


def _colours(pairs: DataFrame, rows: int, patience: _Patience) -> tuple[DataFrame, int]:
    """vid, colour: the smallest vertex with a path to ``vid`` (itself included); and how many vertices.

    In a round a vertex takes the least of its colour, those of its predecessors that changed, and the colour of
    the vertex that names its colour: what reaches that one reaches the vertex too. So colours travel twice as far
    with each round along rings and chains. Where a ring shares vertices with a greater one, a colour that enters
    it still goes one arc a round until it meets the ring's own smallest vertex.
    """
    hot = hot_keys(pairs, ["src"], rows)
    best, vertices = write_table(
        pairs.select(F.col("dst").alias("vid"), F.least("src", "dst").alias("colour"))
             .unionByName(pairs.select(F.col("src").alias("vid"), F.col("src").alias("colour")))
             .groupBy("vid").agg(F.min("colour").alias("colour")), "colour")
    changed, moved = best, 1
    while moved:
        patience.spend()
        offered = (balanced_join(pairs, changed.select(F.col("vid").alias("src"), "colour"), ["src"], "inner", hot)
                   .groupBy(F.col("dst").alias("vid")).agg(F.min("colour").alias("offer")))
        jumps = best.where("colour < vid").select(F.col("vid").alias("colour"), F.col("colour").alias("jump"))
        farther = balanced_join(best, jumps, ["colour"], "left", hot_keys(best, ["colour"], vertices))
        lowest = F.least("colour", "offer", "jump")
        following, moved = Rounds("colour").add(
            farther.join(offered, "vid", "left")
                   .select("vid", lowest.alias("colour"), (lowest < F.col("colour")).alias("moved")), "moved")
        best = following.select("vid", "colour")
        changed = following.where("moved").select("vid", "colour")
    return best, vertices


def _members(pairs: DataFrame, colour: DataFrame, rows: int, patience: _Patience) -> DataFrame:
    """Vertices from which the vertex naming their colour can be reached inside the colour. A colour's own vertex is
    its smallest, so these are the vertices that get the same colour against the arcs."""
    s = colour.select(F.col("vid").alias("src"), F.col("colour").alias("comp"))
    d = colour.select(F.col("vid").alias("dst"), F.col("colour").alias("comp"))
    with_source = balanced_join(pairs, s, ["src"], "inner", hot_keys(pairs, ["src"], rows))
    inside, n = write_table(balanced_join(with_source, d, ["dst", "comp"], "inner",
                                          hot_keys(with_source, ["dst", "comp"], rows))
                            .select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
    back, _ = _colours(inside, n, patience)
    return materialize(colour.join(back, ["vid", "colour"], "left_semi").select("vid", F.col("colour").alias("comp")),
                       "members")


def component_arcs(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Arcs with the component of each end: src, dst, cs, cd (a vertex alone is its own)."""
    if comps is None:
        return pairs.select("src", "dst", F.col("src").alias("cs"), F.col("dst").alias("cd"))
    rows = comps.count()
    s = comps.select(F.col("vid").alias("src"), F.col("comp").alias("_s"))
    d = comps.select(F.col("vid").alias("dst"), F.col("comp").alias("_d"))
    return (attach(attach(pairs, s, ["src"], "left", rows), d, ["dst"], "left", rows, pairs)
                 .select("src", "dst", F.coalesce("_s", "src").alias("cs"),
                         F.coalesce("_d", "dst").alias("cd")))


def condense(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The acyclic graph of components: distinct (src, dst) between different components."""
    return (component_arcs(pairs, comps).where("cs <> cd")
            .select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct())


# --- closure -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Closure:
    reach: DataFrame      # a, b, dist: b is reachable from a over dist >= 1 arcs (fewest)
    bypassed: DataFrame   # src, dst: input arcs with another path from src to dst (acyclic input)


def closure(pairs: DataFrame) -> Closure:
    """All reachable pairs, one length per round.

    Each round extends the newest pairs by one arc at the front. Extensions that hit an input
    arc show that this arc has a detour; they are kept as ``bypassed``, so reduction of an
    acyclic graph needs no further join.
    """
    rounds = Rounds("reach")
    delta, fresh = rounds.add(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
                              .select("a", "b", F.lit(1).alias("dist"), F.lit(True).alias("fresh")), "fresh")
    arcs = delta.select("a", F.col("b").alias("m"))
    hot = hot_keys(arcs, ["m"], fresh)
    dist = 1
    while fresh:
        dist += 1
        newest = delta.where("fresh").select(F.col("a").alias("m"), "b")
        longer = balanced_join(arcs, newest, ["m"], "inner", hot).select("a", "b").distinct()
        seen = rounds.all().where("fresh").select("a", "b", F.col("dist").alias("before"))
        delta, fresh = rounds.add(
            longer.join(seen, ["a", "b"], "left").where("before is null or before = 1")
                  .select("a", "b", F.lit(dist).alias("dist"), F.col("before").isNull().alias("fresh")), "fresh")
    return Closure(rounds.all().where("fresh").select("a", "b", "dist"),
                   rounds.all().where("not fresh").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


# --- sets of ancestors ---------------------------------------------------------------------

# Vertex numbers of a bucket, whose set is the bits of one BIGINT.
BUCKET_BITS = 6
_PLACE = (1 << BUCKET_BITS) - 1


def bucket_of(vid: str) -> Column:
    return F.shiftright(vid, BUCKET_BITS).alias("bucket")


def bits_of(vid: str) -> Column:
    return F.bit_or(F.expr(f"shiftleft(1L, cast({vid} & {_PLACE} as int))"))


def has_bit(bits: str, vid: str) -> Column:
    """Whether the set of the bucket of ``vid`` holds it."""
    return F.expr(f"(shiftright({bits}, cast({vid} & {_PLACE} as int)) & 1) = 1")


def _bytes(bits: str) -> Column:
    """A BIGINT as eight bytes, lowest first."""
    held = f"unhex(lpad(hex({bits}), 16, '0'))"
    return F.expr(f"if({bits} is null, null, concat({', '.join(f'substring({held}, {k}, 1)' for k in range(8, 0, -1))}))").alias(bits)


@dataclass(frozen=True)
class Ancestors:
    words: DataFrame  # vid, bucket, bits, far: what reaches vid, and what reaches it over two arcs or more
    arcs: DataFrame   # src, dst, sl, tl: the arcs with the levels of their ends

    @property
    def sets(self) -> DataFrame:
        """``words`` as bitmaps of bytes."""
        return self.words.select("vid", "bucket", _bytes("bits"), _bytes("far"))

    def bypassed(self) -> DataFrame:
        """Arcs (src, dst) with another path from src to dst. Between neighbouring levels there is none; of the wider arcs
        the source is looked up in what reaches the target over two arcs or more."""
        far = self.words.where("far is not null").select(F.col("vid").alias("dst"), "bucket", "far")
        wide = self.arcs.where("sl - tl > 1").withColumn("bucket", bucket_of("src"))
        return wide.join(far, ["dst", "bucket"]).where(has_bit("far", "src")).select("src", "dst")


def member_bits(comps: DataFrame) -> DataFrame:
    """comp, bucket, bits: the members of each component."""
    return comps.groupBy("comp", bucket_of("vid")).agg(bits_of("vid").alias("bits"))


def ancestor_sets(dag: DataFrame, levels: DataFrame, comps: DataFrame | None = None,
                  known: DataFrame | None = None) -> Ancestors:
    """The vertices that reach each vertex of an acyclic graph, as bits per bucket of vertex numbers.

    ``levels(vid, level)`` has the longest chain below each source. ``comps(vid, comp)`` names the members of vertices
    that stand for components: a set holds all of them. ``known(vid, bucket, bits)`` adds to the sets of some vertices.

    What points to a vertex directly is one aggregation over all arcs. Sets then go down level by level, only along arcs
    from vertices that have ancestors: each arc is followed once, and each set is written once for the level it goes to
    (``store.Shelves``). A row holds up to 64 vertices of a set: a set spread thin takes no more than a row for each of its
    vertices, and sets are put together by plain numbers, before they are sent and without an object per set.
    """
    rows = levels.count()
    arcs = attach(dag.select("src", "dst"), levels.select(F.col("vid").alias("src"), F.col("level").alias("sl")), ["src"], "inner", rows, dag)
    arcs = attach(arcs, levels.select(F.col("vid").alias("dst"), F.col("level").alias("_tl")), ["dst"], "left", rows, dag)
    arcs = materialize(arcs.select("src", "dst", "sl", F.coalesce("_tl", F.lit(0)).alias("tl")), "levelled")
    alone = arcs
    shelves = Shelves(dag.sparkSession, "ancestors", "to")
    if comps is not None:
        inside, groups = write_table(member_bits(comps), "member_bits")
        heads = inside.select(F.col("comp").alias("src")).distinct()
        alone = attach(arcs, heads, ["src"], "left_anti", groups)
        many = attach(arcs, inside.withColumnRenamed("comp", "src"), ["src"], "inner", groups)
        shelves.put(many.groupBy(F.col("dst").alias("vid"), "bucket", F.col("tl").alias("to"))
                    .agg(F.bit_or("bits").alias("bits")).withColumn("far", F.lit(False)))
    shelves.put(alone.groupBy(F.col("dst").alias("vid"), bucket_of("src"), F.col("tl").alias("to"))
                .agg(bits_of("src").alias("bits")).withColumn("far", F.lit(False)))
    reached = arcs.select(F.col("dst").alias("src")).distinct()
    if known is not None:
        known = attach(known, levels, ["vid"], "left", rows).select(
            "vid", "bucket", F.coalesce("level", F.lit(0)).alias("to"), "bits", F.lit(False).alias("far"))
        shelves.put(known)
        reached = reached.unionByName(known.select(F.col("vid").alias("src"))).distinct()
    inner = materialize(arcs.join(reached, "src", "left_semi"), "inner_arcs")
    for level in sorted((r["sl"] for r in inner.select("sl").distinct().collect()), reverse=True):
        down = inner.where(F.col("sl") == level).select(F.col("src").alias("vid"), "dst", "tl")
        sets = shelves.take(level).groupBy("vid", "bucket").agg(F.bit_or("bits").alias("bits"))
        shelves.put(balanced_join(down, sets, ["vid"], "inner", hot_keys(down, ["vid"]))
                    .groupBy(F.col("dst").alias("vid"), "bucket", F.col("tl").alias("to"))
                    .agg(F.bit_or("bits").alias("bits")).withColumn("far", F.lit(True)))
    held, whole = shelves.all(), None
    if comps is None and known is None:
        # What gets nothing from afar has its words already, one for each bucket.
        more, n = write_table(inner.select(F.col("dst").alias("vid")).distinct(), "more")
        whole = attach(held, more, ["vid"], "left_anti", n)
        held = attach(held, more, ["vid"], "left_semi", n)
    words = materialize(held.groupBy("vid", "bucket").agg(
        F.bit_or("bits").alias("bits"), F.bit_or(F.when(F.col("far"), F.col("bits"))).alias("far")), "ancestors")
    if whole is not None:
        words = words.unionByName(whole.select("vid", "bucket", "bits", F.lit(None).cast("bigint").alias("far")))
    return Ancestors(words, arcs)


# --- reduction -----------------------------------------------------------------------------

def redundant_arcs(pairs: DataFrame, comps: DataFrame | None, bypassed: DataFrame) -> DataFrame:
    """Arcs (s, t) for which another direct successor of s reaches t by at least one arc.

    Let c be the component of t.
    * s has two or more distinct successors in c: each reaches the other, so all go.
    * s lies in a component of several vertices, or has a self-loop, and t is outside: some
      successor of s stays in the component of s (or is s) and reaches whatever s reaches.
    * otherwise the question is settled between components: the component arc is bypassed.
    """
    own = component_arcs(pairs, comps)
    crowd = own.groupBy("src", "cd").agg(F.count(F.lit(1)).alias("heads"))
    looped = own.where("cs = cd").select("src").distinct().withColumn("loops", F.lit(True))
    detour = bypassed.select(F.col("src").alias("cs"), F.col("dst").alias("cd"), F.lit(True).alias("passed"))
    return (own.join(crowd, ["src", "cd"])
               .join(looped, "src", "left")
               .join(detour, ["cs", "cd"], "left")
               .where("heads >= 2 or (cs <> cd and (loops or passed))")
               .select("src", "dst"))


def redundant_between_components(pairs: DataFrame, comps: DataFrame | None, bypassed: DataFrame) -> DataFrame:
    """Arcs between components whose component arc has a detour; components stay whole."""
    own = component_arcs(pairs, comps)
    detour = bypassed.select(F.col("src").alias("cs"), F.col("dst").alias("cd"))
    return own.join(detour, ["cs", "cd"], "left_semi").select("src", "dst")


# --- searches ------------------------------------------------------------------------------

def reach_from(pairs: DataFrame, seeds: DataFrame, max_dist: int | None = None,
               reverse: bool = False) -> DataFrame:
    """Breadth-first search from many seeds at once.

    ``seeds`` has a column ``seed``, and ``vid`` where several vertices start one search.
    Returns seed, vid, dist (0 for a start) and parent, the smallest predecessor on a shortest
    path.
    """
    arcs = pairs.select(F.col("dst").alias("vid"), F.col("src").alias("next")) if reverse \
        else pairs.select(F.col("src").alias("vid"), F.col("dst").alias("next"))
    hot = hot_keys(arcs, ["vid"], pairs.count())
    if "vid" not in seeds.columns:
        seeds = seeds.withColumn("vid", F.col("seed"))
    known = Rounds("search")
    frontier, n = known.add(seeds.select("seed", "vid").distinct().select(
        "seed", "vid", F.lit(0).alias("dist"), F.lit(None).cast("bigint").alias("parent")))
    dist = 0
    while n and (max_dist is None or dist < max_dist):
        dist += 1
        step = (balanced_join(arcs, frontier.select("seed", "vid"), ["vid"], "inner", hot)
                .groupBy("seed", F.col("next").alias("to")).agg(F.min("vid").alias("parent"))
                .withColumnRenamed("to", "vid"))
        frontier, n = known.add(
            step.join(known.all().select("seed", "vid"), ["seed", "vid"], "left_anti")
                .select("seed", "vid", F.lit(dist).alias("dist"), "parent"))
    return known.all()


def shortest_paths(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shortest path for many ``(from, to)`` pairs: from, to, path, direction.

    Forward paths win; the reverse direction is searched only for pairs without one. Of equally
    short paths the first in vertex order is kept. A start whose targets are all found stops.
    """
    wanted = materialize(wanted.select("from", "to").where("from <> to").distinct(), "wanted")
    forward = _paths(pairs, wanted).withColumn("direction", F.lit("forward"))
    missing = materialize(wanted.join(forward, ["from", "to"], "left_anti"), "wanted")
    backward = _paths(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), missing) \
        .withColumn("direction", F.lit("reverse"))
    return forward.unionByName(backward)


def _paths(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    arcs = pairs.select(F.col("src").alias("vid"), F.col("dst").alias("next"))
    hot = hot_keys(arcs, ["vid"], pairs.count())
    rounds = Rounds("paths")
    frontier, n = rounds.add(wanted.select("from").distinct().select(
        "from", F.col("from").alias("vid"), F.array("from").alias("path")))
    while n:
        reached = rounds.all().select("from", F.col("vid").alias("to"))
        still = wanted.join(reached, ["from", "to"], "left_anti").select("from").distinct()
        grown = (balanced_join(arcs, frontier.join(still, "from", "left_semi"), ["vid"], "inner", hot)
                 .groupBy("from", "next").agg(F.min(F.concat("path", F.array("next"))).alias("path")))
        frontier, n = rounds.add(
            grown.withColumnRenamed("next", "vid")
                 .join(reached.withColumnRenamed("to", "vid"), ["from", "vid"], "left_anti")
                 .select("from", "vid", "path"))
    return wanted.join(rounds.all().withColumnRenamed("vid", "to"), ["from", "to"])


# --- layers and trees ----------------------------------------------------------------------

def topological_layers(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """vid, layer: 0 imports nothing; a vertex follows once all its targets are placed.

    What never gets placed (cycles and everything above them) shares one last layer of its repo.
    """
    peeled = peel(pairs)
    stuck = peeled.leftover.select(F.col("src").alias("vid")).distinct().withColumn("stuck", F.lit(True))
    placed = (vertices.select("repo", "vid").join(peeled.levels, "vid", "left").join(stuck, "vid", "left")
              .select("repo", "vid", "stuck", F.coalesce("level", F.lit(0)).alias("level")))
    last = placed.where("stuck is null").groupBy("repo").agg((F.max("level") + 1).alias("last"))
    return (attach(placed, last, ["repo"])
            .select("vid", F.when(F.col("stuck"), F.coalesce("last", F.lit(0))).otherwise(F.col("level"))
                    .cast("bigint").alias("layer")))


def forest(vertices: DataFrame, pairs: DataFrame, impacts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Dependency forest below the roots of each repo: repo, parent, child, dist, first.

    Roots are vertices nothing points to; a repo without one starts at its five vertices of
    highest impact. Each edge below a root (within ``max_depth``, where a display asks for one) is a row; ``first`` marks the one that shows
    the child for the first time (fewest steps, then smallest parent).
    """
    inner = pairs.where("src <> dst").select(F.col("dst").alias("vid")).distinct()
    looped = pairs.where("src = dst").select(F.col("src").alias("vid"))
    roots = vertices.join(inner, "vid", "left_anti").join(looped, "vid", "left_anti").select("repo", "vid")
    rootless = vertices.join(roots.select("repo").distinct(), "repo", "left_anti").select("repo", "vid")
    ranked = rootless.join(impacts, "vid", "left").withColumn("impact", F.coalesce("impact", F.lit(0)))
    spare = top_per_group(ranked, ["repo"], [F.desc("impact"), F.asc("vid")], 5).select("repo", "vid")
    starts = roots.unionByName(spare).select(F.col("repo").alias("seed"), "vid")
    seen = reach_from(pairs, starts, max_depth)
    first = seen.select(F.col("seed").alias("repo"), F.col("vid").alias("child"), "parent")
    shown = seen if max_depth is None else seen.where(F.col("dist") < max_depth)
    shown = shown.select("seed", F.col("vid").alias("src"), "dist")
    edges = (pairs.join(shown, "src")
             .select(F.col("seed").alias("repo"), F.col("src").alias("parent"), F.col("dst").alias("child"),
                     (F.col("dist") + 1).alias("dist"))).distinct()
    marked = first.where("parent is not null").withColumn("first", F.lit(True))
    rows = edges.join(marked, ["repo", "parent", "child"], "left") \
        .withColumn("first", F.coalesce("first", F.lit(False)))
    tops = starts.select(F.col("seed").alias("repo"), F.lit(None).cast("bigint").alias("parent"),
                         F.col("vid").alias("child"), F.lit(0).alias("dist"), F.lit(True).alias("first"))
    return rows.unionByName(tops)
