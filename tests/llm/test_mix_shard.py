import bisect
import random
from collections import Counter

from pyspark.sql import functions as F

from linkloom.llm import sharding


def test_shards_are_even_and_slots_gapless(spark, docs):
    out = sharding.shard_rows(docs, [F.col("doc_id"), F.col("text")], 7)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == docs.count()
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.shard_rows(docs.limit(0), [F.col("doc_id")], 7).count() == 0


def test_overflow_goes_to_the_next_shard_with_room():
    starts, owners = sharding.ring(5, 8)
    counts = {c: 10 for c in range(0, sharding.CELLS, 601)} | {1: 500}
    pieces = sharding.place(counts, 5, 8)
    total, per = sum(counts.values()), Counter()
    covered = {}
    for cell, lo, hi, shard, slot in pieces:
        assert slot == per[shard]
        per[shard] += hi - lo
        covered.setdefault(cell, []).append((lo, hi))
    assert max(per.values()) - min(per.values()) <= 1 and sum(per.values()) == total
    for cell, n in counts.items():
        parts = sorted(covered[cell])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    # A new shard moves its own share and little more: 4.8 % and 2.4 % would be the least.
    uniform = {c: 4 for c in range(0, sharding.CELLS, 16)}
    where = lambda k: {(c, r): s for c, lo, hi, s, _ in sharding.place(uniform, k) for r in range(lo, hi)}
    for k, most, among_old in ((20, 0.07, 0.023), (40, 0.05, 0.026)):
        a, b = where(k), where(k + 1)
        assert sum(a[x] != b[x] for x in a) <= most * len(a)
        assert sum(a[x] != b[x] and b[x] < k for x in a) <= among_old * len(a)


def test_place_against_a_plain_walk():
    """Every row goes to the shard of the next virtual node; where that is full, on to the next one with room."""
    rnd = random.Random(3)
    for shards, virtual in ((3, 4), (7, 16), (40, 32)):
        starts, owners = sharding.ring(shards, virtual)
        for counts in ({rnd.randrange(sharding.CELLS): rnd.randint(1, 30) for _ in range(200)}, {5: 700, 6: 1, 60000: 3}, {9: 2}):
            total = sum(counts.values())
            room = {s: total // shards + (s < total % shards) for s in range(shards)}
            got = sharding.place(counts, shards, virtual)
            full = Counter()
            for cell, lo, hi, shard, slot in got:
                full[shard] += hi - lo
            assert all(full[s] == room[s] for s in room)
            # A plain walk: rows at home first, as far as there is room, then those that overflow, both in ring order.
            home = lambda cell: bisect.bisect_left(starts, cell) % len(starts)
            left, want, over = dict(room), Counter(), []
            for cell in sorted(counts):
                node = home(cell)
                n = min(counts[cell], left[owners[node]])
                want[cell, owners[node]] += n
                left[owners[node]] -= n
                over += [(cell, node)] * (counts[cell] - n)
            for cell, node in over:
                shard = next(owners[(node + k) % len(owners)] for k in range(len(owners)) if left[owners[(node + k) % len(owners)]])
                want[cell, shard] += 1
                left[shard] -= 1
            have = Counter()
            for cell, lo, hi, shard, _ in got:
                have[cell, shard] += hi - lo
            assert +have == +want
