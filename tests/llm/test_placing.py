"""Sharding and mixing against step-by-step versions of their rules."""

import random
from collections import Counter, defaultdict

import pytest

from fixwright.llm import mixing, sharding


def claimed(shards, size):
    """The table filled by shards that take turns over their whole preference lists."""
    lists = []
    for s in shards:
        start, step = sharding._hash(f"{s}/offset") % size, sharding._hash(f"{s}/step") % (size - 1) + 1
        lists.append(iter([(start + i * step) % size for i in range(size)]))
    table, turn = {}, 0
    while len(table) < size:
        table[next(x for x in lists[turn % len(shards)] if x not in table)] = turn % len(shards)
        turn += 1
    return tuple(table[i] for i in range(size))


@pytest.mark.parametrize("n,size", [(1, 7), (3, 31), (5, 101), (7, 7)])
def test_table_is_filled_by_turns(n, size):
    shards = tuple(f"s{i}" for i in range(n))
    assert sharding.filled(shards, size) == claimed(shards, size)


def test_table_is_even_and_stable():
    names = sharding.SHARDS
    before, after = sharding.filled(names, 65_537), sharding.filled(names[:-1], 65_537)
    share = Counter(before)
    assert max(share.values()) - min(share.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != len(names) - 1)
    assert moved < 0.1 * len(before)


def test_table_refuses_bad_sizes():
    for shards, size in ((("a",), 8), (("a", "a"), 7), ((), 7), (tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.filled(shards, size)


def test_placement_edge_cases(spark):
    rows = spark.createDataFrame([(1, "x", "old"), (1, "x", "old"), (None, None, None)], "doc_id bigint, text string, Shard string")
    got = sharding.place(rows)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    out = got.collect()
    assert len(out) == 3 and len({(r.doc_id, r.shard) for r in out}) == 2 and all(r.shard in sharding.SHARDS for r in out)
    assert sharding.place(rows.limit(0)).count() == 0


def simulated(blocks, weights):
    """Slots of blocks, choosing slot by slot the released block with the earliest deadline."""
    left, done, t, out = dict(blocks), Counter(), 0, []
    while any(left.values()):
        live = [s for s in sorted(left) if left[s]]
        total = sum(weights[s] for s in live)
        free = [s for s in live if done[s] * total // weights[s] <= t]
        pick = min(free, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
        out.append(pick)
        left[pick] -= 1
        done[pick] += 1
        t += 1
        if not left[pick]:
            done, t = Counter(), 0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_phases_follow_the_simulation(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randint(1, 6))]
    blocks = {s: rng.randint(0, 60) for s in names}
    weights = {s: rng.randint(1, 20) for s in names}
    slots = {}
    for s, first, n, start, length, within in mixing.phases(blocks, weights):
        for b in range(n):
            slots[start + b // len(within) * length + within[b % len(within)]] = (s, first + b)
    want = simulated(blocks, weights)
    assert [slots[i][0] for i in range(len(want))] == want and len(slots) == len(want)


def test_share_is_never_a_block_away():
    weights = {"a": 503, "b": 297, "c": 11, "d": 189}
    slots = mixing.period(weights)
    order = {t: s for s, ts in slots.items() for t in ts}
    total, got = sum(weights.values()), Counter()
    for t in range(total):
        got[order[t]] += 1
        assert all(abs(got[s] - (t + 1) * w / total) < 1 for s, w in weights.items())


def test_mix_keeps_all_rows_and_meets_the_weights(spark):
    rows = [(i, "hot" if i % 3 else f"src{i % 7}", f"t{i}") for i in range(900)] + [(5, "hot", "t5"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, slot string")
    weights = {"hot": 2, "src0": 1, "src3": 1}
    got = mixing.mix(docs, weights, block_rows=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    blocks = defaultdict(set)
    for r in got:
        blocks[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    n = {s: -(-sum(r[1] == s for r in rows) // 4) for s in weights}
    assert [next(iter(blocks[i]))[0] for i in range(sum(n.values()))] == simulated(n, weights)
    assert mixing.mix(docs.limit(0), block_rows=4).count() == 0
    kept = mixing.in_mixed_order(docs, weights=weights, block_rows=4)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    where = {(r.doc_id, r.source): (r.slot, r.place) for r in got}
    at = [where[r.doc_id, r.source] for r in kept.collect()]
    assert sorted(at) == at or Counter(at) == Counter(sorted(at))


def test_too_many_sources_are_refused(spark):
    docs = spark.range(mixing.MOST_SOURCES + 1).selectExpr("id as doc_id", "cast(id as string) as source")
    with pytest.raises(ValueError):
        mixing.mix(docs)
