import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixwright.llm import simhash


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 40, 150, 300]))))
    return out


def roots(fps, radius):
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    up = list(range(len(a)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            up[y] = x
    return [find(i) for i in range(len(a))]


def test_hashes_are_those_of_the_engine(spark):
    s = ["a", "ab cd ef", "é ü 漢字", "x" * 500, ""]
    want = [r[0] % 2**64 for r in spark.createDataFrame([(x,) for x in s], "s string").select(F.xxhash64("s")).collect()]
    assert simhash.hashes([x.encode() for x in s]).tolist() == want


def test_fingerprint_by_hand():
    parts = simhash.shingles("A b\tC  d", 3)
    assert parts == [b"a b c", b"b c d"] and simhash.shingles("One Two", 3) == [b"one two"] and simhash.shingles(" \n", 3) == []
    h = simhash.hashes(parts).tolist()
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(simhash.hashes(parts)) % 2**64 == want and simhash.fingerprint(simhash.hashes([])) == 0


@pytest.mark.parametrize("radius,chunk", [(0, 4), (3, 3), (7, 64), (14, 1000)])
def test_forest_joins_what_is_linked(radius, chunk):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fp = np.unique(np.array([b ^ np.uint64(sum(1 << k for k in set(rng.integers(0, 64, rng.integers(0, 9)).tolist()))) for b in np.repeat(base, 40)]))
    half = len(fp) // 2
    for group, side in ((np.zeros(len(fp), int), np.zeros(len(fp), int)), (np.zeros(len(fp), int), (np.arange(len(fp)) >= half).astype(int))):
        u, v = simhash.forest(group, side, fp, radius)
        assert all(int(a ^ b).bit_count() <= radius for a, b in zip(u, v))
        links = [
            (i, j) for i in range(len(fp)) for j in range(i + 1, len(fp))
            if int(fp[i] ^ fp[j]).bit_count() <= radius and (not side.any() or side[i] != side[j])
        ]
        assert parts(len(fp), links) == parts(len(fp), [(int(np.searchsorted(fp, a)), int(np.searchsorted(fp, b))) for a, b in zip(u, v)])
        assert len(u) < len(fp)


def parts(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(i) for i in range(n)]


def test_components_against_brute_force(spark):
    t = [*texts(), "", None, " ", "same", "same"]
    docs = spark.createDataFrame([(1000 - i, x, "e") for i, x in enumerate(t)], "doc_id bigint, text string, fp string").repartition(5)
    got = {r.id: (r.fp, r["first"]) for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(got)
    fps = [simhash.fingerprint(simhash.hashes(simhash.shingles(t[1000 - i], 3))) for i in ids]
    assert [got[i][0] for i in ids] == fps
    assert [got[i][1] for i in ids] == [ids[r] for r in roots(fps, 3)]


def test_small_tiles_lose_no_link(spark):
    rng = np.random.default_rng(1)
    fps = sorted({12345 ^ sum(1 << b for b in set(rng.integers(0, 62, rng.integers(0, 5)).tolist())) for _ in range(150)})
    rows = spark.createDataFrame([(7, f) for f in fps], "key bigint, fp bigint")
    edges = simhash.compared(simhash.tiles(rows, chunk=16), 3)
    index = {f: i for i, f in enumerate(fps)}
    found = [(index[r.u], index[r.v]) for r in edges.collect()]
    assert parts(len(fps), found) == roots(fps, 3)
    assert simhash.tiles(rows, chunk=16).groupBy("key", "a", "b").count().agg(F.max("count")).first()[0] < 80


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    found = simhash.components(spark.createDataFrame(chain + star + [(5, 5)], "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in found} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert simhash.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_of_each_by_similarity(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.sample(words, 120) for _ in range(12)]
    rows, n = [], 0
    for w in base:
        for k in (0, 0, 1, 2, 40):  # an exact copy, near copies, and a text that shares too little
            v = list(w)
            for at in rng.sample(range(len(v)), k):
                v[at] = rng.choice(words)
            rows.append((n, " ".join(v)))
            n += 1
    rows += [(0, rows[0][1]), (None, "all alone here"), (None, "all alone here"), (n, None), (n + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.one_of_each(docs, words=5, radius=18, keys=simhash.MINIMA, similarity=0.8)
    assert kept.columns == docs.columns
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows if i is not None and i < n}
    links = [
        (i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    want = {i for i, r in enumerate(parts(n, links)) if i == r}
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert [i for i in got if i is not None and i < n] == sorted(want, key=str)
    assert got.count(None) == 1 and len([i for i in got if i in (n, n + 1)]) == 1


def test_family_just_below_the_similarity_hides_no_pair(spark):
    say = lambda name, n: [f"{name}{i}" for i in range(n)]
    core = say("c", 784)
    rows = [(i, " ".join(core + say(f"p{min(i, 399 - i) if 150 <= i < 250 else i}_", 18) + say(f"t{i}_", 92))) for i in range(400)]
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.775 < share(0, 1) == share(150, 151) < 0.785 and all(0.805 < share(i, 399 - i) < 0.815 for i in range(150, 200))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.one_of_each(docs, words=5, radius=22, keys=simhash.MINIMA, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(200), *range(250, 400)]


def test_proven_links_against_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(30, rng.integers(0, 25))) for _ in range(60)]
    root = np.r_[np.zeros(5, dtype=np.int64), np.arange(5, 60)]
    size = np.array([len(x) for x in sets])
    left, right = np.triu_indices(60, 1)
    batches = [(left[i::3], right[i::3], rng.integers(0, 5, len(left[i::3]))) for i in range(3)]
    u, v = simhash.proven(iter(batches), root, np.cumsum(size) - size, size, np.concatenate(sets), 0.6)
    links = [(i, j) for i, j in zip(left, right) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))]
    same = [(0, i) for i in range(5)]
    assert parts(60, same + links) == parts(60, same + list(zip(u, v))) and set(zip(u, v)) <= set(links)


def test_repeated_lines_do_not_hide_a_near_copy(spark):
    rng = random.Random(8)
    rows, far = [], 0
    for i in range(40):
        say = lambda n: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(6)) for _ in range(n))
        text, line = say(400), say(10)
        pair = [f"{text}\n{line}", text + f"\n{line}" * 40]
        sets = [set(simhash.shingles(t, 5)) for t in pair]
        assert len(sets[0] & sets[1]) >= 0.95 * len(sets[0] | sets[1])
        a, b = (simhash.fingerprint(simhash.hashes(simhash.shingles(t, 5))) % 2**64 for t in pair)
        far += (a ^ b).bit_count() > 22
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    assert far > 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.one_of_each(docs, words=5, radius=22, keys=simhash.MINIMA, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_recall_about_the_similarity(spark):
    rng = random.Random(21)
    rows, alike, below = [], [], []
    for i in range(150):
        words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(6)) for _ in range(rng.choice([60, 200, 600]))]
        other = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.018, 0.032)))):
            other[rng.randrange(len(other))] = "changed" + str(rng.random())
        a, b = (set(simhash.shingles(" ".join(w), 5)) for w in (words, other))
        (alike if len(a & b) >= 0.8 * len(a | b) else below).append(2 * i)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert len(alike) > 40 and len(below) > 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs, words=5, radius=22, keys=simhash.MINIMA, similarity=0.8)
    first = {r.id: r.first for r in found.select("id", "first").collect()}
    assert sum(first[i + 1] == i for i in alike) >= 0.9 * len(alike)
    assert all(first[i + 1] == i + 1 for i in below)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def test_forest_by_sketches():
    words = [f"x{i}" for i in range(400)]
    texts = [words[:200], words[:190] + words[200:210], words[100:300], words[200:]]
    h = [simhash.hashes(simhash.shingles(" ".join(t), 5)) for t in texts]
    sets = [set(x.tolist()) for x in h]
    sketches = np.stack([np.frombuffer(simhash.sketch(x), np.uint32) for x in h])
    pairs = [(i, j) for i in range(4) for j in range(i)]
    got = simhash.estimated(sketches[[i for i, _ in pairs]], sketches[[j for _, j in pairs]])
    for (i, j), e in zip(pairs, got, strict=True):
        assert abs(e - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 0.15
    short = np.stack([np.frombuffer(simhash.sketch(simhash.hashes(simhash.shingles(t, 1))), np.uint32) for t in ("a b c d", "a b c e", "")])
    assert simhash.estimated(short[[0, 0, 2]], short[[1, 0, 2]]).tolist() == [0.6, 1.0, 0.0]
    fp = np.array([simhash.fingerprint(x) for x in h], dtype=np.int64).view(np.uint64)
    none = np.zeros(4, dtype=int)
    u, v = simhash.forest(none, none, fp, 64 // 2, 2, sketches, 0.8)
    assert {(int(a), int(b)) for a, b in zip(u, v, strict=True)} == {(int(fp[0]), int(fp[1]))}
    for radius, least in ((0, 0.8), (32, 1.1)):  # nothing within the radius, nothing alike enough
        u, v = simhash.forest(none, none, fp, radius, 2, sketches, least)
        assert len(u) == len(v) == 0


@pytest.mark.parametrize("options", [{}, {"words": 3, "radius": 22, "keys": simhash.MINIMA}])
def test_a_key_for_each_choice_of_bands_is_not_broadcast(spark, monkeypatch, options):
    """The candidates are ten times the fingerprints: too many for a limit that the fingerprints alone would meet."""
    docs = spark.createDataFrame([(i, f"word{i} of{i * 7} text{i * 11}") for i in range(4000)], "doc_id long, text string")
    plans = []
    real = simhash.tiles

    def kept(candidates, *args):
        plans.append(real(candidates, *args))
        return plans[-1]

    monkeypatch.setattr(simhash, "tiles", kept)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)
    try:
        assert simhash.near_duplicates(docs, **options).count() == 4000
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
