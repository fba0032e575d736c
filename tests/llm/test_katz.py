import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fixwright.llm import katz as K


def texts(n=160):
    rng = np.random.default_rng(2)
    return [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 30)) % 400) for _ in range(n)]


def reference(train, vocabulary):
    """The model written out over dictionaries: a function of a history and a word, and all its words."""
    c = Counter(w for t in train for w in K.tokens(t))
    words = K.words_of(dict(Counter(c.values())))
    own = lambda w: float(words.probability(np.array([c.get(w, 0)]))[0])
    kept_words = {w for _, w in sorted((-n, w) for w, n in c.items())[:vocabulary]}
    group = lambda w: w if w in kept_words else None
    pairs = Counter()
    for t in train:
        g = ["start", *map(group, K.tokens(t))]
        pairs.update(zip(g, g[1:], strict=False))
    kept = K.discounts(dict(Counter(pairs.values())))
    low = {w: own(w) for w in kept_words}
    low[None] = max(1 - sum(low.values()), words.unseen)
    after = defaultdict(dict)
    for (h, w), n in pairs.items():
        after[h][w] = n

    def of(h, w):
        h, g = (h if h == "start" else group(h)), group(w)
        seen = after.get(h, {})
        if not seen:
            p = low[g]
        else:
            total = sum(seen.values())
            share = {x: n * (kept[n] if n <= K.LOW else 1) / total for x, n in seen.items()}
            if 1 - sum(share.values()) < 1e-9:
                share = {x: p * total / (total + 1) for x, p in share.items()}
            rest = 1 - sum(low[x] for x in seen)
            if rest < 1e-9:
                share = {x: p / sum(share.values()) for x, p in share.items()}
            p = share[g] if g in share else (1 - sum(share.values())) / rest * low[g]
        return p if g is not None else p * own(w) / low[None]

    return c, of


@pytest.mark.parametrize("vocabulary,hot_words,hot_pairs", [(40, 60, 50), (10_000, 10_000, 100_000), (5, 5, 0)])
def test_against_the_model_written_out(spark, vocabulary, hot_words, hot_pairs):
    t = [*texts(), "unseen only here", "", None]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "doc_id bigint, text string, score int").repartition(3)
    out = {r.doc_id: r for r in K.evaluate(docs, vocabulary=vocabulary, hot_words=hot_words, hot_pairs=hot_pairs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(t))}
    train = [x for i, x in enumerate(t) if not held[i]]
    by_count = Counter(Counter(w for x in train for w in K.tokens(x)).values())
    frequent = sum(n for c, n in by_count.items() if c >= K._least_count(dict(by_count), hot_words))
    c, of = reference(train, min(vocabulary, frequent))
    total, types = sum(c.values()), len(c)
    for i, x in enumerate(t):
        w = K.tokens(x)
        base = sum(math.log10((c.get(v, 0) + 0.1) / (total + 0.1 * (types + 1))) for v in w)
        score = sum(math.log10(of(h, v)) for h, v in zip(["start", *w], w, strict=False))
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(v in c for v in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    for h in ["start", *list(c)[:20], b"never seen"]:
        assert sum(of(h, w) for w in c) + of(h, b"no such word") == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("hot_words,hot_pairs", [(60, 50), (5, 0), (1, 3), (10_000, 100_000)])
def test_pairs_of_rare_words_are_told_apart(spark, hot_words, hot_pairs):
    t = [*texts(), "unseen only here", "W397 W398 W397 W398", "", None]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string").repartition(3)
    out = {r.doc_id: r for r in K.evaluate(docs, hot_words=hot_words, hot_pairs=hot_pairs).collect()}
    c, of = reference([x for i, x in enumerate(t) if not out[i].held_out], 10**9)
    for i, x in enumerate(t):
        w = K.tokens(x)
        score = sum(math.log10(of(h, v)) for h, v in zip(["start", *w], w, strict=False))
        assert out[i].n_known == sum(v in c for v in w) and out[i].score == pytest.approx(score, rel=1e-9)


def test_discounts_stay_between_zero_and_one():
    for n in ({}, {1: 3}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}, {1: 5, 2: 50, 3: 1, 4: 1, 5: 1, 6: 90}, {7: 3}):
        d = K.discounts(n)
        assert d[0] == 1 and all(0 < x < 1 for x in d[1:])


def test_word_mass_adds_up():
    for n in ({1: 10, 2: 3, 9: 2}, {50: 2}, {1: 1}):
        w = K.words_of(n)
        mass = sum(k * float(w.probability(np.array([c]))[0]) for c, k in n.items())
        assert w.unseen > 0 and mass + w.unseen == pytest.approx(1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert K.evaluate(none).count() == 0
    model = K.fit(none.select("text"))
    got = K.score(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id string, text string"), model).collect()
    assert len(got) == 2 and all(r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.doc_id is None for r in got)


def test_learned_texts_look_up_only_pairs_seen_more_than_once(spark):
    t = [f"a{i} b{i} c{i} d{i}" for i in range(200)] + ["x y z"] * 3
    docs = spark.createDataFrame(list(enumerate(t)), "id bigint, text string").repartition(2)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    model = K.fit(docs, hot_pairs=2, asked=docs.where("false"))
    assert spark.conf.get(name, None) == before
    rows = docs.selectExpr("id as rid", "text", "id", "true as learned")
    kinds = Counter(r.kind for r in K._read_texts(rows, model).collect())
    assert kinds[K._TEXT] == len(t) and kinds[K._LEARNED] <= 3 * 4 and kinds[K._NEW] == 0
    assert model.found.where(f"w <> {K._START} and c = 1").isEmpty()


@pytest.mark.parametrize("options", [{"hot_words": 60, "hot_pairs": 20}, {"vocabulary": 40, "hot_words": 60, "hot_pairs": 20}])
def test_marking_learned_texts_changes_no_score(spark, options):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").repartition(3)
    marked = {r.doc_id: r for r in K.evaluate(docs, **options).collect()}
    plain = K.score(docs, K.fit(docs.where(~K.held_out(K.F.col("doc_id"), K.HELD_OUT)).select("text"), **options)).collect()
    assert len(plain) == len(marked)
    for r in plain:
        m = marked[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (m.n_tokens, m.n_known, m.train_tokens)
        assert r.base_score == pytest.approx(m.base_score, rel=1e-9) and r.score == pytest.approx(m.score, rel=1e-9)


def test_pairs_reach_the_shuffle_in_parts_and_are_counted_exactly(spark):
    t = texts()
    rows = spark.createDataFrame([(x, i % 3 > 0) for i, x in enumerate(t)], "text string, learned boolean").repartition(2)
    frequent = [w for w, _ in Counter(w for x in t for w in K.tokens(x)).most_common(30)]
    text = K.Text(frequent)
    seen, asked = Counter(), set()
    for i, x in enumerate(t):
        of, _, target, _ = text.flat([x])
        pairs = list(zip(text.histories(of, target).tolist(), target.tolist(), strict=True))
        seen.update(pairs if i % 3 > 0 else [])
        asked.update(pairs if i % 3 == 0 else [])
    for parts in (1, 7, 1000):
        dealt = K._dealt(rows, text, parts).collect()
        assert len(dealt) <= 2 * parts and all(len(r.near) == len(r.near_c) and len(r.h) == len(r.w) == len(r.far_c) for r in dealt)
        got = K._pair_counts(rows, text, parts).collect()
        assert len(got) == len(seen) and {(r.h, r.w): r.c for r in got} == seen
        assert all(r.asked == ((r.h, r.w) in asked) and r.seldom == (r.c == 1 and not r.asked) for r in got)
        assert all(r.rare == (r.h < 0) + 2 * (r.w < 0) and 0 <= r.bucket < K.BUCKETS for r in got)


def test_pairs_that_share_a_number_are_told_apart(spark):
    turn = lambda x: (x << 32 | x >> 32) & (2**64 - 1)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    first = (2**63 + 12345, 2**63 + 99)
    other = (first[0] + 2**40, turn(first[0]) ^ first[1] ^ turn(first[0] + 2**40))
    pairs = [tuple(map(signed, p)) for p in (first, other)] + [(5, 7), (7, 5), (0, 7)]
    got = spark.createDataFrame(pairs, "h bigint, w bigint").select("h", "w", *K._keys()).collect()
    assert got[0].at == got[1].at and len({(r.at, r.told) for r in got}) == len(got)
    assert [r.at for r in got[2:]] == [h << 32 | w for h, w in pairs[2:]]
