import hashlib
import random

import numpy as np
import pytest

from fixwright.llm import suffixes as S


@pytest.mark.parametrize("seed", range(60))
def test_ranks_against_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    s = rng.integers(1, rng.integers(2, 6), n)
    if seed % 3 == 0 and n:
        s = np.tile(s[: max(1, n // 4)], 5)[:n]
    suffix = [tuple(s[i:]) for i in range(len(s))]
    order = sorted(suffix)
    assert S.suffix_ranks(s, 10**6).tolist() == [order.index(x) for x in suffix]
    for depth in (1, 2, 3, 4, 7, 10):
        r = S.suffix_ranks(s, depth)
        by = sorted(range(len(s)), key=lambda i: r[i])
        assert all(suffix[a][:depth] <= suffix[b][:depth] for a, b in zip(by, by[1:], strict=False))
        assert all(suffix[a][:depth] == suffix[b][:depth] for a in by for b in by if r[a] == r[b])


def brute(rows, length):
    """The result of each row, every window looked up among the ones before it."""
    seen, out = {}, {}
    for key, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i : i + length], (key, i)) != (key, i):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
        out[key, text] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh ", "aé漢 "])
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [say(rng.randint(20, 120)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))], say(rng.randint(0, 30))]
        rows.append((100 - i, "".join(parts)))
    rows += [(200, rows[0][1]), (0, rows[3][1]), (7000, ""), (7001, None), (7002, "x"), (7003, "aaaa" * 80), (None, rows[5][1]), (7004, "ab" * 100)]
    return rows + [rows[10], rows[10]]


@pytest.mark.parametrize("seed,length,span,most", [(1, 30, 12, 20_000), (2, 30, 12, 3), (3, 25, 18, 2), (4, 40, 30, 20_000)])
def test_against_brute_force(spark, seed, length, span, most, monkeypatch):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, uid string").repartition(4)
    got = S.without_repeats(docs, length=length, span=span, most_blocks=most).collect()
    assert len(got) == len(rows)
    want = brute(rows, length)
    by_key = {k: v for (k, _), v in want.items()}
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_key[r.doc_id], r.doc_id
        assert r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_bitmap_of_any_size_gives_the_same(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = (sorted(map(str, S.without_repeats(docs, length=30, span=12, bits=n).drop("kept").collect())) for n in (24, 6))
    assert a == b


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.without_repeats(docs).count() == 0
    with pytest.raises(ValueError):
        S.repeated_spans(docs, length=20, span=15)


def test_blocks_hold_every_window_once():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (300, 5, 100, 99, 0, 450)]
    ends = np.cumsum([len(t) for t in texts])
    text, anchor, lo, hi = S.blocks(b"".join(texts), ends, 100, 51)
    windows = [w for a, b in zip(lo, hi, strict=True) for w in range(a, b + 1)]
    starts = np.r_[0, ends[:-1]]
    assert windows == [s + i for s, t in zip(starts, texts, strict=True) for i in range(len(t) - 99)]
    assert ((anchor >= hi) & (anchor < lo + 51 + hi - lo)).all()
