import random
from collections import Counter

import numpy as np
import pytest

from fixwright.llm import quality as Q


def slow_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    often = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if often[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@pytest.mark.parametrize("seed", range(8))
def test_counts(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "a b c", "Ünï", "漢字", " ", "\n", "\t", "\x0b", "\r", " ", "#", "$$", "<x>", "b c\n", "\n\n"]
    for _ in range(200):
        t = "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))
        assert Q.counts(t)[:5] == slow_counts(t), repr(t)
    assert Q.counts(None) == Q.counts("") == (0,) * len(Q.COUNTS)


def table(n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 160))]
        kind = i % 5
        if kind == 0:
            words = [w + rng.choice(["&&&", "***"]) for w in words]
        elif kind == 1 and i % 2:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not (kind == 0 or kind == 1 and i % 2)), 0))
    return rows, labels


def test_learned_list_on_unseen_texts(spark):
    rows, labels = table()
    taught = spark.createDataFrame([*labels[:300], (None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "")], "doc_id bigint, text string")
    got = Q.judge(docs, taught).collect()
    assert len(got) == 603
    by = {r.doc_id: r for r in got}
    assert sum(by[i].kept == bool(q) for i, q, _ in labels[300:]) >= 0.97 * 300
    assert all(by[i].kept for i, q, _ in labels[300:] if q)
    assert by[1000].base_failed and not by[1000].kept and by[1000].rule is None
    kept = Q.passed(docs, taught)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in by.items() if r.kept}


def test_expression_is_the_list(spark):
    rng = np.random.default_rng(1)
    names = list(Q.MEASURES)
    x = rng.random((400, len(names)))
    bad = (x[:, 0] > 0.7) & (x[:, 3] < 0.5) | (x[:, 5] > 0.9)
    rules = Q.learned(x, bad, np.arange(400) % 3 == 0, names)
    assert rules and all(len(r.conditions) <= Q.MOST_CONDITIONS and str(r) for r in rules)
    hit = np.zeros(400, bool)
    for r in rules:
        hit |= Q._holds(x, names, r)
    assert (hit == bad).mean() > 0.9
    texts = [t for _, t in table(50)[0]]
    measured = Q.measured(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    some = [Q.Rule((("symbol_share", ">=", 0.2), ("chars_a_word", "<=", 9.0))), Q.Rule((("upper_share", ">=", 0.5),))]
    got = measured.select(Q.rule_number(some).alias("n"), *[Q.measure(m).alias(m) for m in names]).collect()
    for r in got:
        v = np.array([[r[m] for m in names]])
        assert r.n == next((i for i, rule in enumerate(some, 1) if Q._holds(v, names, rule)[0]), None)


def test_without_labels_only_the_base_rules_speak(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "a b c " * 40), (3, "few")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in Q.judge(docs, none).collect()} == {1: True, 2: False, 3: False}
    assert Q.judge(docs.limit(0), none).count() == 0
