import random
import zlib

import pytest

from fixwright.llm import toxicity as X


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_edit_distance(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(30)})
    find = X.WordAutomaton(words)
    for _ in range(600):
        t = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "c", "d", ""])
        t = "".join(t)
        near = [(edits(t, w), i) for i, w in enumerate(words) if edits(t, w) <= X.allowed(w)]
        assert find(t) == ((min(near)[1], min(near)[0]) if near else None)


def test_automaton_survives_forgetting(monkeypatch):
    monkeypatch.setattr(X, "MOST_STATES", 3)
    find = X.WordAutomaton(["worthless", "stupid"])
    assert [find(w) for w in ("worthles", "stupid", "stupyd", "w0rthl3ss", "other", "w0rthl3sz")] == [(0, 1), (1, 0), (1, 1), (0, 2), None, None]


def test_spelling():
    assert X.spelt('"IDIOOOOT!!"') == "idioot" and X.spelt("...") == "" and X.spelt("") == ""


LEXICON = X.Lexicon(("idiot", "worthless"), (4.0, 5.0), (3.0, 4.0), (4.0, 5.0), ("vexo",), (2.0,), (1.0,))


def test_context_tells_quotation_from_abuse():
    m = X.Matcher(LEXICON)
    abuse, _, _, quote = X.features("you are an idiot and a vexolan", m)
    assert abuse > 0 and quote == 0
    for t in ('they cried "you utter idiot" and left', "the word idiot is old", "«worthless» it read", "she called him idiot once"):
        abuse, _, _, quote = X.features(t, m)
        assert abuse == 0 and quote > 0, t
    assert X.features('"never mind" he went on and on and on and on and on, idiot', m)[0] > 0
    assert X.features("an idi0t or a worhtless man", m)[0] > 0
    assert X.features(None, m) == X.features("", m) == X.features("nice words", m) == (0.0, 0.0, 0.0, 0.0)


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                t = rng.choice(["idiotus", "scumbagger", "vermiculo"])
                if rng.random() < 0.2:
                    t = t[:3] + "0" + t[4:]
                w.insert(rng.randrange(len(w)), t)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), i % 2))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "words")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (900, None, 0), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    model = X.learn(docs, marks)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(i, t) for i, t, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[i].predicted == t for i, t in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == got[None].predicted == 0


def test_labels_of_held_out_texts_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    models = [X.learn(docs, spark.createDataFrame(x, "doc_id bigint, toxic int, quality int")) for x in (labels, flip)]
    assert models[0].lexicon == models[1].lexicon and models[0].coefficients == pytest.approx(models[1].coefficients)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id bigint, text string, Score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    model = X.learn(docs, none)
    out = X.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and 0 <= out.first().score <= 1
    assert X.score(docs.limit(0), model).count() == 0
