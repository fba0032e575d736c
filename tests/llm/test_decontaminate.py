import random

import pytest

from fixwright.llm import decontaminate as D

ITEM = "A train leaves the old station with 120 passengers on board. After that Maria counts 35 km of track before the train meets Peter again"


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, extra string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(d, i, **options).collect()}


def test_exact_changed_and_clean(spark):
    changed = ITEM.replace("120", "9.5").replace("35", "7,000").replace("Maria", "Olga").replace("Peter", "Ahmed")
    docs = [
        (1, "Some words before. " + ITEM + " and some after", "x"),
        (2, ITEM.upper(), "x"),
        (3, "before " + changed, "x"),
        (4, "A train leaves the old station with 120 passengers on board and that is all there is", "x"),
        (5, "Nothing like it at all, only words about the weather in the north of the country", "x"),
        (6, None, None), (7, "", ""), (None, ITEM, "x"), (1, ITEM, "again"),
        (8, "word " * 50_000 + ITEM, "x"),
    ]
    got = found(spark, docs, [(10, ITEM, "e"), (11, None, "e"), (12, "", "e")])
    assert {k for k in got} == {(1, 10), (2, 10), (3, 10), (None, 10), (8, 10)}
    assert got[3, 10].changed and not got[1, 10].changed and got[3, 10].similarity >= 0.8


def test_slots_must_be_consistent(spark):
    item = "then Maria gives Peter a coin and then Maria takes a coin from Peter until Maria has no coin"
    fair = item.replace("Maria", "Olga").replace("Peter", "Ahmed")
    mixed = "then Olga gives Ahmed a coin and then Ivan takes a coin from Bruno until Carla has no coin"
    got = found(spark, [(1, "x " + fair, ""), (2, "x " + mixed, "")], [(1, item, "")])
    assert (1, 1) in got and (2, 1) not in got


def test_names_that_begin_sentences(spark):
    tom = "Tom has 5 apples. Tom buys 3 apples. How many apples does Tom have?"
    anna = "Anna reads 12 pages a day. Ben reads 20 pages a day. How many more pages than Anna does Ben read in 6 days?"
    sam = tom.replace("Tom", "Sam").replace("3", "7")
    docs = [
        (1, sam, ""), (2, "Read this first: " + sam + " Then go on.", ""), (3, "so " + sam, ""),
        (4, anna.replace("Anna", "Olga").replace("Ben", "Ahmed").replace("12", "7"), ""),
        (5, "Sam has 5 apples. Ivan buys 3 apples. How many apples does Bruno have?", ""),
        (6, "What many apples does Sam have?", ""),
    ]
    got = found(spark, docs, [(1, tom, ""), (2, anna, "")])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert all(r.changed and r.n_matched == r.n_windows for r in got.values())


def test_short_items_are_matched_whole(spark):
    got = found(spark, [(1, "we like red apples a lot", ""), (2, "we like green apples", "")], [(5, "red apples", "")])
    assert set(got) == {(1, 5)}


def test_empty_tables(spark):
    assert not found(spark, [], [(1, ITEM, "")]) and not found(spark, [(1, ITEM, "")], [])


def brute(docs, items, words=5):
    """Pairs of a document and an item whose windows of plain lowered words it has, for texts without slots."""
    split = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    runs = lambda w: [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
    out = set()
    for d, t in docs:
        have = set(runs(split(t)))
        for i, x in items:
            need = runs(split(x))
            if need and sum(r in have for r in need) >= 0.8 * len(need):
                out.add((d, i))
    return out


@pytest.mark.parametrize("bits", [24, 6])
def test_against_brute_force(spark, bits):
    rng = random.Random(4)
    words = "lo mi ka ru te so na vi du pe".split()
    say = lambda n: " ".join("".join(rng.choice(words) for _ in range(2)) for _ in range(n))
    items = [(i, say(rng.randint(6, 25))) for i in range(12)]
    docs = []
    for d in range(80):
        t = say(rng.randint(0, 40)).split()
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            cut = rng.randint(0, len(part) // 3)
            at = rng.randint(0, len(t))
            t[at:at] = part[cut:]
        docs.append((d, " ".join(t)))
    got = found(spark, [(d, t, "") for d, t in docs], [(i, x, "") for i, x in items], bits=bits)
    assert set(got) == brute(docs, items)


def test_filter_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (2, "clean words here"), (None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def aligned(doc, item, words=5, least=0.8):
    """(similarity, changed) of an item found in a document, by trying every place of it at every place, or None."""
    from collections import Counter, defaultdict

    d, t = D.canonical([doc]), D.canonical([item])
    size = min(words, len(t.kind))
    slot = lambda x, i, r: x.kind[i] and (x.kind[i] < D.NAME or r > x.kind[i] - D.NAME + 1)
    figures = lambda x, i: all(x.kind[k] in (D.NUMBER, D.UNIT) for k in range(i, i + size))
    places = range(len(t.kind) - size + 1)
    telling = [i for i in places if not figures(t, i)]
    judged = telling if len(telling) >= D.TELLING else list(places)

    def reads(x, i, r):
        """What a window says in a reading, or None where it has no say."""
        of = (x.first, x.second, x.third)[r - 1]
        if r == 1:
            return ("bare", tuple(x.plain[i : i + size])) if figures(x, i) else (1, tuple(of[i : i + size]))
        if not any(x.kind[k] == (D.NAME, D.OPENER)[r - 2] for k in range(i, i + size)) or all(slot(x, k, r) for k in range(i, i + size)):
            return None
        return "named", tuple(of[i : i + size])

    ours = defaultdict(list)
    for j in range(len(d.kind) - size + 1):
        for r in (1, 2, 3):
            if reads(d, j, r):
                ours[reads(d, j, r)].append((j, r))
    hits = []
    for i in judged:
        for r in (1, 2, 3):
            for j, q in ours.get(reads(t, i, r), []):
                a = [(min(t.kind[k], D.NAME), t.spelt(k)) for k in range(i, i + size) if slot(t, k, r)]
                b = [d.spelt(j + k - i) for k in range(i, i + size) if slot(d, j + k - i, q)]
                hits.append((j - i, i, list(zip(a, b))))

    def agree(of):
        votes = defaultdict(Counter)
        for _, _, pairs in of:
            for a, b in pairs:
                votes[a][b] += 1
        stands = {a: max(v, key=lambda b: (v[b], b == a[1], b)) for a, v in votes.items()}
        bad = {(o, i) for o, i, pairs in of if any(stands[a] != b for a, b in pairs)}
        left = [(o, i, any(a[1] != b for a, b in pairs)) for o, i, pairs in of if (o, i) not in bad]
        return (len({i for _, i, _ in left}), not any(x for _, _, x in left)), {(o, i) for o, i, _ in left}

    by = defaultdict(list)
    for h in hits:
        by[h[0]].append(h)
    scores = {o: agree(of) for o, of in by.items()}
    choice = {}
    for o, ((n, same), left) in scores.items():
        for _, i in left:
            choice[i] = max(choice.get(i, (0, False, 0)), (n, same, -o))
    joint = agree([h for h in hits if h[1] in choice and choice[h[1]][2] == -h[0] and (h[0], h[1]) in scores[h[0]][1]])[0]
    n, same = max([s for s, _ in scores.values()] + [joint], default=(0, True))
    return (n / len(judged), not same) if n and n >= least * len(judged) else None


PENS = "Ann has 5 red, 3 blue, 9 green and 4 gold pens. Bob has 6 red, 2 blue, 7 green and 8 gold pens. How many pens?"
RUN = " ".join(map(str, range(1, 21)))
NEXT = "What number comes next in the sequence 2 4 8 16 32 64 128 256 ?"


def test_parallel_clauses_and_runs_of_numbers(spark):
    other = PENS.replace("5", "11").replace("3", "12").replace("Bob", "Ivan")
    nine = NEXT.replace("2 4 8 16 32 64 128 256", "3 9 27 81 243 729 2187 6561")
    docs = [
        (1, PENS, ""), (2, PENS + " " + other, ""), (3, "So: " + other + " " + PENS + " The end.", ""), (4, other, ""),
        (5, RUN, ""), (6, "9 9 9 " + RUN + " 5 5 and more 1 2 3", ""), (7, NEXT, ""), (8, "first " + nine + " then " + NEXT, ""), (9, nine, ""),
        (10, " ".join(map(str, range(100, 2100))), ""), (11, "Bob has 5 red, 3 blue, 9 green and 4 gold pens. " * 3, ""),
        (12, PENS.replace(". Bob", ". Well then, as I was saying to you all the other day, Bob"), ""), (13, "0 " * 500, ""),
    ]
    items = [(1, PENS, ""), (2, RUN, ""), (3, NEXT, "")]
    got = found(spark, docs, items)
    for d, i in ((1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (7, 3), (8, 3)):
        assert (got[d, i].similarity, got[d, i].changed) == (1.0, False), (d, i)
    assert got[4, 1].changed and got[4, 1].similarity == 1.0 and got[9, 3].changed
    assert {k for k in got if k[0] in (10, 13)} == set() and not got[12, 1].changed
    want = {(d, i): aligned(t, x) for d, t, _ in docs for i, x, _ in items}
    assert {k: (r.similarity, r.changed) for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items() if v}


def test_figures_alone_are_joined_by_their_values(spark):
    page = " ".join(str(7 * i % 1009) for i in range(5000))
    docs = spark.createDataFrame([(1, page)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(str(i * 31 + k * k) for k in range(20))) for i in range(50)], "item_id bigint, text string")
    theirs = D.item_windows(items, 5)
    ours = D.matched_windows(docs, "doc_id", "text", [5], D.bitmap(theirs, 24), 24)
    assert ours.count() < 100  # some may pass the bitmap; one by one they were 50 * 16 * 4996 pairs
    assert ours.join(theirs, "key").count() == 0


def test_slots_against_every_alignment(spark):
    rng = random.Random(11)
    names, units, plain = ["Ann", "Bob", "Olga", "Peter"], ["km", "hours"], "has gives and takes red blue coins from over then finds the rest of".split()

    def clause(ends):
        words = []
        for _ in range(rng.randint(4, 9)):
            words.append(rng.choice([rng.choice(names), str(rng.randint(1, 6)), rng.choice(plain), rng.choice(plain), f"{rng.randint(1, 9)} {rng.choice(units)}"]))
        return " ".join(words) + rng.choice(ends)

    items = [(i, " ".join(clause([".", ",", ""]) for _ in range(rng.randint(1, 4)))) for i in range(25)]
    items += [(25, "Ann has 5 red, 3 blue, 9 red, 4 blue, 5 red, 2 blue and 7 red coins."), (26, "1 2 3 1 2 3 1 2 3"), (27, "five km"), (28, "coins")]
    docs = []
    for d in range(120):
        parts = [clause([".", "", "!"]) for _ in range(rng.randint(0, 2))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1]
            if rng.random() < 0.6:
                for a, b in zip(names + list("123456"), rng.sample(["Ivan", "Carla", "Bruno", "Zoe"], 4) + [str(rng.randint(10, 99)) for _ in range(6)]):
                    if rng.random() < 0.7:
                        text = " ".join(w.replace(a, b) if w.strip(".,") == a else w for w in text.split())
            if rng.random() < 0.3:
                words = text.split()
                words.insert(rng.randint(0, len(words)), "indeed")
                text = " ".join(words)
            parts.insert(rng.randint(0, len(parts)), text)
        docs.append((d, " ".join(parts)))
    got = found(spark, [(d, t, "") for d, t in docs], [(i, x, "") for i, x in items])
    want = {(d, i): aligned(t, x) for d, t in docs for i, x in items}
    assert {k: (r.similarity, r.changed) for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items() if v}
    assert sum(r.changed for r in got.values()) > 10 and sum(not r.changed for r in got.values()) > 10
