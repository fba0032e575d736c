"""Toxicity by a learned lexicon, matched with Levenshtein automata and weighed in context.

Labelled texts give the lexicon: whole words, and stems that open many different words,
that toxic texts use far more often than others. The stems form a trie. The words form a
trie that is intersected with the Levenshtein automaton of a token: its states are the
trie nodes that a token's beginning reaches within so many edits, its transitions are
worked out when first needed and kept, so a token is matched by one look-up a letter.
Short words must match exactly, longer ones may have one edit, long ones two.

Each match is looked at in its window of neighbouring tokens: between quotation marks or
beside a word of reporting it is a quotation, elsewhere abuse, and the two are summed up
apart. A logistic model over these sums, fitted on labelled texts that the lexicon has
not seen, gives the score.

Everything is learned from a bounded sample of the labelled rows, the ones whose keys
hash lowest, copies counted once; texts are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import written
from .common import hash60, held_out, lowest_hashes, shadowed
from .simhash import hashes, minima, shingles

SAMPLE = 20_000  # labelled texts, about, to learn from
MOST_ENTRIES = 4_000  # of the lexicon
LEAST_TEXTS, LEAST_GAIN = 3, 24.0  # toxic texts with an entry; its log-likelihood ratio
STEMS = range(4, 11)  # letters of a stem
EDITS = ((8, 2), (5, 1))  # letters of a word, edits it may have
FADE = 0.7  # what an edit leaves of a word's weight
WINDOW = 10  # tokens on either side that are a match's context
MOST_STATES, REMEMBERED = 200_000, 400_000
HELD_OUT = 5

REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term terms phrase reads titled labelled labeled".split())
_OPEN, _CLOSE = "\"“«„‘'(`", "\"”»“’'`"
_TRIM = "\"“”«»„‘’'`().,;:!?*#$%&|<>[]{}…-–—_~"
FEATURES = ("abuse", "peak", "rate", "quotation")


def spelt(token: str) -> str:
    """A token as the lexicon spells it: lowered, outer punctuation cut, runs of a letter at most two."""
    t = token.lower().strip(_TRIM)
    if any(a == b == c for a, b, c in zip(t, t[1:], t[2:], strict=False)):
        out: list[str] = []
        for c in t:
            if out[-2:] != [c, c]:
                out.append(c)
        t = "".join(out)
    return t


def allowed(word: str) -> int:
    return next((k for n, k in EDITS if len(word) >= n), 0)


class WordAutomaton:
    """The trie of words intersected with a token's Levenshtein automaton, made deterministic step by step."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.most = [-1], [0]
        self.limit = [allowed(w) for w in words]
        for i, w in enumerate(words):
            node = 0
            self.most[0] = max(self.most[0], self.limit[i])
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.limit[i])
            self.word[node] = i
        self._forget()

    def _forget(self) -> None:
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.accepts: list[tuple[int, int] | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of some nodes with their edits, after letters that the token lacks; -1 if nothing can match."""
        todo = list(reached)
        for node in todo:  # grows while it is walked
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        key = tuple(sorted(reached.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            ends = [(e, self.word[n]) for n, e in key if self.word[n] >= 0 and e <= self.limit[self.word[n]]]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.most[node]:
                reached[node] = min(e + 1, reached.get(node, 99))  # a letter too many
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.most[child] and cost < reached.get(child, 99):
                    reached[child] = cost
        return self._state(reached)

    def __call__(self, token: str) -> tuple[int, int] | None:
        """The nearest word within its edits, and the edits; the first of equally near words."""
        if len(self.sets) > MOST_STATES:
            self._forget()
        state, steps = self.start, self.steps
        for c in token:
            at = steps.get((state, c))
            if at is None:
                at = steps[state, c] = self._step(state, c)
            if at < 0:
                return None
            state = at
        return self.accepts[state]


@dataclass(frozen=True)
class Lexicon:
    """Words and stems with how much more they are used in toxic texts, and how sure one use makes a text toxic.

    Both are logarithms, of a ratio of rates and of odds; ``near`` is the first for words with an edit.
    """

    words: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    sure: tuple[float, ...] = ()
    near: tuple[float, ...] = ()
    stems: tuple[str, ...] = ()
    stem_weights: tuple[float, ...] = ()
    stem_sure: tuple[float, ...] = ()


class Matcher:
    """Weights of tokens by a lexicon, remembered by their spelling in the text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.exact = {w: i for i, w in enumerate(lexicon.words)}
        self.stems = dict(zip(lexicon.stems, zip(lexicon.stem_weights, lexicon.stem_sure, strict=True), strict=True))
        self.longest = max(map(len, lexicon.stems), default=0)
        self.automaton = WordAutomaton(list(lexicon.words))
        self.known: dict[str, float] = {}
        self.sure: dict[str, float] = {}

    def entry(self, token: str) -> tuple[str, int, int] | None:
        """What a spelt token matches: a word, its number and edits, or a stem."""
        if token in self.exact:
            return "word", self.exact[token], 0
        for n in range(min(self.longest, len(token)), STEMS[0] - 1, -1):
            if token[:n] in self.stems:
                return "stem", n, 0
        found = self.automaton(token)
        return ("word", *found) if found and found[1] else None

    def weight(self, raw: str) -> tuple[float, float]:
        """Weight and sureness of a token; zeros if it matches nothing."""
        token = spelt(raw)
        found = self.entry(token) if token else None
        if found is None:
            return 0.0, 0.0
        kind, i, edits = found
        if kind == "stem":
            return self.stems[token[:i]]
        at = self.lexicon
        return (at.near[i] * FADE**edits, at.sure[i] * FADE**edits * (at.near[i] > 0)) if edits else (at.weights[i], at.sure[i])

    def weights(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.sure.clear()
        for w in set(words):
            if w not in known:
                known[w], sure = self.weight(w)
                if known[w]:
                    self.sure[w] = sure
        return np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))


def quoted(words: list[str], at: int) -> bool:
    """Whether a match stands between quotation marks within its window, or beside a word of reporting."""
    lo, hi = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
    if any(w.lower().strip(_TRIM) in REPORTING for w in words[max(lo, at - 3) : at] + words[at + 1 : at + 3]):
        return True
    here = words[at]
    opened = here[0] in _OPEN
    for w in reversed(words[lo:at]):
        if opened or w[-1] in _CLOSE or w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE):
            break
        opened = w[0] in _OPEN
    if not opened:
        return False
    return any(w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in words[at:hi])


def features(text: str | None, matcher: Matcher) -> tuple[float, ...]:
    """Sums over a text's matches, as logarithms of one more; all zero without a match."""
    words = (text or "").split()
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    found = matcher.weights(words)
    hits = np.flatnonzero(found)
    if not len(hits):
        return 0.0, 0.0, 0.0, 0.0
    apart = np.array([quoted(words, int(i)) for i in hits])
    abuse, other = found[hits[~apart]], found[hits[apart]]
    total, peak = float(abuse.sum()), max((matcher.sure[words[i]] for i in hits[~apart]), default=0.0)
    return math.log1p(total), peak, math.log1p(100 * total / len(words)), math.log1p(float(other.sum()))


# Learning -----------------------------------------------------------------------------


def _entry_counts(rows: DataFrame) -> DataFrame:
    """Rows (entry, uses and texts by class): words as w:..., stems as s:...; each batch is counted before it is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uses = (Counter(), Counter())
            texts = (Counter(), Counter())
            tokens = [0, 0]
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for w, n in Counter((text or "").split()).items():
                    t = spelt(w)
                    if len(t) > 1:
                        own["w:" + t] += n
                        for k in STEMS:
                            if len(t) > k:
                                own["s:" + t[:k]] += n
                    tokens[toxic] += n
                uses[toxic].update(own)
                texts[toxic].update(own.keys())
            names = [*(uses[0].keys() | uses[1].keys()), ""]
            for side in (0, 1):
                uses[side][""] = tokens[side]
                texts[side][""] = sum(x == side for x in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *(pa.array([c[n] for n in names], pa.int64()) for c in (*uses, *texts))],
                ["entry", "clean_uses", "toxic_uses", "clean_texts", "toxic_texts"],
            )

    counted = rows.select("text", "toxic").mapInArrow(
        read, "entry string, clean_uses bigint, toxic_uses bigint, clean_texts bigint, toxic_texts bigint"
    )
    return counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])


def _gain(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of an entry in ``a`` of ``n1`` toxic and ``b`` of ``n0`` other texts."""
    share = (a + b) / (n1 + n0)
    term = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p) if 0 < p < 1 else 0.0
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, share) - term(b, n0, share))


def _once(rows: DataFrame) -> DataFrame:
    """Labelled ``rows`` (text, toxic, h) without copies and near copies, which would make their words look sure.

    Two texts are taken for copies if they share a smallest hash of their five-word shingles.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [minima(hashes(shingles(t.as_py(), 5)), 2, 1) or [0, 0] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], [*b.schema.names, "m", "n"])

    kept = rows.mapInArrow(read, "text string, toxic int, h bigint, m bigint, n bigint")
    for c in ("m", "n"):
        kept = kept.groupBy(c).agg(F.min_by(F.struct(*kept.columns), F.struct("h", "text")).alias("row")).select("row.*")
    return kept.select("text", "toxic", "h")


def lexicon_of(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled ``rows`` (text, toxic), at most ``MOST_ENTRIES`` entries."""
    counted = written(_entry_counts(rows), "entry-counts")
    whole = counted.where("entry = ''").first()
    if whole is None or not whole["toxic_texts"] or not whole["clean_texts"]:
        return Lexicon()
    n1, n0, t1, t0 = (float(whole[c]) for c in ("toxic_texts", "clean_texts", "toxic_uses", "clean_uses"))
    a, b = F.col("toxic_texts"), F.col("clean_texts")
    likely = counted.where((F.col("entry") != "") & (a >= LEAST_TEXTS) & (a * n0 > 2 * b * n1))
    top = likely.orderBy((a * a / (a + b)).desc(), "entry").limit(4 * MOST_ENTRIES).collect()
    scored = sorted(
        ((-_gain(r["toxic_texts"], r["clean_texts"], n1, n0), r["entry"], r) for r in top if _gain(r["toxic_texts"], r["clean_texts"], n1, n0) >= LEAST_GAIN),
        key=lambda x: x[:2],
    )[:MOST_ENTRIES]
    weight = lambda r: min(6.0, math.log(((r["toxic_uses"] + 0.5) / (t1 + 1)) / ((r["clean_uses"] + 0.5) / (t0 + 1))))
    sure = lambda r: max(0.0, math.log((r["toxic_texts"] + 0.5) / (r["clean_texts"] + 0.5)))
    words = {e[2:]: r for _, e, r in scored if e[0] == "w" and weight(r) > 0}
    stems = {}
    for _, e, r in sorted(scored, key=lambda x: len(x[1])):
        # a stem must open more than one word, and of stems in the same texts the longest says all
        if e[0] == "s" and weight(r) > 0 and not any(w.startswith(e[2:]) and x["toxic_texts"] > 0.6 * r["toxic_texts"] for w, x in words.items()):
            stems = {s: x for s, x in stems.items() if not (e[2:].startswith(s) and (x["toxic_texts"], x["clean_texts"]) == (r["toxic_texts"], r["clean_texts"]))}
            stems[e[2:]] = r
    w, s = sorted(words), sorted(stems)
    weights = tuple(weight(words[x]) for x in w)
    return Lexicon(
        tuple(w), weights, tuple(sure(words[x]) for x in w), weights,
        tuple(s), tuple(weight(stems[x]) for x in s), tuple(sure(stems[x]) for x in s),
    )


def _near_hits(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (word, toxic, n): how often tokens with an edit match each word, by class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            seen: Counter = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter((text or "").split()).items():
                    found = matcher.entry(spelt(w))
                    if found and found[0] == "word" and found[2]:
                        seen[found[1], toxic] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["word", "toxic", "n"],
            )

    return rows.select("text", "toxic").mapInArrow(read, "word bigint, toxic int, n bigint").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model, the intercept first, by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 0.0 if not len(y) else math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    keep = ridge * np.eye(len(w)) * len(x) / 100
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out, at most ``sample`` of them.

    A key labelled twice counts with its higher label; null keys and labels are left out.
    Without labels of both classes the model has no lexicon and scores all texts alike.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col(f"`{key}`").isNotNull() & ~held_out(F.col(f"`{key}`"), HELD_OUT))
    taught = marked.groupBy(F.col(f"`{key}`").alias("k")).agg(F.max(F.col("toxic")).cast("int").alias("toxic"))
    chosen = lowest_hashes(taught, "k", sample).withColumn("h", hash60(F.col("k")))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(written(chosen, "toxic-labels")), F.expr("id = k")
    )
    rows = written(_once(rows.select("text", F.expr("cast(toxic <> 0 as int) as toxic"), "h")), "toxic-sample")
    lexicon = lexicon_of(rows.where("h % 3 <> 0"))
    near = {(r["word"], r["toxic"]): r["n"] for r in _near_hits(rows.where("h % 3 <> 0"), lexicon).collect()}
    faded = tuple(
        w if not near.get((i, 0)) else max(0.0, min(w, math.log((near.get((i, 1), 0) + 0.5) / (near[i, 0] + 0.5)) + 2))
        for i, w in enumerate(lexicon.weights)
    )
    lexicon = replace(lexicon, near=faded)
    fit = _featured(rows.where("h % 3 = 0").select("h", "toxic", "text"), "text", lexicon).drop("text").orderBy("h", "toxic", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in fit], dtype=float).reshape(len(fit), len(FEATURES))
    return Model(lexicon, tuple(_fitted(x, np.array([r["toxic"] for r in fit], dtype=float))))


def _featured(rows: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    fields = [T.StructField(f, T.DoubleType()) for f in FEATURES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            x = np.array([features(t.as_py(), matcher) for t in b.column(b.schema.get_field_index(text))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in x.T)], [*b.schema.names, *FEATURES])

    return rows.mapInArrow(read, T.StructType([*rows.schema.fields, *fields]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score`` and ``predicted`` (1 from a score of a half up).

    A null or empty text, or one without a match, scores what the model gives to no match.
    Input columns with these names are replaced; rows are neither merged nor dropped.
    """
    kept = shadowed(docs, "score", "predicted")
    fields = [*kept.schema.fields, T.StructField("score", T.DoubleType())]
    names = kept.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for b in batches:
            x = np.array([features(t.as_py(), matcher) for t in b.column(len(names))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(model.score(x))], [*names, "score"])

    return rows.mapInArrow(read, T.StructType(fields)).withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))
