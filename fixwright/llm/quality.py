"""Quality rules: fixed base rules and a learned decision list.

One pass measures every text. A bounded sample of labelled texts, the ones whose keys
hash lowest, teaches the list by sequential covering: a rule grows condition by condition
(a measure at least or at most a threshold) by information gained on two thirds of the
sample, is pruned back on the other third, and is kept if it is precise enough there.
What it covers is taken out, and the next rule is grown, until none is good enough. The
list is emitted as one ordered ``CASE WHEN`` expression over the measures; the first
rule that holds rejects a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import written
from .common import hash60, lowest_hashes

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of the words in repeated windows
SAMPLE = 20_000  # labelled texts, about, that the list is learned from
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 4, 48
LEAST_COVERED, LEAST_PRECISION = 3, 0.8  # of a rule on the pruning third

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _DIGIT, _MARK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?\"'()-"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_exclaims",
)
#: Measures that a rule may use: a name and a ratio of two counts.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "exclaims_a_word": ("n_exclaims", "n_words"),
    "chars_a_word": ("word_chars", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
}
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@dataclass(frozen=True)
class Rule:
    """All conditions (measure, at least or at most, threshold) must hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{m} {op} {t:.6g}" for m, op, t in self.conditions)


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``; a null text counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    only = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(set(words)), only(_UPPER), only(_DIGIT), only(_MARK), text.count("!"),
    )


def measured(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``rows`` with the counts of a text column, each under ``prefix`` and its name."""
    fields = [T.StructField(prefix + c, T.LongType()) for c in COUNTS]
    names = [f.name for f in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(b.schema.get_field_index(text))]
            new = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return rows.mapInArrow(read, T.StructType([*rows.schema.fields, *fields]))


def measure(name: str, prefix: str = "") -> Column:
    over, under = MEASURES[name]
    return F.col(prefix + over) / F.greatest(F.col(prefix + under), F.lit(1))


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MOST_REPEATED * n)


# Learning -----------------------------------------------------------------------------


def _holds(x: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    here = np.ones(len(x), dtype=bool)
    for m, op, t in rule.conditions:
        v = x[:, names.index(m)]
        here &= v >= t if op == ">=" else v <= t
    return here


def _grown(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """Add the condition that gains most information on bad texts until only they are covered."""
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(conditions) < MOST_CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, chosen = 1e-9, None
        for i, name in enumerate(names):
            v = x[inside, i]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="nearest")):
                for op, hit in ((">=", v >= t), ("<=", v <= t)):
                    p, n = int((hit & bad[inside]).sum()), int((hit & ~bad[inside]).sum())
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, chosen = gain, (name, op, float(t))
        if chosen is None:
            break
        conditions.append(chosen)
        inside &= _holds(x, names, Rule((chosen,)))
    return Rule(tuple(conditions))


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[Rule, int, int]:
    """The leading conditions that do best on the pruning third, with the bad and good texts they cover."""
    best = (-2.0, rule, 0, 0)
    for k in range(1, len(rule.conditions) + 1):
        short = Rule(rule.conditions[:k])
        hit = _holds(x, names, short)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        score = (p - n) / (p + n) if p + n else -1.0
        if score > best[0]:
            best = (score, short, p, n)
    return best[1:]


def learned(x: np.ndarray, bad: np.ndarray, third: np.ndarray, names: list[str]) -> list[Rule]:
    """The decision list for rejecting bad texts; ``third`` marks the rows to prune on."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & ~third, left & third
        if not (grow & bad).any() or not (prune & bad).any():
            break
        rule = _grown(x[grow], bad[grow], names)
        if not rule.conditions:
            break
        rule, p, n = _pruned(rule, x[prune], bad[prune], names)
        if p < LEAST_COVERED or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~_holds(x, names, rule)
    return rules


def learn(rows: DataFrame, labels: DataFrame, key: str, sample: int = SAMPLE) -> list[Rule]:
    """Rules from measured ``rows`` and ``labels`` (key, quality); without both classes there are none.

    Texts that the base rules reject teach nothing. A key labelled twice counts with its
    lower label; null keys and labels are left out.
    """
    names = list(MEASURES)
    marked = labels.where(F.col("quality").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__k"))
    taught = lowest_hashes(marked.agg(F.min("quality").alias("__q")), "__k", sample)
    chosen = (
        rows.where(~base_failed()).join(taught, F.col(f"`{key}`") == F.col("__k"))
        .select(hash60(F.col("__k")).alias("__h"), "__q", *[measure(m).alias(m) for m in names]).collect()
    )
    chosen.sort()
    if not chosen:
        return []
    x = np.array([[r[m] for m in names] for r in chosen], dtype=float)
    return learned(x, np.array([r["__q"] == 0 for r in chosen]), np.array([r["__h"] % 3 == 0 for r in chosen]), names)


def rule_number(rules: list[Rule], prefix: str = "") -> Column:
    """The number, from 1, of the first rule that holds; null if none does."""
    found = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for m, op, t in rule.conditions:
            holds = holds & (measure(m, prefix) >= t if op == ">=" else measure(m, prefix) <= t)
        found = F.when(holds, i).otherwise(found)
    return found


# Operators ----------------------------------------------------------------------------


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, counts, base_failed, kept, rule), one for each input row.

    ``rule`` is the number of the learned rule that rejects the text, if the base rules do
    not. A null text has no words. Repeated rows are judged alike; an empty table gives an
    empty result, and without labels only the base rules speak.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    found = written(measured(rows, "__text").drop("__text"), "text-measures")
    rules = learn(found, labels.select(F.col("doc_id").alias("__key"), "quality"), "__key")
    number = F.when(~base_failed(), rule_number(rules))
    return found.select(
        F.col("__key").alias(key), *COUNTS, base_failed().alias("base_failed"),
        (~base_failed() & number.isNull()).alias("kept"), number.alias("rule"),
    )


def passed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rules or the learned list reject.

    The texts are measured twice, once to learn and once to filter, and never shuffled.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    rules = learn(written(measured(rows, "__text").drop("__text"), "text-measures"), labels.select(F.col("doc_id").alias("__key"), "quality"), "__key")
    again = measured(docs, text, "__m_")
    return again.where(~base_failed("__m_") & rule_number(rules, "__m_").isNull()).select(*[f"`{c}`" for c in docs.columns])
