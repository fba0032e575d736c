"""Scoring texts with a Katz backoff model of word pairs.

Words are counted over all training texts. Good-Turing discounts take probability from
words and pairs seen at most ``LOW`` times; what a history's seen pairs leave goes to the
words it was never followed by, in proportion to their own probabilities, by a weight
that makes each history's probabilities add up to one.

Every word is a history and a target of pairs by itself, and every pair is counted; an
unseen word has the unseen mass, so the sums stay one. Frequent words are numbered by
rank, the others by 63 bits of their XXH64. A caller may ask for a smaller ``vocabulary``:
all other words then share one class in pairs, within which a word has its share of the
class's word probabilities.

Pairs are stored in a table partitioned by history. A token is scored recursively: by its
pair if the pair was seen, else by its history's weight and the word's own probability.
The second part is done where texts are read, as far as the words are frequent; a seen
pair and a rarer word are corrections to it. Pairs and words beyond a count, at most
``HOT_PAIRS`` and ``HOT_WORDS`` of them whatever the corpus, are broadcast: they make up
most of the text, and with them goes all skew. The others are looked up by one join (pairs
with their counts, words with their counts and their weights as histories), sorted by one
number for a pair, and the corrections are added up for each text.

Every pair of a text the model has learned from was seen, so there the first part is done
where texts are read, as if its other pairs had been seen once; only those seen more often
are corrected. A bitmap of fixed size says which cannot be such; the join decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import new_path, written
from .common import bitmap, held_out

HOT_WORDS, HOT_PAIRS = 262_144, 2_097_152
LOW = 5  # counts that are discounted
HELD_OUT = 10
BUCKETS = 4  # partitions of the table of pairs, by history; a power of two
PART = 2**20  # tokens to one part of the pairs, about
TEXTS = 500  # read at a time
HELD_WORDS, HELD_PAIRS = 300_000, 2_000_000  # distinct words, and pairs in all, that a task counts before they are passed on
BITS = 26  # of the bitmap of pairs seen more than once
END = b"\n"  # no word has white space in it
SEED = 42
_START, _CLASS = 0, 1  # numbers of the empty history and of the class of other (or unseen) words; the vocabulary follows
_FIRST = 2
_RARE = -(2**63)  # set in the numbers of words that have no rank
_MIX, _LOW31 = (1_640_531_527, 1_364_711_929), 2**31 - 1
_ODD = 0x9E37_79B9_7F4A_7C15  # spreads numbers over 64 bits
_BACK = pow(_ODD, -1, 2**64)
_SUMS = {"n_tokens": "bigint", "n_known": "bigint", "base": "double", "score": "double"}  # of a text: tokens, those with ranks, the base, the score
_TEXT, _NEW, _LEARNED = 0, 1, 2  # rows of a text's sums; what a text not learned from, and one learned from, has yet to look up


def tokens(text: str | None) -> list[bytes]:
    """Lowered words and one end."""
    return [*(text or "").encode().lower().split(), END]


def discounts(n: dict[int, int]) -> np.ndarray:
    """What is kept of the counts 0 to ``LOW``, from the number of types of each count.

    Katz's Good-Turing ratios; where those are not between 0 and 1, as happens with few
    types, one constant is subtracted from every low count instead.
    """
    n1, n2 = n.get(1, 0), n.get(2, 0)
    if all(n.get(r) for r in range(1, LOW + 2)):
        a = (LOW + 1) * n[LOW + 1] / n1
        kept = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else 0 for r in range(1, LOW + 1)]
        if all(0 < d < 1 for d in kept):
            return np.array([1.0, *kept])
    less = n1 / (n1 + 2 * n2) if 0 < n1 and n2 else 0.5
    return np.array([1.0, *(1 - less / r for r in range(1, LOW + 1))])


@dataclass
class Words:
    """Word probabilities: ``total`` tokens of ``types`` kinds, the kept share of each low count, the unseen mass."""

    total: int
    types: int
    kept: np.ndarray
    scale: float
    unseen: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        low = np.minimum(c, LOW)
        share = np.where(c <= LOW, self.kept[low], 1.0) * c * self.scale / max(self.total, 1)
        return np.where(c > 0, share, self.unseen)


def words_of(by_count: dict[int, int]) -> Words:
    """Word probabilities from the number of words of each count."""
    total, types = sum(c * n for c, n in by_count.items()), sum(by_count.values())
    kept = discounts(by_count)
    mass = sum(n * c * (kept[c] if c <= LOW else 1.0) for c, n in by_count.items())
    left = 1 - mass / total if total else 1.0
    scale = 1.0
    if total and left < 1e-9:  # nothing was discounted: one more token is set aside
        scale, left = total / (total + 1), 1 - mass / (total + 1)
    return Words(total, types, kept, scale, left)


class Text:
    """Numbers of words. Those beyond a ``vocabulary`` share one; without it, words that are not among the frequent ones have negative numbers."""

    def __init__(self, frequent: list[bytes], vocabulary: int | None = None):
        self.rank = {w: i for i, w in enumerate(frequent)}
        self.apart = vocabulary is None
        self.vocabulary = len(frequent) if vocabulary is None else min(vocabulary, len(frequent))

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of some texts: the text each is in, its rank (-1 for none), its number as a target, and the hashes of those without a rank."""
        each = [tokens(t) for t in texts]
        words = list(chain.from_iterable(each))
        of = np.repeat(np.arange(len(each)), [len(t) for t in each])
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        target = np.where((rank >= 0) & (rank < self.vocabulary), rank + _FIRST, _CLASS)
        rare = rank < 0
        hashes = map(xxhash.xxh64_intdigest, compress(words, rare.tolist()), repeat(SEED))
        hashed = np.fromiter(hashes, dtype=np.uint64, count=int(rare.sum())).view(np.int64) | np.int64(_RARE)
        if self.apart:
            target[rare] = hashed
        return of, rank, target, hashed

    def histories(self, of: np.ndarray, target: np.ndarray) -> np.ndarray:
        history = np.r_[_START, target[:-1]][: len(target)]
        history[np.r_[True, of[1:] != of[:-1]][: len(of)]] = _START
        return history


def _packed(history: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One number for each pair of words with ranks, -1 for other pairs."""
    return np.where((history >= 0) & (target >= 0), history << np.int64(32) | target, -1)


def _number(word: Column) -> Column:
    """The number of a word without a rank."""
    return F.xxhash64(word).bitwiseOR(F.lit(_RARE))


def _word_counts(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > HELD_WORDS:
                    yield out()
                    seen = Counter()
        yield out()

    return docs.select("text").mapInArrow(read, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _spread(pair: np.ndarray) -> np.ndarray:
    return pair.view(np.uint64) * np.uint64(_ODD)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _dealt(docs: DataFrame, text: Text, parts: int) -> DataFrame:
    """The pairs of rows (text, learned), one row for each part a task has pairs for: pairs of ranks spread over 64 bits, others by their two numbers.

    ``near_c`` and ``far_c`` count the pairs in texts learned from; 0 stands for a pair of another text.
    """
    cuts = np.array([k * 2**64 // parts for k in range(parts)], dtype=np.uint64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = [np.unique(np.concatenate(near[mine]), return_counts=True) for mine in near]
            pair = np.concatenate([p for p, _ in found])
            near_c = np.concatenate([n if mine else np.zeros(len(n)) for mine, (_, n) in zip(near, found, strict=True)])
            order = np.argsort(pair, kind="stable")  # merges two runs
            pair, near_c = pair[order], near_c[order].astype(np.int32)
            h, w, far_c = (np.concatenate(x) for x in zip(*far, strict=True))
            spread = _spread(h ^ w << np.int64(1))
            order = np.argsort(spread)
            of_near, of_far = (np.r_[np.searchsorted(x, cuts), len(x)] for x in (pair, spread[order]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(parts, dtype=np.int32)), _lists(pair.view(np.int64), of_near), _lists(near_c, of_near),
                 *(_lists(x[order], of_far) for x in (h, w, far_c))],
                ["part", "near", "near_c", "h", "w", "far_c"],
            )

        near, far, n = {True: [], False: []}, [], 0
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                of, _, target, _ = text.flat(part.column(0).to_pylist())
                learned = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[of]
                history = text.histories(of, target)
                pair = _packed(history, target)
                other = pair < 0
                far.append((history[other], target[other], learned[other].astype(np.int32)))
                for mine in near:
                    near[mine].append(_spread(pair[~other & (learned == mine)]))
                n += len(pair)
                if n > HELD_PAIRS:
                    yield out()
                    near, far, n = {True: [], False: []}, [], 0
        if n:
            yield out()

    return docs.select("text", "learned").mapInArrow(
        read, "part int, near array<bigint>, near_c array<int>, h array<bigint>, w array<bigint>, far_c array<int>"
    )


def _counted(dealt: pa.Table) -> pa.Table:
    """Rows (h, w, c, asked) of one part's pairs."""
    flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in dealt[name].chunks])
    pair = (flat("near").view(np.uint64) * np.uint64(_BACK)).view(np.int64)
    order = np.argsort(pair)
    pair = pair[order]
    h, w = flat("h"), flat("w")
    far = np.lexsort((w, h))
    sides = (pair >> np.int64(32), pair & np.int64(2**32 - 1), flat("near_c")[order]), (h[far], w[far], flat("far_c")[far])
    tables = []
    for h, w, c in sides:
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])][: len(h)])
        all_of = np.add.reduceat(c, first, dtype=np.int64) if len(first) else np.zeros(0, dtype=np.int64)
        asked = np.minimum.reduceat(c, first) == 0 if len(first) else np.zeros(0, dtype=bool)
        kept = all_of > 0
        tables.append(pa.table({"h": h[first[kept]], "w": w[first[kept]], "c": all_of[kept], "asked": asked[kept]}))
    rows = pa.concat_tables(tables)
    h, w, c, asked = (rows[name].to_numpy() for name in rows.column_names)
    folder = (h & (BUCKETS - 1)) << 3 | (h < 0) << 2 | (w < 0) << 1 | (c == 1) & ~asked  # a writer takes one folder's rows after the other's
    order = np.argsort(folder.astype(np.uint8), kind="stable")
    return pa.table({"h": h[order], "w": w[order], "c": c[order], "asked": asked[order]})


def _pair_counts(docs: DataFrame, text: Text, parts: int) -> DataFrame:
    """Rows (h, w, c, asked) of all pairs in rows (text, learned): how often learned texts have them, and whether others do.

    Each pair falls to one of ``parts`` parts by its numbers; there are as many as hold ``PART`` tokens each, so none grows
    with the corpus. ``rare`` is 1 if the history has no rank, 2 if the target has none, 3 if neither has; ``seldom`` are pairs
    seen once that no other text asks for.
    """
    counted = _dealt(docs, text, parts).groupBy("part").applyInArrow(_counted, "h bigint, w bigint, c bigint, asked boolean")
    rare = F.when(F.col("h") < 0, 1).otherwise(0) + F.when(F.col("w") < 0, 2).otherwise(0)
    seldom = (F.col("c") == 1) & ~F.col("asked")
    return counted.withColumns({"bucket": F.pmod("h", F.lit(BUCKETS)).cast("int"), "rare": rare, "seldom": seldom})


def _spot(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where the bitmap has a pair."""
    return (((h & _LOW31) * _MIX[0]) ^ ((w & _LOW31) * _MIX[1])) >> 20 & (2**BITS - 1)


def _spot_column() -> Column:
    low = lambda name, m: F.col(name).bitwiseAND(F.lit(_LOW31)) * F.lit(m).cast("bigint")
    return F.shiftright(low("h", _MIX[0]).bitwiseXOR(low("w", _MIX[1])), 20)


#: Shuffle files go as soon as their query has ended, for what is written here is read from its table; and a task writes its partitions side by side, not sorted.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(8 * BUCKETS)}


#: Each part's pairs are in order, so differences of their numbers are shorter than a dictionary.
_SORTED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#h": "false", "parquet.enable.dictionary#w": "false"}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    try:
        for name, value in _WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _by_count(table: DataFrame) -> dict[int, int]:
    """How many rows have each count; there are at most as many counts as the root of twice the tokens."""
    return {r["c"]: r["n"] for r in table.groupBy("c").agg(F.count("*").alias("n")).collect()}


def _least_count(by_count: dict[int, int], most: int) -> int:
    """The least count that no more than ``most`` rows reach."""
    rows, least = 0, max(by_count, default=0) + 1
    for c in sorted(by_count, reverse=True):
        rows += by_count[c]
        if rows > most:
            break
        least = c
    return least


@dataclass
class Model:
    """A fitted model: the small parts in memory, the tables of all words and pairs on the shared disk."""

    words: Words
    text: Text
    counts: np.ndarray  # of the frequent words, by rank
    log_target: np.ndarray  # of each target number: its own probability (of the class: the class's)
    log_class: float
    log_weight: np.ndarray  # of each history number
    log_scale: np.ndarray  # of each history number: what every pair seen after it has beside its own share
    once: float  # the logarithm of a count of one, less its discount
    found: DataFrame  # rows (h, w, c, new, learned): a pair that is not hot, or a word h without a rank (w: 0), and what finding it adds to a text's score
    more: np.ndarray  # the bitmap of pairs not hot that were seen more than once
    hot_pairs: np.ndarray
    hot_share: np.ndarray


def _share(c: Column, kept: np.ndarray) -> Column:
    """A count less its discount."""
    return F.when(c <= LOW, F.get(F.array(*[F.lit(float(d)) for d in kept]), c.cast("int"))).otherwise(1.0) * c


def _histories(pairs: DataFrame, kept: np.ndarray) -> DataFrame:
    """Rows (h, log_weight, log_scale) from rows (h, c, p): the weight of backing off, and what every seen pair has beside its share."""
    lost = F.when(F.col("c") <= LOW, F.get(F.array(*[F.lit(float(r * (1 - kept[r]))) for r in range(LOW + 1)]), F.col("c").cast("int"))).otherwise(0.0)
    rows = pairs.groupBy("h").agg(F.sum("c").alias("total"), (F.lit(1.0) - F.sum("p")).alias("unseen"), F.sum(lost).alias("lost"))
    total, unseen = F.col("total"), F.col("unseen")
    set_aside = F.col("lost") / total < 1e-9  # only frequent pairs: one more is set aside
    rows = rows.select("h", "total", "unseen", F.when(set_aside, total / (total + 1)).otherwise(1.0).alias("scale"),
                       F.when(set_aside, (F.col("lost") + 1) / (total + 1)).otherwise(F.col("lost") / total).alias("left"))
    full = unseen < 1e-9  # every word was seen here: nothing to hand out, so nothing is taken
    scale = F.when(full, F.col("scale") / (1 - F.col("left"))).otherwise(F.col("scale"))
    weight = F.log10(F.greatest(F.when(full, 0.0).otherwise(F.col("left") / unseen), F.lit(1e-300)))
    return rows.select("h", weight.alias("log_weight"), F.log10(scale / total).alias("log_scale"))


def fit(
    docs: DataFrame, vocabulary: int | None = None, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS, asked: DataFrame | None = None
) -> Model:
    """A model of the rows (text) given; all of them and all their pairs are counted.

    With ``asked``, rows (text) too, the model is for scoring those and the ones it learns
    from: pairs seen once that they do not have need not be found again.
    """
    texts = docs.select("text", F.lit(True).alias("learned"))
    if asked is not None:
        texts = texts.unionByName(asked.select("text", F.lit(False).alias("learned")))
    with _writing(docs.sparkSession):
        return _fit(texts, asked is not None, vocabulary, hot_words, hot_pairs)


def _fit(texts: DataFrame, only_asked: bool, vocabulary: int | None = None, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS) -> Model:
    """``fit`` on rows (text, learned)."""
    spark = texts.sparkSession
    word_table = written(_word_counts(texts.where("learned")), "words")
    by_count = _by_count(word_table)
    words = words_of(by_count)
    often = max(_least_count(by_count, hot_words), 1)
    ranked = word_table.where(F.col("c") >= often).toArrow()
    order = sorted(zip((-c for c in ranked["c"].to_pylist()), ranked["word"].to_pylist(), strict=True))
    frequent, counts = [w for _, w in order], np.array([-c for c, _ in order], dtype=np.int64)
    text = Text(frequent, vocabulary)

    n = text.vocabulary + _FIRST
    own = words.probability(counts[: text.vocabulary])
    target = np.r_[0.0, words.unseen if text.apart else max(1 - own.sum(), words.unseen), own]
    log_target = np.log10(np.maximum(target, 1e-300))
    probability = _share(F.col("c"), words.kept) * words.scale / max(words.total, 1)
    rare_words = word_table.where(F.col("c") < often).select(_number(F.col("word")).alias("w"), "c", probability.alias("p"))
    numbered = F.broadcast(spark.createDataFrame(pa.table({"w": pa.array(np.arange(n)), "p": pa.array(np.maximum(target, 1e-300))})))
    own_of = {0: numbered, 2: rare_words.select("w", "p")}

    path = new_path(spark, "pairs")
    _pair_counts(texts, text, words.total // PART + 1).write.options(**_SORTED).partitionBy("bucket", "rare", "seldom").parquet(path)
    pair_table = spark.read.schema("h bigint, w bigint, c bigint, asked boolean, bucket int, rare int, seldom boolean").parquet(path).drop("bucket")
    pair_counts = _by_count(pair_table)
    kept = discounts(pair_counts)
    with_own = [pair_table.where(F.col("rare").bitwiseAND(F.lit(2)) == k).join(of, "w") for k, of in own_of.items()]
    histories = written(_histories(with_own[0].unionByName(with_own[1]), kept), "histories")
    ranks = histories.where("h >= 0").toArrow()
    log_weight, log_scale = np.zeros(n), np.zeros(n)
    log_weight[ranks["h"].to_numpy()] = ranks["log_weight"].to_numpy()
    log_scale[ranks["h"].to_numpy()] = ranks["log_scale"].to_numpy()

    c, least = F.col("c"), max(_least_count(pair_counts, hot_pairs), 1)
    share, once = F.log10(_share(c, kept)), float(np.log10(kept[1]))
    unseen = float(np.log10(max(words.unseen, 1e-300)))
    rare_words = rare_words.select("w", "c", F.log10("p").alias("own"))
    rare_histories = histories.where("h < 0")
    late = pair_table.where((F.col("rare") > 0) | (c < least))
    wanted = late.where("not seldom") if only_asked else late

    def pairs(rare: int) -> DataFrame:
        rows, new = wanted.where(F.col("rare") == rare), share
        if rare & 1:  # the word before has added its weight as a history
            rows, new = rows.join(rare_histories, "h"), new + F.col("log_scale") - F.col("log_weight")
        if rare & 2:  # the word has added its own probability
            rows, new = rows.join(rare_words.select("w", "own"), "w"), new + unseen - F.col("own")
        return rows.select("h", "w", "c", new.alias("new"), (share - once).alias("learned"))

    own_more = F.col("own") - unseen
    as_history = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    found = rare_words.withColumnRenamed("w", "h").join(rare_histories, "h", "left").select(
        "h", F.lit(_START).cast("bigint").alias("w"), "c", (own_more + as_history("log_weight")).alias("new"),
        (as_history("log_scale") if text.apart else own_more).alias("learned"),
    )
    for rare in range(4 if text.apart else 1):
        found = found.unionByName(pairs(rare))
    more = bitmap(late.where("not seldom").where(c > 1).select(_spot_column().alias("key")), BITS)
    pair = F.shiftleft("h", 32).bitwiseOR(F.col("w")).alias("pair")
    hot = (pair_table.where("not seldom") if least > 1 else pair_table).where((F.col("rare") == 0) & (c >= least)).select(pair, share.alias("share")).toArrow()
    hot_keys, order = hot["pair"].to_numpy(), np.argsort(hot["pair"].to_numpy())
    return Model(
        words, text, counts, log_target, float(log_target[_CLASS]), log_weight, log_scale, once, found, more, hot_keys[order], hot["share"].to_numpy()[order],
    )


def _read_texts(rows: DataFrame, model: Model) -> DataFrame:
    """From rows (rid, text, id, learned): the sums of each text, and the pairs (h, w) and words h (w: 0) that have yet to be looked up.

    ``sums`` are those of ``_SUMS``.
    ``rest`` is what a pair's being seen adds to the score beside what is found with it.
    """
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    small = (
        model.words, model.text, model.counts, model.log_target, model.log_class, model.log_weight, model.log_scale, model.once, model.more,
        model.hot_pairs, model.hot_share,
    )
    shared = rows.sparkSession.sparkContext.broadcast(small)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, text, counts, log_target, log_class, log_weight, log_scale, once, more, hot_pairs, hot_share = shared.value
        spread = words.total + 0.1 * (words.types + 1)
        base_of = np.log10((np.r_[counts, 0] + 0.1) / spread)  # the last is an unseen word's
        own_of = np.log10(np.maximum(words.probability(np.r_[counts, 0]), 1e-300))
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                n, rid, ids = part.num_rows, part.column(0).to_numpy(), part.column(2)
                of, rank, target, hashed = text.flat(part.column(1).to_pylist())
                learned = part.column(3).to_numpy(zero_copy_only=False).astype(bool)[of]
                history = text.histories(of, target)
                pair = _packed(history, target)
                number = lambda x: np.where(x < 0, _CLASS, x)  # noqa: E731  (no class has a weight where rare words are apart)
                h, w = number(history), number(target)
                order, at = np.argsort(pair), np.empty(len(pair), dtype=np.int64)  # in order, the search stays in near memory
                at[order] = np.minimum(np.searchsorted(hot_pairs, pair[order]), max(len(hot_pairs) - 1, 0))
                hot = hot_pairs[at] == pair if len(hot_pairs) else np.zeros(len(pair), dtype=bool)
                share = np.full(len(of), once)
                share[hot] = hot_share[at[hot]]
                score = np.where(hot | learned, share + log_scale[h], log_weight[h] + log_target[w])
                other = (target < 0) | (target == _CLASS)
                score[other] += own_of[rank[other]] - log_class
                sums = lambda x: np.bincount(of, x, minlength=n)
                yield _rows(_TEXT, rid, rid, None, None, ids, sums(np.ones(len(of))), sums(rank >= 0), sums(base_of[rank]), sums(score))
                late, new = ~hot, rank < 0
                maybe = np.flatnonzero(late & learned)
                spot = _spot(history[maybe], target[maybe])
                late[maybe] = more[spot >> 5] >> (spot & 31).astype(np.uint32) & 1 == 1
                words_of_kind = np.zeros(len(of), dtype=np.int64)
                words_of_kind[new] = hashed
                for kind, mine in ((_NEW, ~learned), (_LEARNED, learned)):
                    k, j = np.flatnonzero(late & mine), np.flatnonzero(new & mine)
                    rest = None if kind == _LEARNED else log_scale[h[k]] - log_weight[h[k]] - log_target[w[k]]
                    for which, left, right, more_of in ((k, history[k], target[k], rest), (j, words_of_kind[j], np.full(len(j), _START), None)):
                        if len(which):
                            yield _rows(kind, rid[of[which]], left, right, more_of, pa.nulls(len(which), id_type))

    return rows.mapInArrow(read, f"kind int, rid bigint, h bigint, w bigint, rest double, id {kind.simpleString()}, sums array<double>")


def _rows(kind: int, rid: np.ndarray, h: np.ndarray, w: np.ndarray | None, rest: np.ndarray | None, ids: pa.Array, *sums: np.ndarray) -> pa.RecordBatch:
    n, none = len(rid), lambda kind: pa.nulls(len(rid), kind)
    of_text = _lists(np.stack(sums, axis=1).ravel(), np.arange(n + 1) * len(sums)) if sums else none(pa.list_(pa.float64()))
    keys = [pa.array(h), none(pa.int64()) if w is None else pa.array(w), none(pa.float64()) if rest is None else pa.array(rest)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(rid), *keys, ids, of_text], ["kind", "rid", "h", "w", "rest", "id", "sums"]
    )


def _keys() -> tuple[Column, Column]:
    """Two numbers for the pair (h, w): one that is its own if both have ranks, and for other pairs what tells ``h`` from it."""
    turned = F.shiftleft("h", 32).bitwiseOR(F.shiftrightunsigned("h", 32))
    told = F.when((F.col("h") < 0) | (F.col("w") < 0), F.col("w")).otherwise(F.lit(_CLASS).cast("bigint"))
    return turned.bitwiseXOR(F.col("w")).alias("at"), told.alias("told")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", learned: Column | None = None) -> DataFrame:
    """Rows (key, n_tokens, n_known, train_tokens, base_score, score), one for each input row.

    ``n_known`` counts tokens seen in training, ``base_score`` adds up each token's
    add-a-tenth logarithm and ``score`` the model's, both to base ten. A null or empty text
    is one end. Without training texts every token has the unseen word's probability, one.
    Repeated rows stay repeated; an empty table gives an empty result. ``learned`` may mark
    the rows whose texts the model was fitted on, which saves work; a model fitted with
    ``asked`` needs it.
    """
    learned = F.lit(False) if learned is None else learned
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"), learned.alias("learned")
    )
    words = model.words
    spread = words.total + 0.1 * (words.types + 1)
    sums = F.struct("id", *[F.col("sums")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(_SUMS.items())])
    is_text, (at, told) = F.col("kind") == _TEXT, _keys()
    parts = _read_texts(rows, model).select(
        "rid", F.when(is_text, F.bitwise_not("rid")).otherwise(at).alias("at"), F.when(~is_text, told).alias("told"),
        F.when(F.col("kind") == _NEW, F.coalesce("rest", F.lit(0.0))).alias("rest"), F.when(is_text, sums).alias("sums"),
    )
    found = model.found.select(at, told.alias("found_told"), "c", "new", "learned")
    same = F.col("told").bitwiseXOR(F.col("found_told")) == 0  # not a key of the join, which sorts by one number
    parts = parts.join(found, (parts["at"] == found["at"]) & same, "left")
    adds = F.when(F.col("rest").isNull(), F.col("learned")).otherwise(F.col("new") + F.col("rest"))
    is_word = (F.col("told") == _START) & F.col("c").isNotNull()
    base = F.when(is_word, F.log10((F.col("c") + 0.1) / spread) - float(np.log10(0.1 / spread)))
    return parts.groupBy("rid").agg(
        F.first("sums.id", ignorenulls=True).alias(key), F.max("sums.n_tokens").alias("n_tokens"),
        (F.max("sums.n_known") + F.count_if(is_word)).alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"),
        F.sum(F.coalesce("sums.base", base, F.lit(0.0))).alias("base_score"), F.sum(F.coalesce("sums.score", adds, F.lit(0.0))).alias("score"),
    ).drop("rid")


def evaluate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows scored by a model of the ones that are not held out, with ``held_out``."""
    held = held_out(F.col(f"`{key}`"), HELD_OUT)
    with _writing(docs.sparkSession):
        model = _fit(docs.select(F.col(f"`{text}`").alias("text"), (~held).alias("learned")), True, **options)
    return score(docs, model, key, text, ~held).withColumn("held_out", held)
