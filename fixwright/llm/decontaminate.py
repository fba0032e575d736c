"""Finding benchmark items in documents, also with other numbers and names.

A text becomes a sequence of tokens: lowered words, with typed placeholders for numbers
(digits or number words), for the unit after a number, and, in a second reading, for
names (capitalised words inside a sentence). A third reading takes capitalised words that
begin a sentence for names as well, but for the words of ``OPENERS``, which are none.
Windows of five tokens are hashed in all readings, since a passage pasted behind other text
may have its capitals read otherwise; a name of the second matches one of the third.

Windows of documents are hash-joined with windows of items. Before the join a bitmap of
the items' hashes, of a fixed size whatever the benchmark's, lets through every window
that may match and few others, so that hardly any window of a clean text is shuffled.

Five slots in a row are no template: such a window is compared with its values, and an
item with ``TELLING`` or more other windows is judged by those alone.

A matched window carries the values of its slots on both sides. Windows vote within an
alignment, which is how far behind its place in the item a window stands in the document:
there each value of the item must stand for one value of the document, the value that
most windows give it, of equal ones its own, and windows that disagree are taken out. So a window that also fits
another clause of the item cannot outvote the copy it belongs to. Copies that are
interrupted are put together: each place of the item takes its window from the largest
alignment, of equal ones from one without changes, and these vote once more. An item is found in a document when 0.8 or more of
its windows are left, of the best alignment or of those put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .common import bitmap

WORDS, SIMILARITY = 5, 0.8
TELLING = 5  # windows with a plain word from which on an item is judged by these alone
BITMAP_BITS = 24

NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds"
    " ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks"
    " month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres"
    " kilometer kilometers kilometre kilometres kmh mph watt watts volt volts joule joules newton newtons".split()
)
#: Words that often begin a sentence and are not names.
OPENERS = frozenset(
    "a an the this that these those there here it its he she they we you i his her their our your my what when where which who"
    " whose whom why how if in on at by for from of to with without after before during since until while then and or but so as"
    " is are was were do does did has have had can could should would not no each every all both some any many most one".split()
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
NUMBER, UNIT, NAME, OPENER = 1, 2, 3, 4  # an opener is a name in the third reading only
BATCH = 4 << 20  # bytes of text read at once


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP | np.uint64(1), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash(token: str) -> int:
    b = np.frombuffer(token.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    return int(_mixed(np.array([(b * _powers(len(b))).sum()], dtype=np.uint64))[0])


_LISTED = {_hash(w): NUMBER for w in NUMBERS} | {_hash(w): UNIT for w in UNITS}
_LISTED_HASH = np.array(sorted(_LISTED), dtype=np.uint64)
_LISTED_KIND = np.array([_LISTED[h] for h in sorted(_LISTED)], dtype=np.int8)
_NO_NAME = np.array(sorted(map(_hash, OPENERS)), dtype=np.uint64)
_HOLDERS = np.array([0, *(_hash(f"<{k}>") for k in ("number", "unit", "name"))], dtype=np.uint64)

_LETTER, _DIGIT, _STOP = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".!?:;\n"]] = _STOP


@dataclass
class Tokens:
    """Tokens of some texts laid end to end: the text each is in, its bytes, its own and its three read hashes and the kind of slot (0: a word)."""

    text: np.ndarray
    buffer: bytes
    begin: np.ndarray
    end: np.ndarray
    plain: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    kind: np.ndarray

    def spelt(self, i: int) -> str:
        return self.buffer[self.begin[i] : self.end[i]].decode(errors="replace")


def _lowered(text: str) -> str:
    """Lowered letter by letter where that keeps the length in bytes."""
    low = text.lower()
    if len(low.encode()) == len(text.encode()):
        return low
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text)


def canonical(texts: list[str | None]) -> Tokens:
    """Runs of letters and of digits (with points and commas between digits), read three times.

    Letters are those of ASCII and all characters beyond it but the punctuation of Latin-1
    and the general punctuation block.
    """
    whole = [t or "" for t in texts]
    low = [_lowered(t).encode() + b"\n" for t in whole]
    buffer = b"".join(low)
    b = np.frombuffer(buffer, np.uint8)
    given = np.frombuffer(b"\n".join(t.encode() for t in whole) + b"\n", np.uint8)
    kind = _CLASS[b]
    for lead, width in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(b == lead)
        if width == 3:
            at = at[b[at + 1] == 0x80]
        for k in range(width):
            kind[at + k] = 0
    inner = np.flatnonzero((b == 46) | (b == 44))
    inner = inner[(inner > 0) & (inner + 1 < len(b))]
    kind[inner[(kind[inner - 1] == _DIGIT) & (kind[inner + 1] == _DIGIT)]] = _DIGIT
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    begin, end = edge[:-1], edge[1:]
    what = kind[begin] if len(begin) else kind[:0]
    word = (what == _LETTER) | (what == _DIGIT)
    # a word begins a sentence if a stop lies between it and the word before
    stops = np.cumsum(what == _STOP)[word]
    starts = np.diff(stops, prepend=-1) != 0
    begin, end, what = begin[word], end[word], what[word]
    text = np.searchsorted(np.cumsum([len(x) for x in low]), begin, side="right")
    n = end - begin
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inside = b[(kind == _LETTER) | (kind == _DIGIT)].astype(np.uint64) + np.uint64(1)
    inside *= _powers(int(n.max(initial=1)))[place]
    plain = _mixed(np.add.reduceat(inside, np.cumsum(n) - n)) if len(n) else np.zeros(0, dtype=np.uint64)
    at = np.minimum(np.searchsorted(_LISTED_HASH, plain), len(_LISTED_HASH) - 1)
    listed = np.where(_LISTED_HASH[at] == plain, _LISTED_KIND[at], 0)
    number = (what == _DIGIT) | (listed == NUMBER)
    follows = np.r_[False, number[:-1] & (text[1:] == text[:-1])][: len(number)]
    unit = (listed == UNIT) & follows
    capital = given[begin] != b[begin]
    wide = np.flatnonzero(b[begin] >= 128)
    capital[wide] |= given[begin[wide] + 1] != b[begin[wide] + 1]
    capital &= ~unit & ~number & (what == _LETTER)
    name = capital & ~starts
    opener = capital & starts & ~np.isin(plain, _NO_NAME)
    slot = np.select([number, unit, name, opener], [NUMBER, UNIT, NAME, OPENER], 0)
    first = np.where(number | unit, _HOLDERS[np.where(opener, 0, slot)], plain)
    second = np.where(name, _HOLDERS[NAME], first)
    return Tokens(text, buffer, begin, end, plain, first, second, np.where(opener, _HOLDERS[NAME], second), slot)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def keyed(tokens: Tokens, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size and reading (size, reading, first tokens, keys, which are bare).

    The second reading has only windows with a name, the third with an opener, and neither
    has windows of slots alone. Such bare windows of the first have the values in their keys.
    """
    kind = tokens.kind
    so_far = lambda test: np.r_[0, np.cumsum(test)]
    figures = so_far((kind == NUMBER) | (kind == UNIT))
    further = [(2, tokens.second, so_far(kind == NAME), so_far((kind > 0) & (kind <= NAME))), (3, tokens.third, so_far(kind == OPENER), so_far(kind > 0))]
    for size in sizes:
        a = windows(tokens.first, size)
        if not len(a):
            continue
        held = lambda count: count[size:] - count[:-size]  # noqa: E731, B023
        within = tokens.text[: len(a)] == tokens.text[size - 1 :][: len(a)]
        bare = held(figures) == size
        yield size, 1, np.flatnonzero(within), np.where(bare, windows(tokens.plain, size) ^ np.uint64(2), a)[within], bare[within]
        for reading, hashes, own, slots in further:
            has = within & (held(own) > 0) & (held(slots) < size)
            if has.any():
                yield size, reading, np.flatnonzero(has), (windows(hashes, size) ^ np.uint64(1))[has], np.zeros(has.sum(), bool)


_SLOTS = "array<struct<kind:int,value:string>>"
_ROWS = pa.schema([("pos", pa.int64()), ("key", pa.int64()), ("slots", pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())])))])


def _slots(tokens: Tokens, at: int, size: int, reading: int) -> list[dict]:
    return [
        {"kind": min(int(tokens.kind[i]), NAME), "value": tokens.spelt(i)}
        for i in range(at, at + size) if tokens.kind[i] and (tokens.kind[i] < NAME or reading > tokens.kind[i] - NAME + 1)
    ]


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """Rows (item, n, pos, size, key, slots); an item with fewer than ``words`` tokens is one window.

    ``n`` is the number of windows by which the item is judged.
    """
    rows = items.select(F.col("item_id").alias("item"), F.col("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, out = [], ([], [], [], [], [])
            for i, t in enumerate(b.column(1).to_pylist()):
                tokens = canonical([t])
                size = min(words, len(tokens.kind))
                if not size:
                    continue
                read = list(keyed(tokens, [size]))
                telling = int((~read[0][4]).sum())
                judged = telling if telling >= TELLING else len(read[0][4])
                for _, reading, at, keys, bare in read:
                    use = ~bare | (judged > telling)
                    for p, k in zip(at[use].tolist(), keys[use].view(np.int64).tolist(), strict=True):
                        take.append(i)
                        for o, v in zip(out, (judged, size, p, k, _slots(tokens, p, size, reading)), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 *(pa.array(o, f.type) for o, f in zip(out[2:], _ROWS, strict=True))],
                ["item", "n", "size", *_ROWS.names],
            )

    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(read, f"item {kind}, n bigint, size int, pos bigint, key bigint, slots {_SLOTS}")


def matched_windows(docs: DataFrame, key: str, text: str, sizes: list[int], may: np.ndarray, bits: int) -> DataFrame:
    """Rows (id, pos, key, slots) of the documents' windows that the bitmap lets through."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    mask = np.uint64(2**bits - 1)

    def found(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        take, out = [], ([], [], [])
        tokens = canonical(texts)
        begins = np.searchsorted(tokens.text, np.arange(len(texts)))
        for size, reading, at, keys, _ in keyed(tokens, sizes):
            low = keys & mask
            hit = np.flatnonzero(may[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            for p, k in zip(at[hit].tolist(), keys[hit].view(np.int64).tolist(), strict=True):
                own = int(tokens.text[p])
                take.append(own)
                for o, v in zip(out, (p - int(begins[own]), k, _slots(tokens, p, size, reading)), strict=True):
                    o.append(v)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(take, pa.int64())), *(pa.array(o, f.type) for o, f in zip(out, _ROWS, strict=True))], ["id", *_ROWS.names]
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes_in = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64)) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(sizes_in)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield found(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).to_pylist())

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, pos bigint, key bigint, slots {_SLOTS}")


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    words: int = WORDS, similarity: float = SIMILARITY, bits: int = BITMAP_BITS,
) -> DataFrame:
    """Rows (key, item_id, n_windows, n_matched, similarity, changed), one for each item found in a document.

    ``changed`` tells that some slot has another value than in the item. Null and empty
    texts have no windows, and null item ids name an item like any other. Rows with the
    same key count as one document, items with the same id as one item. Without items or
    documents the result is empty. Only the named columns of the inputs are read.
    """
    theirs = written(item_windows(items, words), "item-windows")
    sizes = [r["size"] for r in theirs.select("size").distinct().orderBy("size").collect()]
    totals = theirs.groupBy("item").agg(F.count_distinct("pos").alias("n_windows"))
    ours = matched_windows(docs, key, text, sizes, bitmap(theirs, bits), bits)
    pairs = theirs.select("item", F.col("pos").alias("at"), F.col("key").alias("k"), F.col("slots").alias("theirs"))
    hits = ours.join(pairs, F.expr("key = k")).select(
        "id", "item", "at", (F.col("pos") - F.col("at")).alias("off"), F.zip_with("theirs", "slots", lambda a, b: F.struct(
            a["kind"].alias("kind"), a["value"].alias("item_value"), b["value"].alias("value"))).alias("pairs"),
    )
    hits = written(hits, "matched-windows")
    along = written(agreed(hits, ["id", "item", "off"]), "aligned-windows")
    sizes_of = along.groupBy("id", "item", "off").agg(F.count_distinct("at").alias("n"), F.bool_or("differs").alias("changed"))
    sizes_of = written(sizes_of, "alignments")
    best = sizes_of.groupBy("id", "item").agg(F.max(F.struct("n", (~F.col("changed")).alias("same"))).alias("best"))
    # an interrupted copy: each place of the item in its largest alignment
    ranked = along.select("id", "item", "off", "at").join(sizes_of.select(*[F.col(c).alias(f"s_{c}") for c in sizes_of.columns]),
                                                           F.expr("id <=> s_id and item <=> s_item and off = s_off"))
    places = ranked.groupBy("id", "item", "at").agg(F.max_by("off", F.struct("s_n", ~F.col("s_changed"), -F.col("off"))).alias("off"))
    places = written(places.select(*[F.col(c).alias(f"p_{c}") for c in places.columns]), "places")
    chosen = hits.join(places, F.expr("id <=> p_id and item <=> p_item and at = p_at and off = p_off"), "left_semi")
    joint = agreed(chosen, ["id", "item"]).groupBy("id", "item").agg(
        F.struct(F.count_distinct("at").alias("n"), (~F.bool_or("differs")).alias("same")).alias("best"))
    found = best.union(joint).groupBy("id", "item").agg(F.max("best").alias("best"))
    totals = totals.withColumnRenamed("item", "item_id")
    return (
        found.select("id", "item", F.col("best.n").alias("n_matched"), (~F.col("best.same")).alias("changed"))
        .join(totals, F.expr("item <=> item_id")).where(F.col("n_matched") >= similarity * F.col("n_windows"))
        .select(F.col("id").alias(key), "item_id", "n_windows", "n_matched",
                (F.col("n_matched") / F.col("n_windows")).alias("similarity"), "changed")
    )


def agreed(hits: DataFrame, group: list[str]) -> DataFrame:
    """The windows (id, item, off, at, differs) whose values agree with those that most windows of their group give."""
    place = ["id", "item", "off", "at"]
    plain = hits.where(F.size("pairs") == 0).select(*place, F.lit(False).alias("differs"))
    each = hits.where(F.size("pairs") > 0).select(*place, F.explode("pairs").alias("pair")).select(*place, "pair.*")
    same = [*group, "kind", "item_value"]
    votes = each.groupBy(*same, "value").count().groupBy(*same).agg(F.max_by("value", F.struct("count", F.expr("value = item_value"), "value")).alias("stands_for"))
    named = votes.select(*[F.col(c).alias(f"v_{c}") for c in votes.columns])
    judged = each.join(named, F.expr(" and ".join(f"{c} <=> v_{c}" for c in same))).groupBy(*place).agg(
        F.bool_and(F.expr("value = v_stands_for")).alias("agrees"), F.bool_or(F.expr("value <> item_value")).alias("differs")
    )
    return plain.union(judged.where("agrees").select(*place, "differs"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    found = written(leaks(docs, items, key, text, **options).select(F.col(key).alias("__found")).distinct(), "leaking")
    return docs.join(found, F.expr(f"`{key}` <=> __found"), "left_anti")
