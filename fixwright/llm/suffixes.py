"""Removing passages that were there before, found by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a text
with a smaller key, or in the same text further left. Suffixes are sorted by the
difference-cover algorithm: names for the sampled triples, recursion on the names, the
remaining suffixes merged in by rank. In sorted order equal strings are neighbours, so
adjacent prefixes are compared and all but the earliest of a run are marked.

Sorting every suffix of a corpus would write many times the corpus. What cannot repeat is
therefore set aside first, without losing a repeat:

1. Every window of ``length`` bytes has an anchor, the least of the hashes in its first
   ``span`` places, which depends on nothing but the window; the windows of one anchor
   form a block. All strings equal to a window have the same bytes behind their anchors,
   its core. Blocks whose core is nowhere else are dropped, after one shuffle of a few
   bytes for each block.
2. Of equal blocks all but the earliest are marked whole. A block with a core that other
   blocks share is left for sorting, once, with its bytes.
3. Blocks go to tasks by core, so equal strings meet, and each task sorts the suffixes of
   its blocks, some megabytes at a time. A core with very many blocks is dealt over
   several tasks; what is earliest in each is then matched by a hash of the window.

The marks of a text are joined with it, and the joined spans are cut out. Texts without
marks are never shuffled: a bitmap of fixed size keeps back nearly all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import new_path, written
from .common import bitmap

LENGTH = 100
SPAN = 51  # places that a window's anchor is looked for in
GRAM = 8  # bytes that a place's hash is taken of
BATCH = 1 << 20  # bytes of text that blocks are made of at once
SORTED = 1 << 18  # bytes of blocks whose suffixes are sorted at once
MOST_BLOCKS = 2_000  # of one core in one task
BITMAP_BITS = 24
_PLACE = np.uint64((1 << 34) - 1)
_LAST = 2**63 - 1


# Sorting suffixes ---------------------------------------------------------------------


def _packed3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers that order as the triples do; the triples' own numbers are below 2**32."""
    a, b, c = (x.astype(np.uint64) for x in (a, b, c))
    if max(x.max(initial=0) for x in (a, b, c)) < 1 << 21:
        return a << np.uint64(42) | b << np.uint64(21) | c
    pair = np.unique(a << np.uint64(32) | b, return_inverse=True)[1].astype(np.uint64)
    return pair << np.uint64(32) | c


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """How many suffixes of ``s`` are smaller than each, as far as ``depth`` symbols tell them apart.

    Symbols are positive and below 2**32. Suffixes of one rank agree in at least their first
    ``depth`` symbols; beyond those the order is whatever falls out.
    """
    n = len(s)
    if n < 3 or depth <= 1:
        values, at, count = np.unique(s, return_inverse=True, return_counts=True)
        if depth <= 1 or len(values) == n:
            return (np.cumsum(count) - count)[at]
    t = np.r_[s, 0, 0, 0].astype(np.int64)
    i1, i2 = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # a sampled place just beyond the end stands for the empty suffix
    i1, i2 = i1[i1 <= n], i2[i2 <= n]
    sample = np.r_[i1, i2]
    name = np.unique(_packed3(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)[1]
    if depth > 3 and name.max(initial=-1) + 1 < len(sample):
        # the names in order of place, those of the two classes one after the other, a lowest symbol between them
        words = np.r_[name[: len(i1)] + 2, 1, name[len(i1) :] + 2]
        deeper = suffix_ranks(words, -(-depth // 3))
        name = np.r_[deeper[: len(i1)], deeper[len(i1) + 1 :]]
        name = np.unique(name, return_inverse=True)[1]
    rank = np.zeros(n + 4, dtype=np.int64)  # of sampled places, from 1
    rank[sample] = name + 1
    i0 = np.arange(0, n, 3)
    one, two = i1[i1 < n], i2[i2 < n]
    mine = _pairs(t[i0], rank[i0 + 1])
    both = np.r_[i0, two]
    triples = _packed3(t[both], t[both + 1], rank[both + 2])
    mine2, with2 = triples[: len(i0)], triples[len(i0) :]
    with1 = _pairs(t[one], rank[one + 1])
    zeros, ones, one_after = _smaller(mine, with1)
    _, twos, two_after = _smaller(mine2, with2)
    out = np.zeros(n, dtype=np.int64)
    out[i0] = zeros + ones + twos
    before = np.r_[0, np.cumsum(np.bincount(rank[np.r_[one, two]], minlength=2))]
    out[one] = before[rank[one]] + one_after
    out[two] = before[rank[two]] + two_after
    return out


def _smaller(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``a`` how many of ``a`` and of ``b`` are smaller, and for each of ``b`` how many of ``a``."""
    keys = np.r_[a, b]
    order = np.argsort(keys)
    keys = keys[order]
    run = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]][: len(keys)], np.arange(len(keys)), 0))
    of_a = np.r_[0, np.cumsum(order < len(a))][run]
    smaller_a, smaller_b = np.empty_like(order), np.empty_like(order)
    smaller_a[order], smaller_b[order] = of_a, run - of_a
    return smaller_a[: len(a)], smaller_b[: len(a)], smaller_a[len(a) :]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def equal_prefixes(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in suffix order, and for each whether its first ``length`` symbols are those of the one before."""
    order = np.argsort(ranks[starts], kind="stable")
    sorted_starts = starts[order]
    same = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        for i in range(1, len(order), 65_536):
            j = min(i + 65_536, len(order))
            same[i:j] = (view[sorted_starts[i:j]] == view[sorted_starts[i - 1 : j - 1]]).all(axis=1)
    return order, same


# Blocks -------------------------------------------------------------------------------


def blocks(buffer: bytes, ends: np.ndarray, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Blocks of texts laid end to end: the text's number, the anchor, the first and the last window."""
    x = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    least = x & ~_PLACE | np.arange(len(x), dtype=np.uint64)  # equal hashes go to the left
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    starts = np.r_[0, ends[:-1]]
    n = np.maximum(ends - starts - length + 1, 0)
    window = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.arange(len(ends)), n)
    anchor = (least[window] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(window)])
    last = np.r_[new[1:] - 1, len(window) - 1][: len(new)]
    return text[new], anchor[new], window[new], window[last]


_BLOCK = pa.schema([(c, pa.int64()) for c in ("core", "content", "doc", "uid", "place")])


def _packed(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return lo << 16 | (hi - lo) << 8 | (anchor - lo)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 16
    return lo, lo + (place >> 8 & 255), lo + (place & 255)


def all_blocks(rows: DataFrame, length: int, span: int) -> DataFrame:
    """Rows (core, content, doc, uid, place) of all blocks of ``rows`` (doc, uid, text).

    Of blocks that are equal within a batch only the earliest is left as it is; the others
    are known to repeat, get a core of their own and the complement of their place.
    """

    def work(ids: list[tuple[int, int]], texts: list[bytes]) -> pa.RecordBatch:
        buffer, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        text, anchor, lo, hi = blocks(buffer, ends, length, span) if len(buffer) >= length else [np.zeros(0, dtype=np.int64)] * 4
        h = xxhash.xxh64_intdigest
        core = np.array([h(buffer[a : a + length - span + 1]) for a in anchor.tolist()], dtype=np.uint64).view(np.int64)
        content = np.array(
            [h(buffer[i : j + length], a - i) for i, j, a in zip(lo.tolist(), hi.tolist(), anchor.tolist(), strict=True)], dtype=np.uint64
        ).view(np.int64)
        doc, uid = (np.array([x[k] for x in ids], dtype=np.int64)[text] for k in (0, 1))
        start = np.r_[0, ends[:-1]][text]
        place = _packed(lo - start, hi - start, anchor - start)
        order = np.lexsort((place, uid, doc, content, core))
        core, content, doc, uid, place = (x[order] for x in (core, content, doc, uid, place))
        first = np.r_[True, (core[1:] != core[:-1]) | (content[1:] != content[:-1])][: len(core)]
        known = ~first
        back = np.empty(len(order), dtype=np.int64)  # rows go out in the order of the texts, which packs better
        back[order] = np.arange(len(order))
        core[known], place[known] = (doc[known] * 31 + uid[known]) ^ place[known] * 0x2545F4914F6CDD1D, ~place[known]
        if known.any():  # a row given twice is not a repeat of itself
            of = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            keep = first | (doc != doc[of]) | (uid != uid[of]) | (~place != place[of])
            back = back[keep[back]]
        core, content, doc, uid, place = (x[back] for x in (core, content, doc, uid, place))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (core, content, doc, uid, place)], schema=_BLOCK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for d, u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = t.as_py().encode()
                if len(raw) < length:
                    continue
                if size and size + len(raw) > BATCH:
                    yield work(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append((d, u))
                texts.append(raw)
                size += len(raw)
            if texts:
                yield work(ids, texts)

    return rows.mapInArrow(read, "core bigint, content bigint, doc bigint, uid bigint, place bigint")


def sifted(found: DataFrame) -> DataFrame:
    """Rows (kind, core, doc, uid, place) of blocks: 0 if an earlier block is equal, 1 if it is to be sorted.

    Blocks with a core of their own are left out. One shuffle serves both windows.
    """
    same = Window.partitionBy("core", "content").orderBy("doc", "uid", "place")
    at = F.struct("doc", "uid", "place")
    seen = found.repartition("core").withColumns({
        "is_first": F.row_number().over(same) == 1,
        "head": F.first(at).over(same),
    }).withColumn("shared", F.min("content").over(Window.partitionBy("core")) != F.max("content").over(Window.partitionBy("core")))
    kind = (
        F.when((F.col("place") < 0) | (~F.col("is_first") & (at != F.col("head"))), 0)
        .when(F.col("is_first") & F.col("shared"), 1)
    )
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    return seen.select(kind.alias("kind"), "core", "doc", "uid", place.alias("place")).where("kind is not null")


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """Rows (core, deal, spread, doc, uid, place, piece): each block with its bytes, from rows (doc, uid, text, todo)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, uid, t, todo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = t.encode()
                for x in todo:
                    lo, hi, _ = _unpacked(x["place"])
                    for o, v in zip(out, (x["core"], x["deal"], x["spread"], doc, uid, x["place"], raw[lo : hi + length]), strict=True):
                        o.append(v)
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, t) for o, t in zip(out, types, strict=True)], ["core", "deal", "spread", "doc", "uid", "place", "piece"]
            )

    return rows.mapInArrow(read, "core bigint, deal int, spread boolean, doc bigint, uid bigint, place bigint, piece binary")


def later_windows(doc: np.ndarray, uid: np.ndarray, place: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Windows of blocks by suffix order: the block and start of each, whether an equal one is earlier, and where it lies."""
    lo, hi, _ = _unpacked(place)
    sizes = np.array([len(x) for x in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)  # what follows a piece is never compared
    begin = np.cumsum(sizes + 1) - sizes - 1
    count = hi - lo + 1
    block = np.repeat(np.arange(len(pieces)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = begin[block] + within
    ranks = suffix_ranks(data.astype(np.int64) + 1, length)
    order, same = equal_prefixes(data, starts, ranks, length)
    run = np.cumsum(~same) - 1
    block, at = block[order], starts[order]
    d, u, p = doc[block], uid[block], (lo[block] + at - begin[block])
    by = np.lexsort((p, u, d, run))
    head = by[np.r_[True, run[by][1:] != run[by][:-1]][: len(by)]][run] if len(by) else by
    later = (d != d[head]) | (u != u[head]) | (p != p[head])
    return block, p, later, head, at, data


def repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Rows (kind, a, b, doc, uid, start, stop): 0 a span that repeats, 1 the hash (a, b) of a window to be matched across tasks."""

    def work(rows: np.ndarray, spread: np.ndarray, text: list[bytes]) -> pa.RecordBatch:
        doc, uid, place = rows[:, 2], rows[:, 3], rows[:, 4]
        block, p, later, head, at, data = later_windows(doc, uid, place, text, length)
        by = np.lexsort((p, block))
        b, q = block[by][later[by]], p[by][later[by]]
        new = np.r_[True, (b[1:] != b[:-1]) | (q[1:] != q[:-1] + 1)][: len(b)]
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1][: new.sum()]
        kind, k0, k1 = [np.zeros(len(first), dtype=np.int64) for _ in range(3)]
        span = [doc[b[first]], uid[b[first]], q[first], q[last] + length]
        own = np.flatnonzero(spread[block] & ~later)
        windows = [data[i : i + length].tobytes() for i in at[own].tolist()]
        h0, h1 = (np.array([xxhash.xxh64_intdigest(w, seed) for w in windows], dtype=np.uint64).view(np.int64) for seed in (1, 2))
        more = [np.ones(len(own), dtype=np.int64), h0, h1, doc[block[own]], uid[block[own]], p[own], p[own] + length]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[x, y]) for x, y in zip((kind, k0, k1, *span), more, strict=True)], ["kind", "a", "b", "doc", "uid", "start", "stop"]
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4, 5)], axis=1)
            spread, text = b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(6).to_pylist()
            if not len(rows):
                continue
            new = np.flatnonzero(np.r_[not held or (held[-1][0][-1, :2] != rows[0, :2]).any(), (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            cuts = [0, *new[new > 0].tolist(), len(rows)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if size >= SORTED and (i > 0 or (len(new) and new[0] == 0)):  # a core begins here
                    yield work(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [t for x in held for t in x[2]])
                    held, size = [], 0
                held.append((rows[i:j], spread[i:j], text[i:j]))
                size += sum(map(len, text[i:j]))
        if held:
            yield work(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [t for x in held for t in x[2]])

    order = ["core", "deal"]
    return pieces.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        read, "kind bigint, a bigint, b bigint, doc bigint, uid bigint, start bigint, stop bigint"
    )


# Operators ----------------------------------------------------------------------------


def _marked_texts(docs: DataFrame, marked: DataFrame, bits: int) -> DataFrame:
    """``docs`` (doc, uid, text) whose uid may be among those of ``marked``: all that are, and few others."""
    may = bitmap(marked.select(F.col("uid").alias("key")), bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(2**bits - 1)
        for b in batches:
            low = b.column(1).to_numpy().view(np.uint64) & mask
            hit = may[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32) & np.uint32(1)
            yield b.filter(pa.array(hit.astype(bool)))

    return docs.mapInArrow(read, "doc bigint, uid bigint, text string")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    doc = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST))
    return docs.select(doc.alias("doc"), F.xxhash64(F.col(f"`{key}`"), whole).alias("uid"), whole.alias("text"))


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, span: int = SPAN,
    most_blocks: int = MOST_BLOCKS, bits: int = BITMAP_BITS,
) -> DataFrame:
    """Rows (doc, uid, start, stop) of byte spans that were there before; spans may touch and overlap.

    ``doc`` is the key as an integer, null keys last, and ``uid`` a hash of key and text.
    ``length`` must be at least ``span`` and the bytes of a place's hash.
    """
    if not GRAM <= length - span + 1 or not 0 < span < 200:
        raise ValueError("a window must hold the places of its anchor and the anchor's bytes")
    rows = _texts(docs, key, text)
    spark = docs.sparkSession
    path = new_path(spark, "blocks")
    found = sifted(all_blocks(rows, length, span))
    found.write.partitionBy("kind").parquet(path)
    found = spark.read.schema("core bigint, doc bigint, uid bigint, place bigint, kind int").parquet(path)
    lo, stop = F.shiftright("place", 16), F.expr(f"shiftright(place, 16) + (shiftright(place, 8) & 255) + {length}")
    whole = found.where("kind = 0").select("doc", "uid", lo.alias("start"), stop.alias("stop"))

    todo = found.where("kind = 1")
    # few cores are large: written first, they are broadcast where they are small, and no core is gathered for it
    large = written(todo.groupBy("core").count().where(F.col("count") > most_blocks).select(
        F.col("core").alias("large"), F.expr(f"cast((count + {most_blocks - 1}) div {most_blocks} as int)").alias("deals")
    ), "large-cores")
    dealt = todo.join(large, F.expr("core = large"), "left").select(
        "doc", "uid", F.struct(
            "core", F.when(F.col("deals") > 1, F.pmod(F.xxhash64("doc", "uid"), F.col("deals"))).otherwise(0).cast("int").alias("deal"),
            F.coalesce(F.col("deals") > 1, F.lit(False)).alias("spread"), "place",
        ).alias("block"),
    )
    lists = dealt.groupBy(F.col("doc").alias("d"), F.col("uid").alias("u")).agg(F.collect_list("block").alias("todo"))
    texts = _marked_texts(rows, todo, bits)
    pieces = _pieces(texts.join(lists, F.expr("uid = u and doc = d")).select("doc", "uid", "text", "todo"), length)
    path = new_path(spark, "repeats")
    repeats(pieces, length).write.partitionBy("kind").parquet(path)
    sorted_out = spark.read.schema("a bigint, b bigint, doc bigint, uid bigint, start bigint, stop bigint, kind bigint").parquet(path)
    across = sorted_out.where("kind = 1")
    least = across.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(
        F.min(F.struct("doc", "uid", "start")).alias("least"), F.count("*").alias("n")
    ).where("n > 1")
    crossing = across.join(least, F.expr("a = x and b = y")).where(F.struct("doc", "uid", "start") != F.col("least"))
    spans = ["doc", "uid", "start", "stop"]
    return whole.union(sorted_out.where("kind = 0").select(*spans)).union(crossing.select(*spans))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = BITMAP_BITS, **options) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256, kept), one for each input row.

    A null text counts as empty, and texts of fewer than ``length`` bytes lose nothing. Null
    keys come last; keys must be whole numbers. Rows of one key with different texts are
    texts of their own, in no fixed order; a row given twice is one text and gets one result
    twice. ``kept`` is what is left, as bytes, for texts that lost some, else null. An empty
    table gives an empty result.
    """
    spans = written(repeated_spans(docs, key, text, length, bits=bits, **options), "spans")
    rows = _texts(docs, key, text)
    lists = spans.groupBy(F.col("doc").alias("d"), F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = _cut(_marked_texts(rows, spans, bits).dropDuplicates(["uid", "doc"]).join(lists, F.expr("uid = u and doc = d")).select("doc", "uid", "text", "spans"))
    cut = cut.select(*[F.col(c).alias(f"c_{c}") for c in cut.columns])
    base = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("uid"),
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint").alias("n_bytes"),
        F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("sha"),
    )
    return base.join(cut, F.expr("uid = c_uid and doc = c_doc"), "left").select(
        F.col("id").alias(key), "n_bytes", F.coalesce("c_n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("c_n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("c_kept_sha256", "sha").alias("kept_sha256"),
        F.col("c_kept").alias("kept"),
    )


def _cut(rows: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, sha, left = [], [], [], []
            for t, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, n, k, end, kept = t.encode(), 0, 0, 0, []
                for start, stop in sorted((x["start"], x["stop"]) for x in spans):
                    if start > end or not k:
                        kept.append(raw[end:start])
                        k += 1
                        n += stop - start
                        end = stop
                    elif stop > end:
                        n += stop - end
                        end = stop
                kept.append(raw[end:])
                left.append(b"".join(kept))
                removed.append(n)
                runs.append(k)
                sha.append(hashlib.sha256(left[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())],
                ["doc", "uid", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.mapInArrow(read, "doc bigint, uid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def sql(length: int = LENGTH) -> str:
    """The result for ``documents`` by looking every window up among all, for texts in hexadecimal."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (
        SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * length})) AS s
        FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - {length - 1}, 0))) AS p FROM d)
    ),
    f AS (SELECT s, min(doc_id * 4294967296 + p) AS first FROM w GROUP BY s),
    later AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.s = w.s WHERE w.doc_id * 4294967296 + w.p > f.first),
    cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS new FROM later),
    runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
    spans AS (SELECT doc_id, run, min(p) AS a, max(p) + {length} AS b FROM runs GROUP BY doc_id, run),
    k AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY a) AS l, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN l IS NULL THEN h ELSE substr(h, 1, 2 * l[1].a) || array_to_string(list_transform(range(1, len(l) + 1),
            lambda i: substr(h, 2 * l[i].b + 1, 2 * (CASE WHEN i < len(l) THEN l[i + 1].a ELSE len(h) // 2 END - l[i].b))), '') END)) AS kept_sha256
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id
    """
