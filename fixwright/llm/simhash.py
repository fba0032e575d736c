"""Near-duplicates by SimHash, compared with bit planes.

A text's fingerprint sums up the hashes of its word shingles bit by bit. Two
fingerprints are linked when they differ in at most ``radius`` bits, and linked texts
form components.

Only fingerprints that can be linked meet, under one of two kinds of keys:

* ``bands``: the 64 bits are cut into bands, and every choice of bands that ``radius``
  changed bits must leave untouched is a key. This loses no link.
* ``minima``: each of a number of keys is made of smallest shingle hashes. Texts that
  share four in five of their shingles share such a key but for a few in ten thousand;
  it serves radii that are too wide for bands.

Fingerprints under one key are compared with the bit planes of up to 64 others at once:
plane by plane the differing lanes are added to bitwise carry-save counters, which start
so that they overflow just when a lane is beyond the radius, and a block whose lanes have
all overflowed is abandoned.

Equal fingerprints are one row before anything is compared. A key with many fingerprints
is cut into chunks, and pairs of chunks are compared in tiles of bounded size that any
task can take. A tile gives a spanning forest of its links, not all its pairs. Where links
are to be held against the texts, the closest forests are held first; then each tile whose
rows have links left between different components gets its texts' shingle sets, and all
those links are tried, batch by batch, but for the ones whose ends a tried link has joined.
Components come from rounds of large-star and small-star joins over tables written to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

SEED = 42
CHUNK = 1024  # fingerprints of a key that one side of a tile holds
UNITS = 32_768  # blocks of 64 lanes compared in one go
PAIRS = 4 * CHUNK * CHUNK  # pairs of rows whose links are held at once
ROUNDS = 3  # forests of each tile that are held against the texts before all links left are
HELD = 8 << 20  # shingles of texts that one side of a tile holds
TRIED = 4 << 20  # shingles of texts looked up at once
SKETCH = 128  # smallest shingle hashes of a text by which its links are then ordered
SLACK = 0.15  # by how much an estimate from sketches may fall short, some four standard errors
MINIMA = (10, 2)  # keys, and smallest hashes in each


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles of a text, repeats included; a text with fewer words is one shingle, one with none has none."""
    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(s) for s in zip(*(w[i:] for i in range(words)), strict=False)]


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in parts]), ">u8").astype("<u8")


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes; no hashes give zero."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(h: np.ndarray, keys: int, each: int) -> list[int]:
    """Keys made of the smallest hashes under several orders of the shingles."""
    if not len(h):
        return []
    by, add = _mixers(keys * each)
    least = np.array([((h ^ a) * m).min() for m, a in zip(by, add, strict=True)], dtype="<u8").reshape(keys, each)
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes(), SEED) - 2**63 for i, row in enumerate(least)]


def sketch(h: np.ndarray) -> bytes:
    """The smallest distinct hashes of a text, cut to 32 bits and sorted; padded with the largest number."""
    out = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    least = np.unique((h >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    out[: len(least)] = least
    return out.tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common shingles by sketches, a pair a row: what is common among the smallest hashes of both together."""
    pad = np.uint32(0xFFFFFFFF)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != pad
    new = np.concatenate([real[:, :1], (both[:, 1:] != both[:, :-1]) & real[:, 1:]], axis=1)
    within = np.cumsum(new, axis=1) <= SKETCH
    common = ((both[:, 1:] == both[:, :-1]) & real[:, 1:] & within[:, 1:]).sum(axis=1)
    return common / np.maximum((new & within).sum(axis=1), 1)


def fingerprints(docs: DataFrame, key: str, text: str, words: int, keys: tuple[int, int] | None, distinct: bool = False) -> DataFrame:
    """Rows (id, th, fp, keys, sketch): the key, a hash of the text, the fingerprint, and if asked for its minima and sketch.

    With ``distinct`` repeated shingles count once in the fingerprint.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, more, sketches = [], [], []
            for t in b.column(2):
                h = hashes(shingles(t.as_py(), words))
                fp.append(fingerprint(np.unique(h) if distinct else h))
                more.append(minima(h, *keys) if keys else [])
                sketches.append(sketch(h) if keys else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["id", "th", "fp", "keys", "sketch"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, th bigint, fp bigint, keys array<bigint>, sketch binary")


def band_keys(fp: Column, radius: int, bands: int) -> Column:
    """All keys of a fingerprint: what is left of it when ``radius`` bands are left out."""
    if not radius < bands <= 64:
        raise ValueError("there must be more bands than bits that may differ, and no more than 64")
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    kept = [sum(masks[i] for i in pick) for pick in combinations(range(bands), bands - radius)]
    signed = [m - 2**64 if m >= 2**63 else m for m in kept]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def tiles(candidates: DataFrame, chunk: int = CHUNK, weight: Column | None = None) -> DataFrame:
    """Rows (key, a, b, side, fp): every fingerprint in each tile of its key that it takes part in.

    ``candidates`` has distinct rows (key, fp). A key's fingerprints fall into chunks, of
    about ``chunk`` rows or of that ``weight``; tile (a, b) holds chunks a and b, side 0 and 1.
    """
    shared = candidates.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.lit(1) if weight is None else weight).alias("all")).where("n > 1")
    parts = shared.select(F.col("key").alias("k"), F.expr(f"cast(greatest(1, (all + {chunk - 1}) div {chunk}) as int)").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    spread = candidates.join(parts, F.expr("key = k")).withColumn("own", own)
    return spread.select("key", "fp", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")).select(
        "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )


def linked_lanes(query: np.ndarray, block: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which lanes of which blocks lie within the radius, and how far away.

    Unit ``u`` compares fingerprint ``query[u]`` with block ``block[u]``; ``planes[p, k]``
    holds bit ``p`` of the 64 lanes of block ``k`` and ``valid[k]`` the lanes in use.
    Returns the units that were not abandoned, their linked lanes as bits, and the bits of
    each lane's distance, least first, plus ``2 ** bits - 1 - radius``.
    """
    depth = radius.bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = (1 << depth) - 1 - radius
    at = np.arange(len(query))
    counters = [np.full(len(query), full if start >> i & 1 else 0, dtype=np.uint64) for i in range(depth)]
    over = ~valid[block]
    for p in range(64):
        bit = (query >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][block] ^ (np.uint64(0) - bit)
        for i in range(depth):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 8 == 7:
            live = over != full
            if not live.all():
                at, query, block, over = at[live], query[live], block[live], over[live]
                counters = [c[live] for c in counters]
    return at, ~over, counters


def linked(
    group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, sketches: np.ndarray | None = None, least: float = 0.0,
    root: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links within each group as rows (left, right, how far), in batches of bounded size; rows come sorted by group, then side.

    With ``sketches`` links estimated below ``least`` are left out and the distance is by
    estimated similarity. Rows of the same ``root`` are not linked.

    In a group with both sides only links across are looked for, as other tiles have the rest.
    """
    n = len(fp)
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    sizes = np.diff(np.r_[cut, n])
    run = np.repeat(np.arange(len(cut)), sizes)  # rows of one side of one group
    words = -(-sizes // 64)
    first = np.r_[0, np.cumsum(words)]
    within = np.arange(n) - np.repeat(cut, sizes)
    word, lane = first[run] + within // 64, (within % 64).astype(np.uint64)
    planes = np.zeros((64, first[-1]), dtype=np.uint64)
    for p in range(64):
        np.bitwise_or.at(planes[p], word, ((fp >> np.uint64(p)) & np.uint64(1)) << lane)
    valid = np.zeros(first[-1], dtype=np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << lane)
    row_of = np.zeros(first[-1] * 64, dtype=np.int64)
    row_of[word * 64 + lane.astype(np.int64)] = np.arange(n)

    paired = np.r_[group[cut][1:] == group[cut][:-1], False]  # side 0 with side 1 after it
    alone = ~paired & ~np.r_[False, paired[:-1]] & (side[cut] == 0)
    target = np.where(paired, np.arange(len(cut)) + 1, np.where(alone, np.arange(len(cut)), -1))
    asks = np.flatnonzero(target[run] >= 0)
    per = words[target[run[asks]]]
    ends = np.cumsum(per)
    begin = 0
    while begin < len(asks):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + UNITS, side="right")))
        some, count = asks[begin:stop], per[begin:stop]
        who = np.repeat(some, count)
        block = np.repeat(first[target[run[some]]], count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        units, lanes, counters = linked_lanes(fp[who], block, planes, valid, radius)
        u, at = np.nonzero(_lanes(lanes))
        left, right = who[units[u]], row_of[block[units[u]] * 64 + at]
        far = sum((_lanes(c)[u, at].astype(np.int8) << i for i, c in enumerate(counters)), np.zeros(len(u), dtype=np.int8))
        new = (left < right) | (run[left] != run[right])
        if root is not None:
            new &= root[left] != root[right]
        left, right, far = left[new], right[new], far[new]
        if sketches is not None:
            cuts = range(0, len(left), 8192)
            alike = np.concatenate([np.zeros(0), *(estimated(sketches[left[i : i + 8192]], sketches[right[i : i + 8192]]) for i in cuts)])
            near = alike >= least
            left, right, far = left[near], right[near], np.round((1 - alike[near]) * SKETCH).astype(np.int8)
        yield left, right, far
        begin = stop


def forest(
    group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, rounds: int = 1,
    sketches: np.ndarray | None = None, least: float = 0.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, closest first, all ``linked`` rows of each group.

    Each further round gives such a forest of the links that the rounds before have left.
    """
    a, b, _ = forests(linked(group, side, fp, radius, sketches, least), len(fp), rounds)
    return fp[a], fp[b]


def forests(links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of ``rounds`` forests over ``n`` rows, and the rows that have further links."""
    none = np.zeros(0, dtype=np.int64)
    left, right, far = (np.concatenate(x) for x in zip((none, none, none), *links, strict=True))
    kept = [(none, none)]
    for _ in range(rounds):
        label, used = np.arange(n), np.zeros(len(far), dtype=bool)
        for step in np.unique(far):
            here = np.flatnonzero(far == step)
            used[here[_unite(label, left[here], right[here])]] = True
        kept.append((left[used], right[used]))
        left, right, far = left[~used], right[~used], far[~used]
    a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
    return a, b, np.union1d(left, right)


def proven(
    links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], root: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: np.ndarray, least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows whose sets share ``least`` of their elements; row ``i`` has the set ``parts[begin[i] :][: size[i]]``.

    Every link is tried unless its ends have the same root or are joined by links tried before.
    """
    kept = [(begin[:0], begin[:0])]
    label = np.unique(root, return_index=True, return_inverse=True)
    label = label[1][label[2]]
    parts = np.unique(parts, return_inverse=True)[1]
    marked = np.zeros(len(parts), dtype=bool)
    for left, right, far in links:
        order = np.lexsort((left, far))
        left, right = left[order], right[order]
        while len(left):
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
            some = max(1, int(np.searchsorted(np.cumsum(size[right]), TRIED, side="right")))
            a, b = left[:some], right[:some]
            left, right = left[some:], right[some:]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            alike = np.zeros(len(a), dtype=bool)
            edge = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
            for i, j in zip(edge, edge[1:], strict=False):
                own, n = parts[begin[a[i]] :][: size[a[i]]], size[b[i:j]]
                at = np.cumsum(n) - n
                marked[own] = True
                among = marked[parts[np.repeat(begin[b[i:j]] - at, n) + np.arange(n.sum())]]
                marked[own] = False
                common = np.diff(np.r_[0, np.cumsum(among)][np.r_[at, n.sum()]])
                alike[i:j] = common >= least * (size[a[i]] + n - common)
            a, b = a[alike], b[alike]
            new = _unite(label, a, b)
            kept.append((a[new], b[new]))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge label trees over the pairs, in place, and return which pairs merged two.

    A label is the smallest row of its tree.
    """
    at, used = np.arange(len(left)), [np.zeros(0, dtype=np.int64)]
    while len(at):
        a, b = label[left[at]], label[right[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        pick = order[np.r_[True, high[order][1:] != high[order][:-1]][: len(order)]]  # one merge for each larger root
        label[high[pick]] = low[pick]
        used.append(at[pick])
        while (label != label[label]).any():
            label[:] = label[label]
    return np.concatenate(used)


def _in_tiles(tiled: DataFrame, search: Callable[[np.ndarray, np.ndarray, pa.Table], pa.RecordBatch], kind: str) -> DataFrame:
    """What ``search(group, rows, table)`` finds in whole tiles, few pairs at a time; ``rows`` are (key, a, b, side, fp)."""

    def numbers(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([c.to_numpy(**({} if isinstance(b, pa.Table) else {"zero_copy_only": False})).astype(np.int64) for c in b.columns[:5]], axis=1)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        rows = numbers(table)
        new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(rows)])
        part = np.repeat(np.cumsum(sizes * sizes) // PAIRS, sizes)  # whole tiles, few pairs at a time
        group, cuts = np.cumsum(new), np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield search(group[i:j], rows[i:j], table.slice(i, j - i).combine_chunks())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = numbers(b)
            other = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            if held and (last == rows[-1, :3]).all() and not len(other):
                held.append(b)  # still the same tile, which is of bounded size
                continue
            begin = int(other[-1]) + 1 if len(other) else 0
            if held or begin:
                yield from whole([*held, b.slice(0, begin)])
            held, last = [b.slice(begin)], rows[-1, :3]
        if held:
            yield from whole(held)

    order = ["key", "a", "b"]
    return tiled.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(read, kind)


def _sketches(t: pa.Table) -> np.ndarray | None:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(t.num_rows, SKETCH) if "sketch" in t.column_names else None


def searched(tiled: DataFrame, radius: int, rounds: int = 1, least: float = 0.0) -> DataFrame:
    """Rows (u, v, key): links of ``rounds`` forests of each tile, and without ``v`` the rows that have further links in the tile.

    Tiles may carry each fingerprint's ``sketch``, to be ordered by it, and its ``root``;
    then only fingerprints of different roots are linked. ``key`` stands for the tile.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64())])

    def search(group: np.ndarray, rows: np.ndarray, t: pa.Table) -> pa.RecordBatch:
        fp = np.ascontiguousarray(rows[:, 4])
        root = t.column("root").to_numpy() if "root" in t.column_names else None
        a, b, more = forests(linked(group, rows[:, 3], fp.view(np.uint64), radius, _sketches(t), least, root), len(fp), rounds)
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        tile = np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) - 2**63 for r in rows[begin, :3]], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[fp[a], fp[more]]), pa.array(np.r_[fp[b], fp[more]], mask=np.arange(len(a) + len(more)) >= len(a)),
             pa.array(np.r_[np.zeros(len(a), dtype=np.int64), tile[group[more] - group[0]]])], schema=schema,
        )

    return _in_tiles(tiled, search, "u bigint, v bigint, key bigint")


def compared(tiled: DataFrame, radius: int, rounds: int = 1, least: float = 0.0) -> DataFrame:
    """Linked fingerprints (u, v): enough links to join all that are linked within each tile, the closest first."""
    return searched(tiled, radius, rounds, least).where("v is not null").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge, the root being the smallest node of its component."""
    edges, seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, or to the node itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "n"))
    return both.where("v > u").join(least, F.expr("u = n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    up = edges.join(least, F.expr("u = n")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    radius: int = 3,
    bands: int = 5,
    keys: tuple[int, int] | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """Rows (id, th, fp, first, first_th): a row for each input row with its component's first row.

    ``id`` is the key, ``th`` a hash of the text, ``fp`` the fingerprint; ``first`` and
    ``first_th`` belong to the component's row with the smallest key, null keys last.
    With ``keys`` the minima find candidates, else bands do. With ``similarity`` a link also
    needs that share of the two texts' distinct shingles to be common to both, and ``fp`` is
    that of the distinct shingles. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows stay repeated. An empty
    table gives an empty result. Only the two named columns are read.
    """
    # columns that are all null would still count when the planner guesses how large the others are
    unused = [] if keys else ["keys", "sketch"]
    rows = written(fingerprints(docs, key, text, words, keys, distinct=similarity is not None).drop(*unused), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    classes = written(rows.groupBy("fp").agg(least.alias("first"), *[F.max("sketch").alias("sketch")] * bool(keys)), "classes")
    if keys:
        candidates = rows.select(F.explode("keys").alias("key"), "fp").distinct()
    else:
        candidates = classes.select(F.explode(band_keys(F.col("fp"), radius, bands)).alias("key"), "fp")
    # written first: a table that is exploded counts as it was before, and would be broadcast through the driver
    tiled = tiles(written(candidates, "candidates"))
    if similarity is None:
        edges = written(compared(tiled, radius), "links")
    else:
        sketched = written(tiled, "tiles").join(classes.select(F.col("fp").alias("f"), "sketch"), F.expr("fp = f")).drop("f")
        found = written(searched(sketched, radius, ROUNDS, similarity - SLACK), "links")
        edges = found.where("v is not null").select("u", "v").distinct()
        edges = written(similar(edges, classes, docs, key, text, words, similarity), "similar")
        left = found.where("v is null").select("key", F.col("u").alias("fp"))
        more = written(left_over(left, components(edges), classes, docs, key, text, words, radius, similarity), "left-over")
        edges = edges.union(more)
    roots = components(edges)
    classes = classes.select("fp", "first")
    tied = written(roots.join(classes, F.expr("node = fp")).select("fp", "root", "first"), "tied")
    firsts = tied.groupBy("root").agg(F.min("first").alias("least"))
    moved = tied.join(firsts, "root").select(F.col("fp").alias("f"), "least")
    # written first: then both sides of the last join are plain shuffles, and a fingerprint of very many copies can be split
    of = written(classes.join(moved, F.expr("fp = f"), "left").select(
        F.col("fp").alias("c"), F.coalesce("least", "first").alias("first")
    ), "first-of-class")
    return rows.join(of, F.expr("fp = c")).select(
        "id", "th", "fp", F.col("first.id").alias("first"), F.col("first.th").alias("first_th")
    )


def shingle_sets(ends: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows (fp, parts) of the fingerprints ``e``: hashes of the distinct shingles, one text standing for each fingerprint."""
    wanted = classes.join(ends, F.expr("fp = e")).select("fp", _id_text(F.col("first.id")).alias("i"), F.col("first.th").alias("t"))
    texts = docs.select(
        _id_text(F.col(f"`{key}`")).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text")
    ).join(wanted, F.expr("id = i and th = t")).select("fp", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(hashes(shingles(t.as_py(), words)).astype(np.uint32).view(np.int32)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["fp", "parts"])

    return written(texts.mapInArrow(read, "fp bigint, parts array<int>").dropDuplicates(["fp"]), "shingle-sets")


def similar(edges: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, least: float) -> DataFrame:
    """The links whose texts share enough of their distinct shingles."""
    sets = shingle_sets(edges.select(F.col("u").alias("e")).union(edges.select("v")).distinct(), classes, docs, key, text, words)
    both = (
        edges.join(sets.select(F.col("fp").alias("u"), F.col("parts").alias("left")), "u")
        .join(sets.select(F.col("fp").alias("v"), F.col("parts").alias("right")), "v")
        .withColumn("common", F.size(F.array_intersect("left", "right")))
    )
    return both.where(F.col("common") >= least * (F.size("left") + F.size("right") - F.col("common"))).select("u", "v")


def left_over(
    left: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, radius: int, least: float,
) -> DataFrame:
    """Links (u, v) that join what is similar enough among the rows (key, fp) of tiles, but for what ``roots`` have joined."""
    known = written(classes.join(roots.withColumnRenamed("root", "r"), F.expr("fp = node"), "left").select(
        F.col("fp").alias("f"), F.coalesce("r", "fp").alias("root"), "sketch"
    ), "roots")
    open_ = left.distinct().join(known.select("f", "root"), F.expr("fp = f")).select("key", "fp", "root")
    mixed = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("key").alias("k"))
    open_ = written(open_.join(mixed, F.expr("key = k")).select("key", "fp"), "open")
    sketched = written(tiles(open_), "open-tiles").join(known, F.expr("fp = f")).drop("f")
    open_ = written(searched(sketched, radius, 0, least - SLACK).select("key", F.col("u").alias("fp")).distinct(), "open")
    sets = shingle_sets(open_.select(F.col("fp").alias("e")).distinct(), classes, docs, key, text, words)
    sized = open_.join(sets.select(F.col("fp").alias("f"), F.size("parts").alias("n")), F.expr("fp = f")).drop("f")
    given = known.join(sets, F.expr("f = fp")).select("f", "root", "sketch", "parts")
    full = written(tiles(sized, HELD, F.col("n")), "open-tiles").join(given, F.expr("fp = f")).drop("f")

    def search(group: np.ndarray, rows: np.ndarray, t: pa.Table) -> pa.RecordBatch:
        fp, root = np.ascontiguousarray(rows[:, 4]), t.column("root").to_numpy()
        size = pc.list_value_length(t.column("parts")).to_numpy().astype(np.int64)
        parts = pc.list_flatten(t.column("parts")).to_numpy()
        links = linked(group, rows[:, 3], fp.view(np.uint64), radius, _sketches(t), least - SLACK, root)
        a, b = proven(links, root, np.cumsum(size) - size, size, parts, least)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

    return _in_tiles(full, search, "u bigint, v bigint").distinct()


def _id_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key. Of repeated rows one stays."""
    found = near_duplicates(docs, key, text, **options)
    stays = found.where("id <=> first and th <=> first_th").select(_id_text(F.col("id")).alias("__a"), F.col("th").alias("__b")).distinct()
    hashed = docs.withColumns({"__i": _id_text(F.col(f"`{key}`")), "__t": F.xxhash64(F.col(f"`{text}`"))})
    numbered = hashed.withColumn("__n", F.row_number().over(Window.partitionBy("__i", "__t").orderBy(F.lit(0))))
    return (
        numbered.where("__n = 1").join(stays, F.expr("__i = __a and __t = __b"), "left_semi")
        .select(*[f"`{c}`" for c in docs.columns])
    )


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
