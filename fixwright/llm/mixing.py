"""Interleaving sources to target weights by Pfair scheduling.

Every source's documents are dealt in blocks of ``block_rows``. With integer weights
``w`` that add up to ``D``, the ``j``-th block (from 0) of a source is released at slot
``j * D / w`` rounded down and due by ``(j + 1) * D / w`` rounded up. Slot by slot the
released block with the earliest deadline goes next. Since the windows come from the
ideal fluid shares, every block meets its deadline, and after any number of slots a
source is less than one block away from its share.

The pattern repeats every ``D`` slots, so one period is scheduled and any block's slot
follows from its number: no task walks the whole sequence. When a source runs dry its
weight goes to the others in proportion, and a new phase with its own period begins at
the next slot. Nothing is dropped or repeated: every row has its slot.

Only the sources with their row counts come to the driver, at most ``MOST_SOURCES`` of
them, and the periods, at most ``MOST_SOURCES`` of ``resolution`` slots and more, go out.
Rows of a source are numbered in the order of a hash of their key, in 4096 hash ranges
counted beforehand, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, shadowed

BLOCK_ROWS = 16
RESOLUTION = 1000
POWER = 0.5
MOST_SOURCES = 500
RANGE_BITS = 12
ADDED = ("block", "slot", "place")


def tempered(rows: Mapping[str, int], power: float = POWER, resolution: int = RESOLUTION) -> dict[str, int]:
    """Weights in proportion to a power of each source's rows, in parts of ``resolution``, at least one."""
    total = sum(n**power for n in rows.values())
    return {s: max(1, math.floor(resolution * n**power / total + 0.5)) for s, n in rows.items()}


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period of ``sum(weights)`` slots."""
    length = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in sorted(weights)}
    for t in range(length):
        released = [s for s, got in slots.items() if len(got) < weights[s] and len(got) * length // weights[s] <= t]
        slots[min(released, key=lambda s: (-(-(len(slots[s]) + 1) * length // weights[s]), s))].append(t)
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """Rows (source, first block, blocks, first slot, period length, slots within a period), a row for each phase and source."""
    left = {s: n for s, n in blocks.items() if n}
    start, out = 0, []
    while left:
        slots = period({s: weights[s] for s in left})
        length = sum(len(x) for x in slots.values())
        end = 1 + min((n - 1) // len(slots[s]) * length + slots[s][(n - 1) % len(slots[s])] for s, n in left.items())
        for s in list(left):
            n = end // length * len(slots[s]) + sum(x < end % length for x in slots[s])
            if n:
                out.append((s, blocks[s] - left[s], n, start, length, slots[s]))
            left[s] -= n
            if not left[s]:
                del left[s]
        start += end
    return out


def mix(
    docs: DataFrame,
    weights: Mapping[str, int] | None = None,
    block_rows: int = BLOCK_ROWS,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Every row with the ``block`` it is in, the block's ``slot`` and its ``place`` in the block.

    ``weights`` are positive integers by source; without them they are ``tempered``.
    Sources that they leave out follow after the named ones have run dry, in equal shares.
    A null source counts as the source named by the empty text, a null key as an empty
    key. Repeated keys take neighbouring places, in no fixed order. An empty table gives
    an empty result. Input columns called block, slot or place are replaced.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    counted = {r[0]: r[1] for r in docs.groupBy(name.alias("s")).count().limit(MOST_SOURCES + 1).collect()}
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = tempered(counted) if weights is None else dict(weights)
    blocks = {s: -(-n // block_rows) for s, n in counted.items()}
    named = phases({s: n for s, n in blocks.items() if weights.get(s, 0) > 0}, weights)
    after = sum(n for s, n in blocks.items() if weights.get(s, 0) > 0)
    rest = {s: n for s, n in blocks.items() if weights.get(s, 0) <= 0}
    rows = named + [(s, b, n, at + after, d, x) for s, b, n, at, d, x in phases(rest, dict.fromkeys(rest, 1))]
    plan = spark.createDataFrame(rows, "s string, first bigint, n bigint, start bigint, length bigint, slots array<int>")

    numbered = _numbered(docs, name, F.col(f"`{key}`"))
    dealt = (
        numbered.withColumn("__block", F.expr(f"__number div {block_rows}"))
        .join(
            F.broadcast(plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns])),
            F.expr("__s = __p_s and __block >= __p_first and __block < __p_first + __p_n"),
        )
        .withColumn("__slot", F.expr(
            "__p_start + ((__block - __p_first) div size(__p_slots)) * __p_length"
            " + __p_slots[cast((__block - __p_first) % size(__p_slots) as int)]"
        ))
        .withColumn("__place", F.col("__number") % block_rows)
    )
    kept = shadowed(docs, *ADDED).columns
    return dealt.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__{c}").alias(c) for c in ADDED])


def _numbered(docs: DataFrame, name: Column, key: Column) -> DataFrame:
    """``docs`` with ``__s`` and ``__number``, from 0 within a source in hash order."""
    order = hash60(key)
    ranged = docs.withColumns({"__s": name, "__h": order, "__r": F.shiftright(order, 60 - RANGE_BITS)})
    counts = (
        docs.select(name.alias("__cs"), F.shiftright(order, 60 - RANGE_BITS).alias("__cr")).groupBy("__cs", "__cr").count()
    )
    before = counts.select(
        "__cs", "__cr",
        (F.sum("count").over(Window.partitionBy("__cs").orderBy("__cr")) - F.col("count")).alias("__before"),
    )
    here = Window.partitionBy("__s", "__r").orderBy("__h", key)
    return (
        ranged.withColumn("__rn", F.row_number().over(here))
        .join(before, F.expr("__s = __cs and __r = __cr"))
        .withColumn("__number", F.expr("__before + __rn - 1"))
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` sorted into the mixed sequence: part files read by name, rows in file order, follow it."""
    mixed = mix(docs.withColumn("__kept", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), **options)
    return mixed.orderBy("slot", "place").select("__kept.*")


def sql() -> str:
    """The schedule of ``documents`` simulated slot by slot."""
    return f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(source, '') AS source,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
        FROM documents
    ),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS number FROM d),
    c AS (SELECT source, count(*) AS n FROM d GROUP BY source),
    w AS (
        SELECT source, (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks,
            greatest(1, CAST(floor({RESOLUTION} * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) + 0.5) AS BIGINT)) AS w
        FROM c
    ),
    l AS (SELECT list(source ORDER BY source) AS s, list(blocks ORDER BY source) AS b, list(w ORDER BY source) AS w FROM w),
    st AS (
        SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, list_transform(b, lambda x: CAST(0 AS BIGINT)) AS done, b AS rest,
            CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block
        FROM l
        UNION ALL
        SELECT slot + 1, CASE WHEN rest[p] = 1 THEN 0 ELSE t + 1 END,
            list_transform(done, lambda x, i: CASE WHEN rest[p] = 1 THEN 0 WHEN i = p THEN x + 1 ELSE x END),
            list_transform(rest, lambda x, i: CASE WHEN i = p THEN x - 1 ELSE x END), p, b[p] - rest[p]
        FROM (
            SELECT *, CAST(list_min(list_transform(
                list_filter(range(1, len(s) + 1), lambda i: rest[i] > 0 AND done[i] * total // w[i] <= t),
                lambda i: ((done[i] + 1) * total + w[i] - 1) // w[i] * 1000 + i)) % 1000 AS BIGINT) AS p
            FROM (
                SELECT st.*, l.*, CAST(list_sum(list_transform(w, lambda x, i: CASE WHEN rest[i] > 0 THEN x ELSE 0 END)) AS BIGINT) AS total
                FROM st, l WHERE list_sum(rest) > 0
            )
        )
    )
    SELECT doc_id, n.source, CAST(number // {BLOCK_ROWS} AS BIGINT) AS block, slot, CAST(number % {BLOCK_ROWS} AS BIGINT) AS place
    FROM numbered n, l, st
    WHERE st.pick > 0 AND s[st.pick] = n.source AND st.block = number // {BLOCK_ROWS}
    """
