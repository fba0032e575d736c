"""Placing documents on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size:
it starts at an offset and walks with a step, both hashed from the shard's name, and
since the size is prime each step visits every slot. The shards take turns; at its
turn a shard claims the first slot in its order that is still free. The filled table
gives every shard the same number of slots, give or take one, and when a shard joins
or leaves few of the other slots change hands. A row is placed by one look-up:
hash of its key modulo the size, then the slot's shard.

The table has ``size`` rows, whatever the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash60, shadowed

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SIZE = 65_537  # prime, about a thousand slots for each of 64 shards
LARGEST = 1_000_003  # the bound on what is broadcast


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=8)
def filled(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> tuple[int, ...]:
    """For each slot the index of the shard that claimed it."""
    if not _prime(size) or size > LARGEST:
        raise ValueError(f"the table's size must be a prime up to {LARGEST}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than there are slots")
    place = [_hash(f"{s}/offset") % size for s in shards]
    step = [_hash(f"{s}/step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + step[i]) % size
        owner[place[i]] = i
    return tuple(owner)


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = filled(tuple(shards), size)
    return spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owners)], "slot bigint, shard string")


def place(rows: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """Every row with its ``slot`` and ``shard``.

    Rows with the same key land on the same shard; a null key is placed as the empty
    text. Input columns called slot or shard are replaced. No row is moved: this is a
    look-up in a broadcast table, with no shuffle.
    """
    slot = F.pmod(hash60(F.col(f"`{key}`")), F.lit(size))
    keyed = shadowed(rows.withColumn("__slot", slot), "slot", "shard").withColumnRenamed("__slot", "slot")
    return keyed.join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot").select(
        *[f"`{c}`" for c in keyed.columns if c != "slot"], "slot", "shard"
    )


def sql() -> str:
    """The placement of ``documents`` in SQL, the filled table given as a list."""
    owners = ",".join(map(str, filled()))
    return f"""
    WITH t AS (SELECT [{owners}] AS owner),
    d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS slot FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t
    """
