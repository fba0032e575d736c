"""Small pieces that the operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(key: Column) -> Column:
    """A number below 2**60 taken from the MD5 of a key's text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, mod: int) -> Column:
    """Whether the CRC-32 of the id's text is divisible by ``mod``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod) == 0


def lowest_hashes(keys: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` of the rows, the ones whose keys hash lowest; all of them if there are no more.

    The bound on the hash comes from the row count, so nothing is sorted or gathered.
    """
    n = keys.count()
    return keys if n <= most else keys.where(hash60(F.col(f"`{key}`")) < int(2**60 * most / n))


def shadowed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns (in any case) that an operator is about to add under these names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which values the lowest ``bits`` bits of the keys take: ``2 ** bits`` bits, at most as many words to the driver."""
    low = F.col("key").bitwiseAND(F.lit(2**bits - 1))
    lows = keys.select(low.alias("low"))
    words = lows.groupBy(F.expr("low div 32 as word")).agg(F.expr("bit_or(shiftleft(cast(1 as bigint), cast(low % 32 as int)))").alias("ones"))
    found = words.toArrow()
    out = np.zeros(2**bits // 32, dtype=np.uint32)
    out[found["word"].to_numpy()] = found["ones"].to_numpy().astype(np.uint32)
    return out
