"""Committed-use terms and dated ladder readings on file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LADDER_READING
from .commits import names
from .staging import written

TERMS = "vendor string, tenor_years double, price_ratio double, source_url string, as_of date, note string"


def read_terms(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Term points from JSON: one array, or a record a line."""
    return spark.read.schema(TERMS).json(path, multiLine=not lines)


def write_reading(curve: DataFrame, root: str, read_at: str, open_span: float) -> str:
    """Put one dated reading of all ladders on file, withheld ones included; a date's reading is never touched again.

    A reading has a handful of ladders, which its record holds together.
    """
    ladder = F.struct(*[F.col(c) if c in curve.columns else F.lit(None).alias(c) for c in (
        "tenor", "settles", "source_index", "expected", "dispersion", "book_sum", "tail_mass", "volume", "withheld", "refusals")])
    record = curve.select(ladder.alias("ladder")).agg(F.collect_list("ladder").alias("ladders"))
    path = f"{root}/implied/{read_at[:10]}"
    record.select(F.lit(read_at).alias("read_at"), F.lit(open_span).alias("open_span"), "ladders").write.mode("errorifexists").json(path)
    return path


def write_readings(curves: DataFrame, root: str) -> None:
    """Put many dated readings on file at once: curves with ``read_at`` and ``open_span``, one reading for each day.

    A day that is on file already, or that two moments claim, stops the whole write.
    """
    spark, fields = curves.sparkSession, ("tenor", "settles", "source_index", "expected", "dispersion", "book_sum", "tail_mass", "volume", "withheld", "refusals")
    ladder = F.struct(*[F.col(c) if c in curves.columns else F.lit(None).alias(c) for c in fields])
    day = F.substring("read_at", 1, 10).alias("day")
    records = written(curves.groupBy(day, "read_at", "open_span").agg(F.array_sort(F.collect_list(ladder)).alias("ladders")), "readings")
    days = records.agg(F.count("day").alias("n"), F.count_distinct("day").alias("days")).first()
    if days.n != days.days:
        raise ValueError("a day has more than one reading")
    there = {n.removeprefix("day=") for n in names(spark, f"{root}/implied")}
    taken = there.intersection(r.day for r in records.select("day").collect())  # calendar days, not rows
    if taken:
        raise FileExistsError(f"readings exist for {', '.join(sorted(taken))}")
    records.hint("rebalance", "day").write.mode("append").partitionBy("day").json(f"{root}/implied")


def read_readings(spark: SparkSession, root: str) -> DataFrame:
    """Every dated reading, one row for each."""
    return spark.read.schema(LADDER_READING).json(f"{root}/implied/*")


def newest_ladders(readings: DataFrame) -> DataFrame:
    """Ladders of the newest reading."""
    newest = readings.agg(F.max_by("ladders", "read_at").alias("ladders"), F.max("read_at").alias("read_at"))
    return newest.select("read_at", F.explode("ladders").alias("l")).select("read_at", "l.*")
