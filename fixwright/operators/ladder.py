"""Bracket ladders read as distributions, with the reasons not to believe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
OPEN_SPAN = 0.25
SPANS = (0.25, 0.50, 1.00)
MAX_BOOK_ERROR = 0.10
MAX_TAIL_MASS = 0.25
MIN_VOLUME = 5000.0
SOURCE_INDEX = r"\b((?:Ornn|Silicon Data)[\w\s]*Index)"
# ---------------------------------------------------------------------------

EVENT = """
  endDate string,
  markets array<struct<groupItemTitle:string, outcomePrices:string, question:string,
                       volumeNum:double, liquidityNum:double, closed:boolean>>
"""


def bounds(label: str | Column) -> Column:
    """Struct (low, high) of a bracket label; null on the open side, null when no number."""
    text = F.trim(F.col(label) if isinstance(label, str) else label)
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")
    )
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    open_below = text.startswith("<") | F.lower(text).startswith("under")
    open_above = text.endswith("+") | text.startswith(">") | F.lower(text).startswith("over")
    none = F.lit(None).cast("double")
    low = F.when(open_below, none).when(open_above | second.isNotNull(), first).otherwise(none)
    high = F.when(open_below, first).when(open_above, none).when(second.isNotNull(), second).otherwise(first)
    return F.when(first.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def midpoint(span: Column) -> Column:
    low, high = F.col("low"), F.col("high")
    return (
        F.when(low.isNull(), high - span / 2.0).when(high.isNull(), low + span / 2.0).otherwise((low + high) / 2.0)
    )


def with_bounds(brackets: DataFrame) -> DataFrame:
    return brackets.withColumn("b", bounds("label")).select("*", "b.low", "b.high").drop("b")


def expectations(brackets: DataFrame, ladder: list[str], spans=(OPEN_SPAN,)) -> DataFrame:
    """Mean and standard deviation of each ladder for each assumed tail width.

    A ladder whose quotes sum to nothing has no mass anywhere and reads as zero.
    """
    grid = brackets.select(
        *ladder, "low", "high", "quoted", F.explode(F.array(*[F.lit(s) for s in spans])).alias("open_span")
    ).withColumn("mid", midpoint(F.col("open_span")))
    keys = [*ladder, "open_span"]
    mean = grid.groupBy(*keys).agg(
        F.sum("quoted").alias("book"), F.sum(F.col("quoted") * F.col("mid")).alias("weighted")
    ).withColumn("expected", F.when(F.col("book") > 0, F.col("weighted") / F.nullif("book", F.lit(0.0))).otherwise(0.0))
    spread = grid.join(mean, keys).groupBy(*keys).agg(
        F.sum(F.col("quoted") * F.pow(F.col("mid") - F.col("expected"), 2)).alias("ss")
    )
    return mean.join(spread, keys).select(
        *keys,
        "expected",
        F.when(F.col("book") > 0, F.sqrt(F.greatest(F.col("ss") / F.nullif("book", F.lit(0.0)), F.lit(0.0))))
        .otherwise(0.0)
        .alias("dispersion"),
    )


def refusals() -> Column:
    """Every reason a ladder should not be quoted as a level; empty when usable."""
    error = F.abs(F.col("book_sum") - 1.0)
    percent = lambda x: F.format_string("%.0f%%", x * 100.0)
    checks = F.array(
        F.when(F.col("brackets") == 0, F.lit("no open brackets")),
        F.when(
            (F.col("brackets") > 0) & (error > MAX_BOOK_ERROR),
            F.concat(
                F.lit("book sums to "), F.format_string("%.3f", F.col("book_sum")),
                F.lit(", off one by "), percent(error),
            ),
        ),
        F.when(
            (F.col("brackets") > 0) & (F.col("tail_mass") > MAX_TAIL_MASS),
            F.concat(percent(F.col("tail_mass")),
                     F.lit(" of the mass lies in open-ended tails")),
        ),
        F.when(
            (F.col("brackets") > 0) & (F.col("volume") < MIN_VOLUME),
            F.concat(F.lit("$"), F.format_string("%,.0f", F.col("volume")), F.lit(" of volume in all brackets")),
        ),
    )
    return F.filter(checks, lambda r: r.isNotNull())


def assess(brackets: DataFrame, ladder: list[str], span: float = OPEN_SPAN) -> DataFrame:
    """Book sum, tail mass, volume, level and verdict of every ladder."""
    tail = F.col("low").isNull() | F.col("high").isNull()
    quality = brackets.groupBy(*ladder).agg(
        F.count("label").alias("brackets"),
        F.sum("quoted").alias("book_sum"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(tail, F.col("quoted")).otherwise(0.0)).alias("tails"),
    ).withColumn(
        "tail_mass", F.when(F.col("book_sum") > 0, F.col("tails") / F.nullif("book_sum", F.lit(0.0))).otherwise(1.0)
    )
    return (
        quality.join(expectations(brackets, ladder, (span,)).drop("open_span"), ladder, "left")
        .withColumn("refusals", refusals())
        .withColumn("withheld", F.size("refusals") > 0)
        .drop("tails")
    )


def probabilities(brackets: DataFrame, ladder: list[str]) -> DataFrame:
    """Quotes renormalised to one within their ladder."""
    book = brackets.groupBy(*ladder).agg(F.sum("quoted").alias("book_sum"))
    return brackets.join(book, ladder).withColumn(
        "probability",
        F.when(F.col("book_sum") > 0, F.col("quoted") / F.nullif("book_sum", F.lit(0.0))).otherwise(0.0),
    )


def curve_change(verdicts: DataFrame, curve: list[str], order: str) -> DataFrame:
    """First and last usable level of a curve of ladders, and the change between them."""
    usable = verdicts.where(~F.col("withheld") & F.col("expected").isNotNull())
    return (
        usable.groupBy(*curve)
        .agg(
            F.count(F.lit(1)).alias("usable"),
            F.min_by("expected", order).alias("first_level"),
            F.max_by("expected", order).alias("last_level"),
        )
        .withColumn(
            "change",
            F.when(F.col("usable") >= 2, F.col("last_level") / F.nullif("first_level", F.lit(0.0)) - 1.0),
        )
    )


def from_events(events: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Landed event documents to bracket rows."""
    parsed = events.select(*keep, F.from_json(payload, EVENT).alias("e")).select(
        *keep, F.to_date(F.substring("e.endDate", 1, 10)).alias("settles"), F.explode("e.markets").alias("m")
    )
    prices = F.from_json("m.outcomePrices", "array<string>")
    return (
        parsed.where(~F.coalesce("m.closed", F.lit(False)))
        .select(
            *keep,
            "settles",
            F.trim("m.groupItemTitle").alias("label"),
            F.get(prices, F.lit(0)).try_cast("double").alias("quoted"),
            F.coalesce("m.volumeNum", F.lit(0.0)).alias("volume"),
            F.coalesce("m.liquidityNum", F.lit(0.0)).alias("liquidity"),
            F.nullif(F.regexp_extract("m.question", SOURCE_INDEX, 1), F.lit("")).alias("source_index"),
        )
        .where((F.col("label") != "") & F.col("quoted").isNotNull())
        .transform(with_bounds)
        .where("low is not null or high is not null")
    )


def newest_reading(readings: DataFrame, key: list[str], order: str = "read_at") -> DataFrame:
    """The newest dated record of each ladder set, withheld ones included."""
    rest = [c for c in readings.columns if c not in key]
    return readings.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
