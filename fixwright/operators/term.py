"""Term structure: implied decline, premium grid, forward stripping, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions.order_stats import HOT_ROWS, running
from ..sources.staging import written

PREMIUMS = (0.0, 0.05, 0.10, 0.15, 0.20)
CONSISTENT_SPREAD = 0.10
CONSISTENCY_PREMIUM = 0.10


def implied_declines(points: DataFrame, premiums=(0.0,)) -> DataFrame:
    """Decline of every term point under every assumed premium."""
    grid = points.select("*", F.explode(F.array(*[F.lit(p) for p in premiums])).alias("risk_premium"))
    rate = curves.implied_decline(F.col("price_ratio"), F.col("tenor_years"), F.col("risk_premium"))
    return grid.withColumn("decline_rate", rate).withColumn(
        "annual_decline", curves.annual_decline(F.col("decline_rate"))
    )


def premium_sensitivity(points: DataFrame, premiums=PREMIUMS) -> DataFrame:
    return implied_declines(points, premiums)


def consistency(points: DataFrame, vendor: str = "vendor", premium: float = CONSISTENCY_PREMIUM) -> DataFrame:
    """Do a vendor's tenors imply one rate? Unreachable discounts are left out of the spread."""
    rated = implied_declines(points, (premium,))
    finite = F.when(F.col("decline_rate") != float("inf"), F.col("decline_rate"))
    return (
        rated.groupBy(vendor)
        .agg(
            F.count(F.lit(1)).alias("tenors"),
            F.count(finite).alias("finite_tenors"),
            F.coalesce(F.max(finite) - F.min(finite), F.lit(0.0)).alias("spread"),
        )
        .where("tenors >= 2")
        .withColumn("consistent", F.col("spread") < CONSISTENT_SPREAD)
    )


def strip_forwards(quotes: DataFrame, curve: str = "curve", limit: int = HOT_ROWS) -> DataFrame:
    """Per-period rates between adjacent tenors of each curve.

    A curve with a repeated or non-positive tenor, or a non-positive rate, is
    refused whole. The point just before is the greatest earlier (tenor, total),
    so the lag is a running maximum and a very long curve can be split.
    """
    sound = (F.col("tenor") > 0) & (F.col("rate") > 0)
    bad = (
        quotes.groupBy(curve, "tenor")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and(sound).alias("ok"))
        .where((F.col("n") > 1) | ~F.col("ok"))
        .select(curve)
        .distinct()
    )
    total = F.col("tenor") * F.col("rate")
    points = quotes.join(bad, curve, "left_anti").select(
        curve, "tenor", "rate", F.struct(F.col("tenor").alias("tenor"), total.alias("total")).alias("point"),
        F.lit(1).alias("one"),
    )
    table = written(points, "curve-points")
    lagged = running(
        table, [curve], ["tenor"], "tenor", {"prior": ("max", "point"), "earlier": ("sum", "one")}, limit=limit
    )
    months = F.col("tenor") - F.coalesce("prior.tenor", F.lit(0.0))
    return lagged.select(
        curve,
        (F.col("earlier") + 1).alias("period"),
        "tenor",
        months.alias("months"),
        ((total - F.coalesce("prior.total", F.lit(0.0))) / months).alias("forward"),
        F.col("rate").alias("term_quote"),
    )


def refused_curves(quotes: DataFrame, curve: str = "curve") -> DataFrame:
    """Why a curve is not stripped."""
    per_tenor = quotes.groupBy(curve, "tenor").agg(F.count(F.lit(1)).alias("n"), F.min("rate").alias("lowest"))
    return (
        per_tenor.groupBy(curve)
        .agg(F.min("tenor").alias("first"), F.max("n").alias("repeats"), F.min("lowest").alias("lowest"))
        .select(
            curve,
            F.when(F.col("first") <= 0, "tenors must be positive")
            .when(F.col("repeats") > 1, "duplicate tenor")
            .when(F.col("lowest") <= 0, "rates must be positive")
            .alias("refusal"),
        )
        .where("refusal is not null")
    )
