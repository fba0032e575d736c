"""Price decline implied by a term discount, as closed column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
HALVINGS = 36  # 5 / 2**36 is the first width under 1e-10
CEILING = 5.0
# ---------------------------------------------------------------------------


def average_price_factor(decline: Column, tenor_years: Column) -> Column:
    """Mean of exp(-d t) over the term; one at no decline."""
    x = decline * tenor_years
    near_zero = F.abs(x) < 1e-9
    safe = F.when(near_zero, F.lit(1.0)).otherwise(x)
    return F.when(near_zero, 1.0 - x / 2.0).otherwise((1.0 - F.exp(-x)) / safe)


def implied_decline(price_ratio: Column, tenor_years: Column, risk_premium: Column) -> Column:
    """Continuous annual decline that explains a committed rate.

    Zero when the premium explains the whole discount, infinite when no decline
    up to the ceiling does, null for a ratio, tenor or premium out of range.
    """
    target = price_ratio / (1.0 - risk_premium)
    bounds = F.struct(F.lit(0.0).alias("lo"), F.lit(CEILING).alias("hi"))

    def halve(b: Column, _: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2.0
        too_high = average_price_factor(mid, tenor_years) > target
        return F.struct(
            F.when(too_high, mid).otherwise(b["lo"]).alias("lo"),
            F.when(too_high, b["hi"]).otherwise(mid).alias("hi"),
        )

    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(HALVINGS)), bounds, halve, lambda b: (b["lo"] + b["hi"]) / 2.0
    )
    valid = (price_ratio > 0) & (price_ratio <= 1) & (risk_premium >= 0) & (risk_premium < 1) & (tenor_years > 0)
    return F.when(
        valid,
        F.when(target >= 1.0, F.lit(0.0))
        .when(average_price_factor(F.lit(CEILING), tenor_years) > target, F.lit(float("inf")))
        .otherwise(root),
    )


def annual_decline(rate: Column) -> Column:
    """A continuous rate as the plain yearly fall; total for an infinite rate."""
    return F.when(rate == float("inf"), F.lit(1.0)).otherwise(1.0 - F.exp(-rate))


def forward_level(spot: Column, rate: Column, years: Column) -> Column:
    return spot * F.exp(-rate * years)
