"""What venues' own price pairs say about the adjustment factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.order_stats import grouped_median, value_counts
from ..sources.staging import written

OTHER_COMMITMENTS = ("spot", "community", "reserved")


def commitment_pairs(obs: DataFrame, run: list[str]) -> DataFrame:
    """On-demand price over each other commitment's, per venue, model and node size.

    The cheapest price of each commitment comes out of one grouped pass, so the
    pairing needs no self-join.
    """
    price = F.col("usd_per_gpu_hour")
    cheapest = obs.groupBy(
        *run, "source", F.lower(F.trim("gpu_model")).alias("model"), "gpu_count"
    ).agg(
        F.min(F.when(F.col("commitment") == "on_demand", price)).alias("base"),
        *[F.min(F.when(F.col("commitment") == c, price)).alias(c) for c in OTHER_COMMITMENTS],
    )
    long = cheapest.where(F.col("base") > 0).select(
        *run,
        "source",
        "model",
        "gpu_count",
        "base",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("commitment"), F.col(c).alias("price")) for c in OTHER_COMMITMENTS])
        ).alias("other"),
    )
    return (
        long.where(F.col("other.price") > 0)
        .select(*run, "source", "model", "gpu_count", "other.commitment", (F.col("base") / F.col("other.price")).alias("ratio"))
    )


def commitment_evidence(obs: DataFrame, run: list[str]) -> DataFrame:
    """Median ratio, spread and the administered verdict per venue and commitment."""
    keys = [*run, "source", "commitment"]
    pairs = written(value_counts(commitment_pairs(obs, run), keys, "ratio"), "commitment-pairs")
    spread = pairs.groupBy(*keys).agg(
        F.sum("n").alias("pairs"),
        (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("mean"),
    )
    away = F.col("n") * F.pow(F.col("ratio") - F.col("mean"), 2)
    pstdev = pairs.join(spread, keys).groupBy(*keys).agg(F.sqrt(F.sum(away) / F.sum("n")).alias("pstdev"))
    median = grouped_median(pairs, keys, "ratio", "median_ratio")
    cv = F.when((F.col("median_ratio") > 0) & (F.col("pairs") > 1), F.col("pstdev") / F.col("median_ratio"))
    evidence = (
        spread.join(median, keys)
        .join(pstdev, keys)
        .withColumn("cv", F.coalesce(cv, F.lit(0.0)))
        .withColumn(
            "administered",
            (F.col("pairs") >= rules.ADMINISTERED_MIN_PAIRS) & (F.col("cv") < rules.ADMINISTERED_CV),
        )
        .drop("pstdev", "mean")
    )
    return written(evidence, "commitment-evidence")


def administered(obs: DataFrame, run: list[str]) -> DataFrame:
    """The (venue, commitment) cells whose price is a fixed function of another price."""
    return commitment_evidence(obs, run).where("administered").select(
        *run, "source", "commitment", "pairs", "median_ratio", "cv"
    )


def administered_flags(obs: DataFrame, run: list[str]) -> DataFrame:
    """One flag per excluded cell, with the number of rows it removes."""
    keys = [*run, "source", "commitment"]
    removed = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("removed"))
    return administered(obs, run).join(removed, keys).select(
        *keys,
        F.lit("info").alias("severity"),
        F.lit("administered_pricing_excluded").alias("code"),
        "pairs",
        "median_ratio",
        "cv",
        "removed",
    )


def against_schedule(evidence: DataFrame, factors=None) -> DataFrame:
    """Observed ratio beside the asserted factor, with a verdict."""
    factors = factors or rules.COMMITMENTS
    return (
        evidence.withColumn("asserted", F.element_at(rules.literal(factors), F.col("commitment")))
        .withColumn("error", (F.col("median_ratio") - F.col("asserted")) / F.col("asserted"))
        .withColumn(
            "verdict",
            F.when(F.col("administered"), "administered")
            .when(F.abs("error") <= 0.10, "supports")
            .otherwise("disagrees"),
        )
    )


def form_factor_evidence(obs: DataFrame, run: list[str]) -> DataFrame:
    """PCIe over SXM price within venue, contract, commitment and node size."""
    price = F.col("usd_per_gpu_hour")
    cells = (
        obs.where(F.col("form_factor").isin("pcie", "sxm") & F.col("index_code").isNotNull() & (price > 0))
        .groupBy(*run, "source", "index_code", "commitment", "gpu_count")
        .pivot("form_factor", ["pcie", "sxm"])
        .agg(F.min(price))
    )
    ratios = cells.where("pcie is not null and sxm is not null").withColumn("ratio", F.col("pcie") / F.col("sxm"))
    keys = [*run, "source", "index_code"]
    counts = written(value_counts(ratios, keys, "ratio"), "form-pairs")
    pairs = counts.groupBy(*keys).agg(F.sum("n").alias("pairs"))
    return (
        pairs.join(grouped_median(counts, keys, "ratio", "median_ratio"), keys)
        .withColumn("implied_factor", 1.0 / F.col("median_ratio"))
    )


def form_factor_pooled(evidence: DataFrame, run: list[str]) -> DataFrame:
    """Median over venues of each venue's median ratio: a venue is one opinion."""
    venue_keys = [*run, "source"]
    evidence = written(evidence, "form-evidence")
    per_index = evidence.select(*venue_keys, "median_ratio", F.lit(1).alias("n"))
    venue = written(grouped_median(per_index, venue_keys, "median_ratio", "venue_ratio"), "venue-ratios")
    totals = evidence.groupBy(*run).agg(F.sum("pairs").alias("pairs"))
    spread = venue.groupBy(*run).agg(
        F.count(F.lit(1)).alias("venues"),
        F.min("venue_ratio").alias("lowest"),
        F.max("venue_ratio").alias("highest"),
    )
    pooled = grouped_median(venue.withColumn("n", F.lit(1)), run, "venue_ratio", "observed_ratio")
    asserted = F.lit(rules.FORM_FACTORS["pcie"])
    return (
        spread.join(totals, run)
        .join(pooled, run)
        .withColumn("implied_factor", 1.0 / F.col("observed_ratio"))
        .withColumn("asserted", asserted)
        .withColumn("error", (F.col("implied_factor") - asserted) / asserted)
    )
