"""From rate-card rows to a period series, its coverage and its overlap with live values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.order_stats import HOT_ROWS, grouped_median, median_and_mad, value_counts
from ..sources.staging import written
from . import prepare as P

# --- fixed values -----------------------------------------------------------
MIN_PROVIDERS = 3
DISPERSION_FLAG = 0.45
LABEL = (
    "reconstructed from archived public rate cards; list prices, not transactions; "
    "not the index"
)
LIVE_NAMES = {
    "lambda": ("shadeform:lambdalabs", "lambdalabs"),
    "runpod": ("runpod",),
    "datacrunch": ("datacrunch",),
    "hyperstack": ("shadeform:hyperstack",),
    "digitalocean": ("shadeform:digitalocean",),
    "voltagepark": ("shadeform:voltagepark",),
    "paperspace": ("shadeform:paperspace",),
    "crusoe": ("shadeform:crusoe",),
    "nebius": ("shadeform:nebius",),
    "coreweave": ("shadeform:coreweave",),
    "fluidstack": ("shadeform:fluidstack",),
}
# ---------------------------------------------------------------------------


def captured_day(captured: str = "captured") -> Column:
    return F.to_date(F.substring(captured, 1, 8), "yyyyMMdd")


def period(day: Column, granularity: str) -> Column:
    """Month as yyyy-MM, ISO week named by its Monday."""
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    return F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")


def calendar(start: str, end: str, granularity: str) -> Column:
    """First day of every period between two dates, as an array."""
    unit, step = ("month", "1 MONTH") if granularity == "month" else ("week", "7 DAYS")
    return F.expr(
        f"sequence(date_trunc('{unit}', date'{start}'), date_trunc('{unit}', date'{end}'), INTERVAL {step})"
    )


def spine(spark, start: str, end: str, granularity: str) -> DataFrame:
    """Every period between two dates, empty ones included, with the one before it."""
    step = "1 MONTH" if granularity == "month" else "7 DAYS"
    days = spark.range(1).select(F.explode(calendar(start, end, granularity)).alias("day"))
    return days.select(
        period(F.col("day"), granularity).alias("period"),
        period(F.expr(f"day - INTERVAL {step}"), granularity).alias("previous_period"),
    )


def restate(rows: DataFrame, versions: rules.Registry | None = None, on_file: bool = False) -> DataFrame:
    """Every rate-card row with its ``outcome``: restated, or why not.

    Scope, component prices and commitments are decided first; what is left goes
    through the same screens and factors as a live quote, under one pinned version.
    Of rows that are ``on_file``, so that reading them twice is cheap, each different label is read once.
    """
    versions = versions or rules.registry(rules.BACK_SERIES_VERSION)
    obs = rows.select(
        "*",
        F.col("price_per_instance_hour").alias("usd_per_hour_total"),
        F.lit(None).cast("string").alias("region"),
        F.lit(False).alias("administered"),
    )
    done = P.restate(P.with_labels(obs) if on_file else P.with_index(obs), versions)
    outcome = (
        F.when(~F.col("index_code").isin(*rules.BACK_SERIES_CODES), "out_of_scope")
        .when(F.col("basis") != "instance", "component_price")
        .when(F.col("commitment") != "on_demand", "not_on_demand")
        .when(F.col("reject_code").isNotNull(), F.col("reject_code"))
        .otherwise("restated")
    )
    return done.withColumn("outcome", outcome).drop("region", "administered")


def _votes(rows: DataFrame, keys: list[str], price: str, limit: int) -> DataFrame:
    """Median per source in each cell, with its number of rows."""
    by_source = [*keys, "source"]
    counts = written(value_counts(rows.select(*by_source, price), by_source, price), "card-counts")
    size = counts.groupBy(*by_source).agg(F.sum("n").alias("rows"))
    return written(size.join(grouped_median(counts, by_source, price, "vote", limit), by_source), "card-votes")


def _median_of_votes(votes: DataFrame, keys: list[str], out: str, limit: int) -> DataFrame:
    return grouped_median(votes.withColumn("n", F.lit(1)), keys, "vote", out, limit)


def side_columns(restated: DataFrame, granularity: str, limit: int = HOT_ROWS) -> DataFrame:
    """Raw medians of prices that never enter the value: reserved, and spot with community."""
    keys = ["period", "index_code"]
    side = F.when(F.col("commitment").isin("spot", "community"), "spot").otherwise("reserved")
    rows = restated.where("outcome = 'not_on_demand'").where(
        F.col("index_code").isin(*rules.BACK_SERIES_CODES)
    ).select(
        period(captured_day(), granularity).alias("period"), "index_code", side.alias("side"), "source",
        "usd_per_gpu_hour",
    )
    skeys = [*keys, "side"]
    votes = _votes(rows, skeys, "usd_per_gpu_hour", limit)
    table = _median_of_votes(votes, skeys, "median", limit).join(
        votes.groupBy(*skeys).agg(F.count(F.lit(1)).alias("providers")), skeys
    )
    return table.groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == s, F.col("median"))).alias(f"{s}_raw_median") for s in ("reserved", "spot")],
        *[
            F.coalesce(F.max(F.when(F.col("side") == s, F.col("providers"))), F.lit(0)).alias(f"{s}_providers")
            for s in ("reserved", "spot")
        ],
    )


def matched_change(votes: DataFrame, periods: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Median log change of providers voting in this period and the one just before it."""
    keys = ["period", "index_code"]
    before = votes.select(
        F.col("period").alias("previous_period"), "index_code", "source", F.col("vote").alias("before")
    )
    moves = written(
        votes.join(periods, "period")
        .join(before, ["previous_period", "index_code", "source"])
        .select(*keys, F.log(F.col("vote") / F.col("before")).alias("change"), F.lit(1).alias("n")),
        "card-moves",
    )
    matched = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched_providers"))
    median = grouped_median(moves, keys, "change", "median_change", limit)
    return matched.join(median, keys).select(
        *keys,
        "matched_providers",
        F.when(F.col("matched_providers") >= MIN_PROVIDERS, F.col("median_change")).alias("matched_log_change"),
    )


def period_votes(restated: DataFrame, granularity: str, limit: int = HOT_ROWS) -> DataFrame:
    rows = restated.where("outcome = 'restated'").select(
        period(captured_day(), granularity).alias("period"), "index_code", "source", "normalized_usd_per_gpu_hour"
    )
    return _votes(rows, ["period", "index_code"], "normalized_usd_per_gpu_hour", limit)


def period_series(
    restated: DataFrame, periods: DataFrame, granularity: str, limit: int = HOT_ROWS
) -> DataFrame:
    """One row per period and index, gaps written as withheld.

    ``providers`` lists the votes by source; there are as many as sources are read.
    """
    keys = ["period", "index_code"]
    votes = period_votes(restated, granularity, limit)
    voter = F.concat("source", F.lit("="), F.format_string("%.3f", "vote"))
    by_price = votes.select(*keys, F.col("vote"), F.lit(1).alias("n"))
    panel = votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("provider_count"),
        F.sum("rows").alias("observation_count"),
        F.min("vote").alias("min_provider_value"),
        F.max("vote").alias("max_provider_value"),
        F.array_join(F.array_sort(F.collect_list(voter)), ";").alias("providers"),
    )
    stats = median_and_mad(by_price, keys, "vote", limit)
    kept = restated.where("outcome = 'restated'").select(
        period(captured_day(), granularity).alias("period"), "index_code", "source", "captured", "usd_per_gpu_hour"
    )
    snapshots = kept.select(*keys, "source", "captured").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshot_count")
    )
    raw = grouped_median(
        written(value_counts(kept, keys, "usd_per_gpu_hour"), "card-raw"), keys, "usd_per_gpu_hour",
        "raw_on_demand_median", limit,
    )
    codes = F.explode(F.array(*[F.lit(c) for c in rules.BACK_SERIES_CODES]))
    frame = periods.select("period", codes.alias("index_code"))
    n = F.coalesce("provider_count", F.lit(0))
    dispersion = F.when(
        (n >= rules.DISPERSION_MIN_PROVIDERS) & (F.col("median") > 0),
        F.col("mad") * rules.MAD_TO_SIGMA / F.col("median"),
    )
    return (
        frame.join(panel, keys, "left")
        .join(stats, keys, "left")
        .join(snapshots, keys, "left")
        .join(raw, keys, "left")
        .join(side_columns(restated, granularity, limit), keys, "left")
        .join(matched_change(votes, periods, limit), keys, "left")
        .withColumn("dispersion", dispersion)
        .select(
            *keys,
            F.when(n >= MIN_PROVIDERS, "published").otherwise("withheld").alias("status"),
            F.when(n >= MIN_PROVIDERS, F.col("median")).alias("value"),
            n.alias("provider_count"),
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in ("observation_count", "snapshot_count", "reserved_providers", "spot_providers",
                          "matched_providers")
            ],
            "dispersion",
            "min_provider_value",
            "max_provider_value",
            F.when(n < MIN_PROVIDERS, F.concat(F.lit("min_providers: "), n.cast("string"),
                                               F.lit(f" of {MIN_PROVIDERS} required"))).alias("withheld_reason"),
            (F.coalesce("dispersion", F.lit(0.0)) > DISPERSION_FLAG).alias("dispersion_flag"),
            "raw_on_demand_median",
            "reserved_raw_median",
            "spot_raw_median",
            "matched_log_change",
            F.coalesce("providers", F.lit("")).alias("providers"),
            F.lit(rules.BACK_SERIES_VERSION).alias("methodology_version"),
            F.lit(LABEL).alias("label"),
        )
    )


def provider_list(votes: DataFrame) -> DataFrame:
    """Each provider's vote per period and index, as long rows in provider order."""
    return votes.select("period", "index_code", "source", "vote", "rows")


def coverage(manifest: DataFrame, restated: DataFrame, start: str, end: str, sources: DataFrame) -> DataFrame:
    """Source by month by index, zeros included."""
    pages = manifest.groupBy("source", period(captured_day(), "month").alias("period")).agg(
        F.count(F.lit(1)).alias("snapshots")
    )
    quotes = (
        restated.where("outcome = 'restated'")
        .groupBy("source", period(captured_day(), "month").alias("period"))
        .pivot("index_code", list(rules.BACK_SERIES_CODES))
        .count()
    )
    frame = sources.select("source").distinct().select(
        "source", F.explode(calendar(start, end, "month")).alias("day")
    ).select("source", period(F.col("day"), "month").alias("period"))
    wide = frame.join(pages, ["source", "period"], "left").join(quotes, ["source", "period"], "left")
    return wide.select(
        "source", "period", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("snapshots", *rules.BACK_SERIES_CODES)]
    )


def ledger(restated: DataFrame) -> DataFrame:
    """Every row that was read and what became of it."""
    kept = F.col("outcome") == "restated"
    return restated.select(
        "source", "captured", period(captured_day(), "month").alias("month"),
        period(captured_day(), "week").alias("week"), "sku", "gpu_model", "gpu_count", "commitment",
        "price_per_instance_hour", F.col("usd_per_gpu_hour").alias("price_per_gpu_hour"), "basis", "index_code",
        F.when(kept, "restated").otherwise("discarded").alias("outcome"),
        F.when(kept, F.col("normalized_usd_per_gpu_hour")).alias("restated_per_gpu_hour"),
        F.when(kept, F.array_join(
            F.transform(P.adjustments(), lambda a: F.concat(a["name"], F.lit("x"), a["factor"].cast("string"))), ";"
        )).alias("adjustments"),
        F.when(~kept, F.col("outcome")).alias("discard_code"),
    )


def overlap_level(series: DataFrame, live: DataFrame, granularity: str, since: str) -> DataFrame:
    """Period values beside the mean of the live fixings in the same period."""
    means = (
        live.where((F.col("status") == "published") & (F.col("index_date") >= F.lit(since).cast("date")))
        .groupBy(period(F.col("index_date"), granularity).alias("period"), "index_code")
        .agg(F.avg("value").alias("live_mean"), F.count(F.lit(1)).alias("live_days"))
    )
    return (
        series.select("period", "index_code", F.col("value").alias("back_value"), "provider_count")
        .join(means, ["period", "index_code"])
        .select(
            F.lit(granularity).alias("granularity"), "period", "index_code", "back_value",
            F.col("provider_count").alias("back_providers"), "live_mean", "live_days",
            (F.col("live_mean") / F.nullif("back_value", F.lit(0.0))).alias("ratio"),
        )
    )


def overlap_providers(
    restated: DataFrame, live_votes: DataFrame, names: dict[str, tuple[str, ...]], since: str,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """The same seller read two ways: its rate card against its live medians."""
    keys = ["period", "index_code"]
    start = F.lit(since).cast("date")
    month = period(captured_day(), "month")
    cards = restated.where("outcome = 'restated'").where(captured_day() >= start).select(
        month.alias("period"), "index_code", "source", "normalized_usd_per_gpu_hour"
    )
    votes = _votes(cards, keys, "normalized_usd_per_gpu_hour", limit)
    known = F.explode(F.element_at(rules.literal({k: list(v) for k, v in names.items()}), F.col("source")))
    paired = votes.select(*keys, F.col("source").alias("back_source"), F.col("vote").alias("back_vote"),
                          known.alias("live_provider"))
    days = live_votes.where(F.col("index_date") >= start).select(
        period(F.col("index_date"), "month").alias("period"), "index_code",
        F.col("provider").alias("live_provider"), "price",
    )
    dkeys = [*keys, "live_provider"]
    counts = written(days.withColumn("n", F.lit(1)), "live-days")
    live = grouped_median(counts, dkeys, "price", "live_median", limit).join(
        counts.groupBy(*dkeys).agg(F.count(F.lit(1)).alias("live_days")), dkeys
    )
    return paired.join(live, dkeys).select(
        *keys, "back_source", "live_provider", "back_vote", "live_median", "live_days",
        (F.col("live_median") / F.col("back_vote")).alias("ratio"),
    )


def period_counts(series: DataFrame) -> DataFrame:
    """Published and withheld periods per index, first and last published."""
    published = F.when(F.col("status") == "published", F.col("period"))
    return series.groupBy("index_code").agg(
        F.count(published).alias("published"),
        F.count_if(F.col("status") != "published").alias("withheld"),
        F.min(published).alias("first"),
        F.max(published).alias("last"),
    )
