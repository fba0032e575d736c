"""Votes, screen, weights, value and gates for every fixing key at once.

``keys`` always includes ``methodology_version``; anything else that tells
fixings apart (run, index, date, basis) is just another key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import labels
from ..functions.order_stats import HOT_ROWS, median_and_mad, running, value_counts, with_median_and_mad
from ..sources.staging import written

TIERS = (1, 2, 3)


def provider_votes(quotes: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """One vote per provider: the median of its quotes, with its own spread."""
    by_provider = [*keys, "provider"]
    priced = quotes.select(
        *keys,
        F.col("source").alias("provider"),
        F.col("normalized_usd_per_gpu_hour").alias("quote"),
        "tier",
    )
    counts = written(value_counts(priced, by_provider, "quote", carry=("tier",)), "quote-counts")
    centre = median_and_mad(
        counts, by_provider, "quote", limit,
        also=(F.sum("n").alias("quote_count"), F.min("tier").alias("best_tier")),
    )
    votes = centre.select(
        *by_provider,
        F.col("median").alias("price"),
        "quote_count",
        "best_tier",
        F.when(F.col("median") > 0, F.col("mad") * rules.MAD_TO_SIGMA / F.col("median"))
        .otherwise(F.lit(0.0))
        .alias("spread"),
    )
    return written(votes, "votes")


def screen(votes: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Mark providers implausibly far from the panel, and keep the arithmetic."""
    panel = with_median_and_mad(votes.withColumn("n", F.lit(1)), keys, "price", limit)
    panel = panel.drop("n").withColumnsRenamed({"median": "panel_median", "mad": "panel_mad", "total": "panel_size"})
    price, mid, mad = F.col("price"), F.col("panel_median"), F.col("panel_mad")
    usable = F.col("panel_size") >= rules.SCREEN_MIN_PROVIDERS
    sigmas = F.when(mad > 0, F.abs(price - mid) / F.nullif(mad * rules.MAD_TO_SIGMA, F.lit(0.0)))
    ratio = F.when(
        (mad == 0) & (mid > 0) & (price > 0),
        F.greatest(price / F.nullif(mid, F.lit(0.0)), mid / F.nullif(price, F.lit(0.0))),
    )
    far = F.coalesce(
        (sigmas > rules.OUTLIER_SIGMAS)
        | (ratio > rules.DEGENERATE_RATIO * (1 + rules.RATIO_EPSILON)),
        sigmas > rules.OUTLIER_SIGMAS,
        ratio > rules.DEGENERATE_RATIO * (1 + rules.RATIO_EPSILON),
        F.lit(False),
    )
    reason = F.when(mad == 0, F.format_string("%.1fx from an exact consensus", ratio)).otherwise(
        F.format_string("%.1f robust sigma from median", sigmas)
    )
    screened = (
        panel.withColumns({"sigmas": sigmas, "ratio": ratio})
        .withColumn("screened_out", usable & far)
        .withColumn("screen_reason", F.when(F.col("screened_out"), reason))
    )
    return written(screened, "screened")


#: Sums of such numbers do not depend on the order in which rows are added.
EXACT = "decimal(38,18)"


def exact_sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT)).cast("double")


def _tier_weight(m: Column, tier: int) -> Column:
    return F.coalesce(F.element_at(m["tier_weights"], F.lit(tier)), F.lit(0.0))


def capped_weights(m: Column, count_of: dict[int, Column]) -> Column:
    """Tier weights after the concentration cap, as a struct w1, w2, w3.

    The cap is a pure function of a provider's round-start weight and the round's
    total, so providers of one tier always move together and three numbers per
    fixing carry the whole state, however long the panel. A provider can only be
    over the cap while the panel is short; past that the first round is a no-op
    and no round is run.
    """
    cap = m["weight_cap"]
    n = sum(count_of.values(), F.lit(0)).cast("long")
    each = [_tier_weight(m, t) for t in TIERS]  # a tier that the version does not list weighs nothing
    heaviest, lightest = F.greatest(*each), F.nullif(F.least(*each), F.lit(0.0))
    reach = F.coalesce(F.floor(heaviest / (lightest * cap)) + 1, n)
    runs = (n * cap >= 1.0) & (n <= reach) & (n >= 1)
    rounds = F.when(runs, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )
    start = F.struct(*[_tier_weight(m, t).alias(f"w{t}") for t in TIERS])

    def one_round(w: Column, _: Column) -> Column:
        total = sum((w[f"w{t}"] * count_of[t] for t in TIERS), F.lit(0.0))

        def moved(t: int) -> Column:
            mine = w[f"w{t}"]
            ceiling = cap * (total - mine) / (1 - cap)
            over = (total > 0) & (count_of[t] > 0) & (mine / F.nullif(total, F.lit(0.0)) > cap)
            return F.when(over & (ceiling < mine), ceiling).otherwise(mine)

        return F.struct(*[moved(t).alias(f"w{t}") for t in TIERS])

    return F.aggregate(rounds, start, one_round)


def tier_totals(screened: DataFrame, keys: list[str], versions: rules.Registry) -> DataFrame:
    """Per fixing: counts and price sums by tier, capped tier weights, total weight."""
    live = ~F.col("screened_out")

    def of(t: int) -> Column:
        return live & (F.col("best_tier") == t)

    per_key = screened.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("panel_providers"),
        F.count_if(live).alias("provider_count"),
        F.coalesce(F.sum(F.when(live, F.col("quote_count"))), F.lit(0)).alias("observation_count"),
        *[F.count_if(of(t)).alias(f"n{t}") for t in TIERS],
        *[F.coalesce(exact_sum(F.when(of(t), F.col("price"))), F.lit(0.0)).alias(f"p{t}") for t in TIERS],
    )
    m = rules.rules_of(versions)
    per_key = per_key.withColumn("w", capped_weights(m, {t: F.col(f"n{t}") for t in TIERS}))
    return per_key.withColumn(
        "total_weight", sum((F.col("w")[f"w{t}"] * F.col(f"n{t}") for t in TIERS), F.lit(0.0))
    )


def with_weights(screened: DataFrame, totals: DataFrame, keys: list[str], versions: rules.Registry) -> DataFrame:
    """Natural and capped weight and share on each provider; zero when screened."""
    m = rules.rules_of(versions)
    joined = screened.join(totals.select(*keys, "w", "total_weight", "provider_count", *[f"n{t}" for t in TIERS]), keys)

    def by_tier(pick) -> Column:
        out = F.lit(0.0)
        for t in TIERS:
            out = F.when(F.col("best_tier") == t, pick(t)).otherwise(out)
        return F.when(F.col("screened_out"), F.lit(0.0)).otherwise(out)

    natural_total = sum((_tier_weight(m, t) * F.col(f"n{t}") for t in TIERS), F.lit(0.0))
    return (
        joined.withColumn("natural_weight", by_tier(lambda t: _tier_weight(m, t)))
        .withColumn("weight", by_tier(lambda t: F.col("w")[f"w{t}"]))
        .withColumn("natural_share", F.col("natural_weight") / F.nullif(natural_total, F.lit(0.0)))
        .withColumn("share", F.col("weight") / F.nullif(F.col("total_weight"), F.lit(0.0)))
        .drop("w", "total_weight", "provider_count", *[f"n{t}" for t in TIERS])
    )


def contributions(
    quotes: DataFrame, keys: list[str], versions: rules.Registry, limit: int = HOT_ROWS
) -> DataFrame:
    """Every provider of every fixing, screened ones included, with its weight."""
    screened = screen(provider_votes(quotes, keys, limit), keys, limit)
    return with_weights(screened, tier_totals(screened, keys, versions), keys, versions)


def vote_spread(m: Column) -> Column:
    return F.least(F.greatest(F.col("spread"), m["sigma_floor"]), m["sigma_ceiling"])


def ballot(weighted: DataFrame, keys: list[str], versions: rules.Registry, limit: int = HOT_ROWS) -> DataFrame:
    """Three votes per provider, equal votes merged, with the mass before each one."""
    m = rules.rules_of(versions)
    cast = weighted.where(~F.col("screened_out") & (F.col("weight") > 0)).select(
        *keys,
        (F.col("weight") / 3.0).alias("third"),
        F.explode(
            F.array(
                F.col("price") * (1.0 - vote_spread(m)),
                F.col("price"),
                F.col("price") * (1.0 + vote_spread(m)),
            )
        ).alias("vote"),
    )
    merged = written(
        value_counts(cast, keys, "vote", carry=("third",)).withColumn("mass", (F.col("n") * F.col("third")).cast(EXACT)), "ballot"
    )
    total = merged.groupBy(*keys).agg(F.sum("mass").alias("total_mass"))
    placed = running(merged, keys, ["vote", "third"], "vote", {"before": ("sum", "mass")}, limit=limit)
    return placed.join(total, keys).withColumns({c: F.col(c).cast("double") for c in ("mass", "before", "total_mass")})


def band_share(band: Column) -> tuple[Column, Column]:
    """Mass of a ballot row inside the central band, and that mass times its price."""
    lo = (1.0 - band) / 2.0 * F.col("total_mass")
    hi = (1.0 + band) / 2.0 * F.col("total_mass")
    inside = F.greatest(
        F.least(F.col("before") + F.col("mass"), hi) - F.greatest(F.col("before"), lo), F.lit(0.0)
    )
    return inside, inside * F.col("vote")


def interquantile(votes: DataFrame, keys: list[str], versions: rules.Registry) -> DataFrame:
    """Mean of the central band of vote mass, boundary votes shared out."""
    inside, priced = band_share(rules.rules_of(versions)["robustness_band"])
    return votes.groupBy(*keys).agg(
        (exact_sum(priced) / F.nullif(exact_sum(inside), F.lit(0.0))).alias("banded_value")
    )


def interquantile_sweep(votes: DataFrame, keys: list[str], bands: list[float]) -> DataFrame:
    """The same mean for many bands in one pass: a column pair per band, then unpivoted."""
    sums = []
    for i, band in enumerate(bands):
        inside, priced = band_share(F.lit(band))
        sums.append((exact_sum(priced) / F.nullif(exact_sum(inside), F.lit(0.0))).alias(f"b{i}"))
    wide = votes.groupBy(*keys).agg(*sums)
    return wide.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"b{i}").alias("value")) for i, b in enumerate(bands)])
        ).alias("at"),
    ).select(*keys, "at.band", "at.value")


def dispersion(screened: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Robust relative spread of the contributing providers, null below three."""
    live = screened.where(~F.col("screened_out"))
    counts = live.select(*keys, "price", F.lit(1).alias("n"))
    stats = median_and_mad(counts, keys, "price", limit, also=(F.sum("n").alias("live"),))
    return stats.select(
        *keys,
        F.col("median").alias("live_median"),
        F.col("mad").alias("live_mad"),
        F.when(
            (F.col("live") >= rules.DISPERSION_MIN_PROVIDERS) & (F.col("median") > 0),
            F.col("mad") * rules.MAD_TO_SIGMA / F.col("median"),
        ).alias("dispersion"),
    )


def gate_array(m: Column) -> Column:
    """Every publication gate with its verdict and its wording, which is fixed: the tape carries it."""

    def gate(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))

    of = lambda have, need: F.concat(
        F.col(have).cast("string"), F.lit(" of "), need.cast("string"), F.lit(" required")
    )
    d = F.col("dispersion")
    gates = F.array(
        gate("min_providers", F.col("provider_count") >= m["min_providers"], of("provider_count", m["min_providers"])),
        gate("min_observations", F.col("observation_count") >= m["min_observations"],
             of("observation_count", m["min_observations"])),
        gate(
            "dispersion",
            F.coalesce(d <= m["max_dispersion"], F.lit(False)),
            F.when(d.isNotNull(), F.concat(F.format_string("%.3f", d), F.lit(" against ceiling "),
                                           m["max_dispersion"].cast("string")))
            .otherwise("not computable with fewer than 3 providers"),
        ),
        F.when(
            m["require_tier1"],
            gate("executable_input", F.col("tier1_present"),
                 F.when(F.col("tier1_present"), "executable offer present").otherwise("rate cards only")),
        ),
    )
    return F.filter(gates, lambda g: g.isNotNull())


def failed_wording(gates: Column) -> Column:
    """The failed gates in words, as the tape carries them."""
    failed = F.filter(gates, lambda g: ~g["passed"])
    return F.array_join(F.transform(failed, lambda g: F.concat(g["name"], F.lit(": "), g["detail"])), "; ")


def empty_panel(codes: DataFrame, versions: rules.Registry) -> DataFrame:
    """Rows of ``codes`` (with methodology_version) as fixings without a single quote, and why they are withheld."""
    none = codes.withColumns({
        "provider_count": F.lit(0).cast("long"), "observation_count": F.lit(0).cast("long"), "dispersion": F.lit(None).cast("double"),
        "tier1_present": F.lit(False),
    })
    return none.withColumn("withheld_reason", failed_wording(gate_array(rules.rules_of(versions))))


def fixings(
    quotes: DataFrame, keys: list[str], versions: rules.Registry, limit: int = HOT_ROWS
) -> DataFrame:
    """A candidate value and its gates for every key: the whole estimator."""
    screened = screen(provider_votes(quotes, keys, limit), keys, limit)
    return fixings_of(screened, keys, versions, limit)


def fixings_of(
    screened: DataFrame, keys: list[str], versions: rules.Registry, limit: int = HOT_ROWS
) -> DataFrame:
    m = rules.rules_of(versions)
    totals = tier_totals(screened, keys, versions)
    out = totals.join(dispersion(screened, keys, limit), keys, "left")
    mean = sum((F.col("w")[f"w{t}"] * F.col(f"p{t}") for t in TIERS), F.lit(0.0)) / F.nullif(
        F.col("total_weight"), F.lit(0.0)
    )
    if any(v.robustness_band < 1.0 for v in versions.values()):
        weighted = with_weights(screened, totals, keys, versions)
        banded = interquantile(ballot(weighted, keys, versions, limit), keys, versions)
        out = out.join(banded, keys, "left")
        value = F.when(m["robustness_band"] >= 1.0, mean).otherwise(F.col("banded_value"))
    else:
        value = mean
    out = (
        out.withColumn("value", value)
        .withColumn("tier1_present", F.col("n1") > 0)
        .withColumn("gates", gate_array(m))
    )
    failed = F.filter("gates", lambda g: ~g["passed"])
    wording = failed_wording(F.col("gates"))
    return out.select(
        *keys,
        "value",
        "dispersion",
        (F.col("dispersion") * F.col("value")).alias("band"),
        "provider_count",
        "observation_count",
        "tier1_present",
        "gates",
        (F.forall("gates", lambda g: g["passed"]) & F.col("value").isNotNull()).alias("passed"),
        F.when(F.size(failed) > 0, wording).alias("failed_gates"),
        "total_weight",
        *[f"n{t}" for t in TIERS],
        "w",
    )


def publish_or_withhold(fix: DataFrame) -> DataFrame:
    """Status and the value as the tape would carry it: null when any gate failed."""
    return fix.select(
        "*",
        F.when(F.col("passed"), "published").otherwise("withheld").alias("status"),
        F.when(F.col("passed"), F.col("value")).alias("published_value"),
        F.when(~F.col("passed"), F.col("failed_gates")).alias("withheld_reason"),
    )


def venues(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Contributing providers and weight per venue, with both shares of the fixing."""
    by_venue = (
        weighted.where(~F.col("screened_out"))
        .withColumn("venue", labels.venue("provider"))
        .groupBy(*keys, "venue")
        .agg(F.count(F.lit(1)).alias("providers"), F.sum("weight").alias("weight"),
             F.sum("quote_count").alias("quotes"))
    )
    whole = by_venue.groupBy(*keys).agg(
        F.sum("providers").alias("all_providers"), F.sum("weight").alias("all_weight"),
        F.sum("quotes").alias("all_quotes"), F.count(F.lit(1)).alias("venue_count"),
    )
    return by_venue.join(whole, keys).select(
        "*",
        (F.col("providers") / F.col("all_providers")).alias("count_share"),
        F.round(F.col("weight") / F.nullif(F.col("all_weight"), F.lit(0.0)), 9).alias("weight_share"),
    )


def concentration(by_venue: DataFrame, keys: list[str]) -> DataFrame:
    """The leading venue by count and by weight; flagged when either passes half.

    ``min`` over (-share, venue) picks the leader with the alphabetical
    tie-break and, unlike a ranking window, combines before the shuffle.
    """
    leaders = by_venue.groupBy(*keys).agg(
        F.min(F.struct((-F.col("providers")).alias("k"), F.col("venue"), F.col("count_share"))).alias("by_count"),
        F.min(F.struct((-F.col("weight_share")).alias("k"), F.col("venue"), F.col("weight_share"))).alias("by_weight"),
        F.max("venue_count").alias("venue_count"),
    )
    count_share, weight_share = F.col("by_count.count_share"), F.col("by_weight.weight_share")
    weight_leads = weight_share > count_share
    return leaders.select(
        *keys,
        "venue_count",
        F.col("by_count.venue").alias("count_venue"),
        count_share.alias("count_share"),
        F.col("by_weight.venue").alias("weight_venue"),
        weight_share.alias("weight_share"),
        F.when(weight_leads, F.col("by_weight.venue")).otherwise(F.col("by_count.venue")).alias("lead_venue"),
        ((count_share > rules.VENUE_CONCENTRATION) | (weight_share > rules.VENUE_CONCENTRATION)).alias("flagged"),
    )


def flags(weighted: DataFrame, fix: DataFrame, conc: DataFrame, keys: list[str]) -> DataFrame:
    """The estimator's own flags in one long table."""

    def flag(df: DataFrame, severity: str, code: Column, subject: Column) -> DataFrame:
        return df.select(
            *keys, F.lit(severity).alias("severity"), code.alias("code"), subject.alias("subject")
        )

    outliers = weighted.where("screened_out")
    capped = weighted.where(~F.col("screened_out") & (F.col("weight") < F.col("natural_weight") - 1e-9))
    return (
        flag(outliers.where("panel_mad = 0"), "warn", F.lit("outlier_screened_degenerate"), F.col("provider"))
        .unionByName(flag(outliers.where("panel_mad > 0"), "info", F.lit("outlier_screened"), F.col("provider")))
        .unionByName(flag(capped, "warn", F.lit("provider_weight_capped"), F.col("provider")))
        .unionByName(flag(conc.where("flagged"), "warn", F.lit("venue_concentration"), F.col("lead_venue")))
        .unionByName(
            flag(fix.where(~F.col("tier1_present") & (F.col("provider_count") > 0)), "warn",
                 F.lit("no_executable_input"), F.lit(None).cast("string"))
        )
    )
