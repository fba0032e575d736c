"""Recomputing history: verify, back-test a version, sweep the robustness dial.

The whole archive, every version and every dial position go through one job,
keyed by (snapshot, index, version).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.order_stats import grouped_median
from ..sources.staging import written
from . import estimate as E
from . import prepare as P
from . import tape as T

FIXING = ["snapshot", "index_code", "methodology_version"]


def recompute(
    obs: DataFrame, wanted: DataFrame, versions: rules.Registry
) -> tuple[DataFrame, DataFrame]:
    """Fixings and hold-out cells of the wanted (snapshot, version) pairs.

    Index rows are not filtered first: the administered check reads all models
    of a run, and leaving some out would change its verdict. Prepared rows are not
    written: the votes are counted straight from them.
    """
    prepared, books = P.prepare_with_books(wanted_runs(obs, wanted, versions), ["snapshot"], versions)
    values = E.publish_or_withhold(E.fixings(P.quotes(prepared), FIXING, versions))
    return values, P.venue_holdouts(books, ["snapshot"])


def wanted_runs(obs: DataFrame, wanted: DataFrame, versions: rules.Registry) -> DataFrame:
    """Runs with the versions each is wanted under, so that no row is restated under another.

    Versions that are not registered are left out. The wanted runs are a small written
    table with a filter: of an archive that is partitioned by run only their folders are read.
    """
    number = F.element_at(rules.literal({v: i for i, v in enumerate(versions)}), F.col("methodology_version")).cast("int")
    by_run = wanted.select("snapshot", number.alias("no")).where("snapshot is not null and no is not null").groupBy("snapshot").agg(
        F.collect_set("no").alias("wanted_versions")
    )
    return obs.join(written(by_run, "wanted-runs").where(F.size("wanted_versions") > 0), "snapshot")


def on_file(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """Of the snapshots that the rows name those that the archive holds; no other run is read."""
    named = written(rows.select("snapshot").where("snapshot is not null").distinct(), "named-runs").where(F.length(F.trim("snapshot")) > 0)
    return obs.join(named, "snapshot", "left_semi").select("snapshot").distinct().withColumn("on_file", F.lit(True))


def verify(tape: DataFrame, obs: DataFrame, versions: rules.Registry) -> DataFrame:
    """Every live value under its own version, from its own snapshot, with a verdict."""
    rows = T.live(tape)
    values, holdouts = recompute(obs, rows, versions)
    return judge(rows, on_file(rows, obs), values, holdouts, versions)


def judge(
    rows: DataFrame, snapshots: DataFrame, values: DataFrame, holdouts: DataFrame, versions: rules.Registry
) -> DataFrame:
    """Compare live tape rows with recomputed values, first difference first."""
    basis = rules.rules_of(versions)["book_floor_basis"]
    joined = (
        rows.join(snapshots, "snapshot", "left")
        .join(values.select(*FIXING, F.col("published_value").alias("recomputed")), FIXING, "left")
        .join(holdouts.select(*FIXING, F.col("venue_holdouts").alias("derived_holdouts")), FIXING, "left")
    )
    named = F.trim(F.coalesce("snapshot", F.lit("")))
    recorded = F.trim(F.coalesce("venue_holdouts", F.lit("")))
    gap = F.abs(F.col("value") - F.col("recomputed"))
    verdict = (
        F.when(basis.isNull(), "methodology_drift")
        .when(named == "", "unverifiable: no snapshot named")
        .when(F.col("on_file").isNull(), "unverifiable: snapshot missing")
        .when(
            (basis == "priced") & (recorded != F.coalesce("derived_holdouts", F.lit(""))),
            "mismatch: venue hold-outs differ",
        )
        .when(F.col("value").isNull() & F.col("recomputed").isNull(), "matched")
        .when(F.col("value").isNull() | F.col("recomputed").isNull(), "mismatch: publishes on one side only")
        .when(gap <= rules.VERIFY_TOLERANCE, "matched")
        .otherwise("mismatch: value differs")
    )
    return joined.withColumn("verdict", verdict).select(
        "index_code", "index_date", "revision", "methodology_version", "snapshot", "value", "recomputed", "verdict"
    )


def audit(tape: DataFrame, stored: DataFrame, obs: DataFrame, versions: rules.Registry) -> DataFrame:
    """What every live value was made of: the contributions on record, else those its own snapshot still supports.

    ``basis`` is stored, recomputed or refused, with the reason of a refusal: a version
    that is not registered, no snapshot named, or one that is not on file. A fixing without
    a single contribution has one row without a provider.
    """
    rows = T.live(tape).select("index_code", "index_date", "methodology_version", "status", "value", "snapshot")
    files = on_file(rows, obs)
    kept = stored.select(*FIXING).distinct().withColumn("on_record", F.lit(True))
    judged = rows.join(files, "snapshot", "left").join(kept, FIXING, "left")
    reason = F.when(F.col("on_record").isNull(), (
        F.when(~F.col("methodology_version").isin(*versions), F.concat(F.lit("version "), "methodology_version", F.lit(" is not registered")))
        .when(F.trim(F.coalesce("snapshot", F.lit(""))) == "", "no snapshot is named")
        .when(F.col("on_file").isNull(), F.concat(F.lit("snapshot "), "snapshot", F.lit(" is not on file")))
    ))
    basis = F.when(F.col("on_record"), "stored").when(reason.isNull(), "recomputed").otherwise("refused")
    judged = written(judged.withColumns({"reason": reason, "basis": basis}).drop("on_file", "on_record"), "audited")
    again = judged.where("basis = 'recomputed'")
    prepared = P.prepare(wanted_runs(obs, again, versions), ["snapshot"], versions)
    fresh = E.contributions(P.quotes(prepared), FIXING, versions)
    shown = [*FIXING, "provider", "price", "weight", "screened_out"]
    return (
        judged.where("basis = 'stored'").join(stored.select(*shown), FIXING)
        .unionByName(again.join(fresh.select(*shown), FIXING, "left"))
        .unionByName(judged.where("basis = 'refused'"), allowMissingColumns=True)
    )


def dangling(tape: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of any revision that name a snapshot no longer on file."""
    return tape.where(F.trim("snapshot") != "").join(snapshots.select("snapshot"), "snapshot", "left_anti")


def verify_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))


def version_impact(rows: DataFrame, values: DataFrame, target: str, against: str | None = None) -> DataFrame:
    """Each live fixing under ``target`` beside the tape, or beside ``against``."""
    under = lambda v, name: values.where(F.col("methodology_version") == v).select(
        "snapshot", "index_code", F.col("published_value").alias(name)
    )
    out = rows.withColumnRenamed("methodology_version", "published_version").join(
        under(target, "recomputed"), ["snapshot", "index_code"], "left"
    )
    if against:
        out = out.join(under(against, "baseline"), ["snapshot", "index_code"], "left")
    else:
        out = out.withColumn("baseline", F.col("value"))
    b, r = F.col("baseline"), F.col("recomputed")
    differs = F.when(b.isNull() | r.isNull(), b.isNull() != r.isNull()).otherwise(
        F.abs(r - b) > rules.VERIFY_TOLERANCE
    )
    return out.withColumns(
        {"differs": differs, "change": F.when(b != 0, r / F.nullif(b, F.lit(0.0)) - 1.0)}
    ).select("index_code", "index_date", "published_version", "baseline", "recomputed", "differs", "change")


def impact_summary(impact: DataFrame) -> DataFrame:
    """Per index: fixings, how many differ or flip, and the median and largest move."""
    table = written(impact, "impact")
    moved = table.where("differs and change is not null").select(
        "index_code", F.abs("change").alias("size"), F.lit(1).alias("n")
    )
    median = grouped_median(moved, ["index_code"], "size", "median_move")
    return (
        table.groupBy("index_code")
        .agg(
            F.count(F.lit(1)).alias("fixings"),
            F.count_if("differs").alias("differ"),
            F.count_if(F.col("differs") & F.col("change").isNull()).alias("flips"),
            F.max_by(
                "change", F.when(F.col("differs") & F.col("change").isNotNull(),
                                 F.struct(F.abs("change").alias("size"), (-F.unix_date("index_date")).alias("d")))
            ).alias("largest_move"),
        )
        .join(median, "index_code", "left")
    )


def robustness(
    rows: DataFrame, quotes: DataFrame, versions: rules.Registry, bands: list[float]
) -> DataFrame:
    """Level and day-over-day jitter of each index at every robustness band, from restated quotes."""
    screened = E.screen(E.provider_votes(quotes, FIXING), FIXING)
    passed = E.fixings_of(screened, FIXING, versions).where("passed").select(*FIXING)
    return robustness_of(rows, screened, passed, versions, bands)


def robustness_of(
    rows: DataFrame, screened: DataFrame, passed: DataFrame, versions: rules.Registry, bands: list[float]
) -> DataFrame:
    """The sweep over votes that are screened already; ``passed`` names the fixings that clear their gates.

    The ballot does not depend on the band, so it is cast and ordered once and
    every band is a pair of conditional sums over it.
    """
    totals = written(E.tier_totals(screened, FIXING, versions), "tier-totals")
    weighted = E.with_weights(screened, totals, FIXING, versions)
    swept = E.interquantile_sweep(E.ballot(weighted, FIXING, versions), FIXING, bands)
    mean = weighted.groupBy(*FIXING).agg(
        (F.sum(F.col("price") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean")
    )
    series = written(
        rows.select("index_code", "index_date", "snapshot", "methodology_version")
        .join(passed, FIXING)
        .join(swept, FIXING)
        .join(mean, FIXING)
        .select(
            "index_code", "index_date", "band",
            F.when(F.col("band") >= 1.0, F.col("mean")).otherwise(F.col("value")).alias("value"),
        ),
        "band-series",
    )
    by_date = Window.partitionBy("index_code", "band").orderBy("index_date")
    moves = series.withColumn("move", F.abs(F.col("value") / F.lag("value").over(by_date) - 1.0))
    moved = written(
        moves.where("move is not null").select("index_code", "band", "move", F.lit(1).alias("n")), "band-moves"
    )
    median = grouped_median(moved, ["index_code", "band"], "move", "median_move")
    worst = moved.groupBy("index_code", "band").agg(F.max("move").alias("worst_move"))
    level = series.groupBy("index_code", "band").agg(
        F.avg("value").alias("level"), F.count(F.lit(1)).alias("fixings")
    )
    first = level.where(F.col("band") == bands[0]).select("index_code", F.col("level").alias("reference"))
    return (
        level.join(median, ["index_code", "band"], "left")
        .join(worst, ["index_code", "band"], "left")
        .join(first, "index_code", "left")
        .withColumn("versus_reference", F.col("level") / F.col("reference") - 1.0)
        .drop("reference")
    )


def exposure(quotes: DataFrame, keys: list[str], versions: rules.Registry) -> DataFrame:
    """Each fixing beside the same fixing from conforming quotes alone."""
    total = F.col("normalized_usd_per_gpu_hour") / F.col("usd_per_gpu_hour")
    conforming = F.abs(total - 1.0) <= rules.CONFORMING_TOLERANCE
    both = quotes.withColumn("conforming", conforming).select(
        "*",
        F.explode(
            F.when(F.col("conforming"), F.array(F.lit("all"), F.lit("conforming"))).otherwise(F.array(F.lit("all")))
        ).alias("basis"),
    )
    bkeys = [*keys, "basis"]
    screened = E.screen(E.provider_votes(both, bkeys), bkeys)
    totals = E.tier_totals(screened, bkeys, versions)
    values = written(E.publish_or_withhold(E.fixings_of(screened, bkeys, versions)), "exposure-values")
    side = lambda basis, **names: values.where(F.col("basis") == basis).select(
        *keys, *[F.col(c).alias(n) for n, c in names.items()]
    )
    adjusted = quotes.where(~conforming).select(*keys, F.col("source").alias("provider")).distinct()
    weighted = E.with_weights(screened, totals, bkeys, versions).where((F.col("basis") == "all") & ~F.col("screened_out"))
    touched = weighted.join(adjusted.withColumn("adjusted", F.lit(1.0)), [*keys, "provider"], "left")
    share = touched.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.col("weight") * F.col("adjusted")), F.lit(0.0)) / F.nullif(F.sum("weight"), F.lit(0.0)))
        .alias("weight_share_adjusted")
    )
    size = quotes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_quotes"),
        F.count_if(conforming).alias("conforming_quotes"),
        *[
            F.avg(F.when(test, 1.0).otherwise(0.0)).alias(f"share_{name}")
            for name, test in (
                ("form_factor", F.col("form_factor_x") != 1.0),
                ("interconnect", F.col("interconnect_x") != 1.0),
                ("commitment", F.col("commitment") != "on_demand"),
                ("node_size", F.col("node_x") != 1.0),
            )
        ],
    )
    out = (
        size.join(side("all", published="published_value"), keys, "left")
        .join(side("conforming", conforming_only="published_value", conforming_providers="provider_count",
                   publishable="passed"), keys, "left")
        .join(share, keys, "left")
    )
    return out.withColumns(
        {
            "conforming_providers": F.coalesce("conforming_providers", F.lit(0)),
            "publishable_without_adjustment": F.coalesce("publishable", F.lit(False)),
            "shift": (F.col("published") - F.col("conforming_only")) / F.nullif(F.col("conforming_only"), F.lit(0.0)),
        }
    ).drop("publishable")
