"""Checks over run history: stalled and truncated feeds, old captures, sudden moves.

The history is read once, into a row for each feed and run; runs are numbered from that
table and every check looks at a fixed number of neighbouring runs, so each row is copied
a fixed number of times and nothing is paired within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..sources.staging import written
from . import tape as T


def run_numbers(obs: DataFrame, run: str) -> DataFrame:
    """Consecutive numbers for the runs. One row per run: the history, not the data."""
    runs = obs.select(run).distinct()
    return runs.select(
        run,
        F.dense_rank().over(Window.orderBy(run)).alias("run_no"),
        F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("last_no"),
    )


def recent_runs(obs: DataFrame, run: str, n: int) -> DataFrame:
    """Observations of the newest n runs."""
    keep = obs.select(run).distinct().orderBy(F.desc(run)).limit(n)
    return obs.join(keep, run, "left_semi")


def set_signatures(prints: DataFrame, keys: list[str], *also: Column) -> DataFrame:
    """Size and 128-bit sum of each group's different fingerprints, in any order, and ``also`` other aggregates.

    Equal sets have equal signatures, and signatures of parts without a fingerprint in
    common add up to that of the whole, so a set need not be read again to grow.
    """
    half = lambda seed: F.sum(F.xxhash64("fingerprint", F.lit(seed)).cast("decimal(38,0)"))
    return prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), half(1).alias("low"), half(2).alias("high"), *also)


def stalled(signatures: DataFrame, run: str) -> DataFrame:
    """Feeds whose set of quotes is the same in every run of the last four that has any, from a signature of each feed and run."""
    span = rules.STALE_RUNS + 1
    runs = run_numbers(signatures, run)
    spread = signatures.join(runs, run).select(
        "source", "run_no", F.struct("n", "low", "high").alias("held"),
        F.explode(F.sequence("run_no", F.least(F.col("run_no") + span - 1, F.col("last_no")))).alias("at_no"),
    )
    return (
        spread.groupBy("at_no", "source")
        .agg(F.min("held").alias("least"), F.max("held").alias("most"), F.max("run_no").alias("newest"))
        .where((F.col("at_no") >= span) & (F.col("newest") == F.col("at_no")) & (F.col("least") == F.col("most")))
        .join(runs.select(run, F.col("run_no").alias("at_no")), "at_no")
        .select(run, "source", F.lit("warn").alias("severity"), F.lit("feed_possibly_stalled").alias("code"))
    )


def feed_stall(obs: DataFrame, run: str) -> DataFrame:
    """Stalled feeds of a history of observations, whose quotes are read once."""
    prints = obs.select(run, "source", "fingerprint").distinct()
    return stalled(written(set_signatures(prints, [run, "source"]), "signatures"), run)


def feed_history(obs: DataFrame, run: str) -> DataFrame:
    """A row for each feed and run, for ``stalled`` and ``dropped`` alike: signature and ``rows``; observations are read once."""
    prints = obs.groupBy(run, "source", "fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    return written(set_signatures(prints, [run, "source"], F.sum("rows").alias("rows")), "feed-history")


def feed_dropout(obs: DataFrame, run: str, prior: int = 5) -> DataFrame:
    """Feeds whose row count fell below half their mean over the runs just before."""
    return dropped(written(obs.groupBy(run, "source").agg(F.count(F.lit(1)).alias("n")), "feed-sizes"), run, prior)


def dropped(sizes: DataFrame, run: str, prior: int = 5) -> DataFrame:
    """``feed_dropout`` from a row with the number of rows, ``n``, for each feed and run."""
    runs = run_numbers(sizes, run)
    counts = sizes.join(runs, run)
    ahead = (
        counts.where(F.col("run_no") < F.col("last_no"))
        .select(
            "source", "n",
            F.explode(
                F.sequence(F.col("run_no") + 1, F.least(F.col("run_no") + prior, F.col("last_no")))
            ).alias("run_no"),
        )
    )
    norm = ahead.groupBy("run_no", "source").agg(F.avg("n").alias("recent_rows"))
    now = counts.select("run_no", "source", F.col("n").alias("rows"))
    return (
        norm.where(F.col("run_no") >= 3)
        .join(now, ["run_no", "source"], "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .where((F.col("recent_rows") >= 4) & (F.col("rows") < F.col("recent_rows") * rules.DROPOUT_RATIO))
        .join(runs.drop("last_no"), "run_no")
        .select(
            run, "source", "rows", "recent_rows",
            F.when(F.col("rows") == 0, "error").otherwise("warn").alias("severity"),
            F.lit("provider_dropout").alias("code"),
        )
    )


def stale_capture(obs: DataFrame, run: list[str], now) -> DataFrame:
    """Live feeds serving observations more than six hours older than ``now``."""
    late = F.col("observed_at") < now - F.expr(f"INTERVAL {rules.STALE_CAPTURE_HOURS} HOURS")
    return (
        obs.where(~F.col("source").startswith("curated:") & late)
        .groupBy(*run, "source")
        .agg(F.count(F.lit(1)).alias("stale_rows"))
    )


def adjustment_load(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of quotes needing a quarter or more of markup; flagged from one half."""
    # The markup is read back off the two prices, as an auditor would.
    total = F.col("normalized_usd_per_gpu_hour") / F.col("usd_per_gpu_hour")
    heavy = F.when(total >= rules.HEAVY_ADJUSTMENT, 1.0).otherwise(0.0)
    return quotes.groupBy(*keys).agg(F.avg(heavy).alias("heavy_share"), F.count(F.lit(1)).alias("quotes")).withColumn(
        "flagged", F.col("heavy_share") >= 0.5
    )


def level_shift(candidates: DataFrame, threshold) -> DataFrame:
    """Candidates that moved more than the review threshold from the previous fixing.

    ``candidates`` carries ``value`` (published or not) and ``previous`` from
    ``tape.previous_published``.
    """
    prior = F.col("previous.value")
    return (
        candidates.where(F.col("value").isNotNull() & (prior != 0))
        .withColumn("move", F.col("value") / prior - 1.0)
        .where(F.abs((F.col("value") - prior) / prior) > threshold)
    )


def provider_moves(votes: DataFrame, tape: DataFrame) -> DataFrame:
    """Each contributor's move since the fixing just before, under the version its date was published by."""
    key = T.KEY
    previous = T.previous_published(tape).select(
        *key, "methodology_version", F.col("previous.index_date").alias("previous_date")
    ).where(F.col("previous_date").isNotNull())
    now = votes.where(~F.col("screened_out")).select(*key, "methodology_version", "provider", "price")
    owner = T.live(tape).select(*key, "methodology_version")
    before = now.join(owner, [*key, "methodology_version"], "left_semi").select(
        "index_code", F.col("index_date").alias("previous_date"), "provider", F.col("price").alias("before")
    )
    return (
        now.join(previous, [*key, "methodology_version"])
        .join(before, ["index_code", "previous_date", "provider"])
        .where(F.col("before") > 0)
        .withColumn("move", (F.col("price") - F.col("before")) / F.col("before"))
    )


def corroborating_movers(votes: DataFrame, tape: DataFrame) -> DataFrame:
    """Contributors that moved enough to bear another one out, a row each, with the way they went.

    The peers behind a shift are the rows of its fixing and way but its own; listing them
    once for each way keeps a panel from being paired with itself.
    """
    moves = provider_moves(votes, tape).where(F.abs("move") >= rules.CORROBORATING_MOVE)
    return moves.withColumn("way", F.when(F.col("move") > 0, "up").otherwise("down"))


def provider_level_shift(votes: DataFrame, tape: DataFrame, versions: rules.Registry) -> DataFrame:
    """Contributors that moved a quarter or more since the last fixing, and whether others did.

    ``votes`` holds one row per provider of every (index, date) under the version
    the date was published by. Peers are counted per fixing and the provider's
    own move is taken off its own count.
    """
    key = T.KEY
    moves = provider_moves(votes, tape)
    up = F.col("move") >= rules.CORROBORATING_MOVE
    down = F.col("move") <= -rules.CORROBORATING_MOVE
    panel = moves.groupBy(*key).agg(
        F.count(F.lit(1)).alias("movers"), F.count_if(up).alias("ups"), F.count_if(down).alias("downs")
    )
    same_way = F.when(F.col("move") > 0, F.col("ups")).otherwise(F.col("downs")) - 1
    verdict = (
        F.when(~rules.rules_of(versions)["jump_corroboration"], "provider_level_shift")
        .when(F.col("peers") < rules.CORROBORATION_MIN_PEERS, "provider_level_shift")
        .when(F.col("same_way") >= rules.CORROBORATIONS_REQUIRED, "provider_level_shift_corroborated")
        .otherwise("provider_level_shift_uncorroborated")
    )
    return (
        moves.where(F.abs("move") > rules.PROVIDER_LEVEL_SHIFT)
        .join(panel, key)
        .withColumns({"peers": F.col("movers") - 1, "same_way": same_way})
        .withColumn("code", verdict)
        .withColumn("severity", F.when(F.col("code") == "provider_level_shift_corroborated", "info").otherwise("warn"))
        .select(*key, "methodology_version", "provider", "previous_date", "before", "price", "move",
                "peers", "same_way", "code", "severity")
    )


def flag_log(flags: DataFrame, run) -> DataFrame:
    """Flags of one run in the order they were raised."""
    return flags.where(F.col("run_id") == run).orderBy("flag_id")
