"""Verification that computes again only what has changed since the last time.

Beside every recomputed fixing stands the basis it was computed on: a digest of its run's
archived rows, of the rule version and of the code that applies it. A verification reads
the named runs once to take their digests, computes the (run, version) pairs whose basis
is not on record, records them with one commit, and compares the tape with the record.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import labels, order_stats, regions
from ..operators import estimate, evidence, prepare
from ..operators import reproduce as R
from ..operators import tape as T
from ..sources import commits
from ..sources.staging import written

PAIR = ["snapshot", "methodology_version"]
DONE = "snapshot string, methodology_version string, basis string"
VALUES = f"{DONE}, index_code string, published_value double, venue_holdouts string"
#: What a recomputation runs through.
CODE = (rules, labels, order_stats, regions, estimate, evidence, prepare, R)


def code_digest() -> str:
    """Of the text of the modules that compute a fixing."""
    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in CODE)).hexdigest()


def rule_digests(versions: rules.Registry) -> dict[str, str]:
    return {name: hashlib.sha256(repr((row, rules.CONTRACTS)).encode()).hexdigest() for name, row in versions.items()}


def run_digests(obs: DataFrame) -> DataFrame:
    """Rows (snapshot, run_digest): a digest of each run's rows, in any order, repeated ones as often as they occur."""
    row = F.to_json(F.struct(*sorted(c for c in obs.columns if c != "snapshot")))
    half = lambda seed: F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)"))
    sums = obs.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), half(1).alias("low"), half(2).alias("high"))
    return sums.select("snapshot", F.sha2(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n", "low", "high")]), 256).alias("run_digest"))


@dataclass
class Verification:
    """Every live value with its verdict, and the (snapshot, methodology_version) pairs that were computed for it."""

    verdicts: DataFrame
    computed: DataFrame


def verify(tape: DataFrame, obs: DataFrame, store: str, versions: rules.Registry | None = None) -> Verification:
    """Verify the live values of a tape; ``store`` is the folder that keeps what was recomputed.

    A pair is computed anew if a row of its run, its rule version or the code has changed,
    or if it was never computed. Rows of runs that no live value names are not read.
    """
    versions = versions or rules.registry()
    spark = tape.sparkSession
    rows = T.live(tape)
    pairs = rows.select(*PAIR).where(F.col("methodology_version").isin(*versions) & (F.trim("snapshot") != "")).distinct()
    named = written(pairs.select("snapshot").distinct(), "named-runs").where(F.length("snapshot") > 0)
    digests = run_digests(obs.join(named, "snapshot", "left_semi"))
    rule = F.element_at(rules.literal(rule_digests(versions)), F.col("methodology_version"))
    basis = F.sha2(F.concat_ws(" ", "run_digest", rule, F.lit(code_digest())), 256)
    now = written(pairs.join(digests, "snapshot").select(*PAIR, basis.alias("basis")), "bases")

    attempt = commits.begin(spark, store, f"verify-{uuid.uuid4().hex}")
    todo = written(now.join(attempt.read("pairs", DONE), [*PAIR, "basis"], "left_anti"), "changed-bases")
    if not todo.isEmpty():
        values, holdouts = R.recompute(obs, todo, versions)
        cells = values.select(*R.FIXING, "published_value").join(holdouts.select(*R.FIXING, "venue_holdouts"), R.FIXING, "full")
        attempt.write("values", cells.join(todo, PAIR).select(*[f.split()[0] for f in VALUES.split(", ")]))
        attempt.write("pairs", todo)
        attempt.commit()
    known = written(commits.read(spark, store, "values", VALUES).join(now, [*PAIR, "basis"], "left_semi"), "known-values")
    verdicts = R.judge(rows, R.on_file(rows, obs), known, known.where("venue_holdouts is not null"), versions)
    return Verification(verdicts, todo.select(*PAIR))
