"""Labels matched against an alias table of any size.

A contract's aliases may be many and come as a table: then they are not literals in the
plan but a join. An alias matches a whole label or its leading words. Each different
label is read once; its leading words, as many as the longest alias has, are looked up
by equality, and the longest that is found names the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import labels
from ..sources.staging import written


def registered(spark: SparkSession) -> DataFrame:
    """The registry's own aliases as such a table: rows (code, alias, place), in registry order."""
    pairs = [(code, alias) for code, c in rules.CONTRACTS.items() for alias in c["aliases"]]
    return spark.createDataFrame([(code, alias, i) for i, (code, alias) in enumerate(pairs)], "code string, alias string, place long")


def tokens(aliases: DataFrame) -> DataFrame:
    """Rows (token, code): what an alias is compared as, and of several codes that claim it the first by ``place``."""
    token = F.array_join(labels.words("alias"), " ")
    rows = aliases.select(token.alias("token"), F.struct("place", "code").alias("claim")).where("token <> ''")
    return rows.groupBy("token").agg(F.min("claim").alias("claim")).select("token", "claim.code")


def matched(rows: DataFrame, aliases: DataFrame, label: str = "gpu_model") -> DataFrame:
    """Rows (label, index_code) for each different label, the code null where no alias leads it."""
    table = written(tokens(aliases), "alias-tokens")
    longest = table.agg(F.max(F.size(F.split("token", " ")))).first()[0] or 0
    shown = rows.select(label).where(F.col(label).isNotNull()).distinct()
    lead = F.slice(labels.words(label), 1, longest) if longest else F.array().cast("array<string>")
    # a label of no words has one, the empty one
    runs = F.transform(lead, lambda _, i: F.struct((i + 1).alias("words"), F.array_join(F.slice("lead", 1, i + 1), " ").alias("token")))
    hits = shown.withColumn("lead", lead).select(label, F.explode(runs).alias("r")).select(label, "r.words", "r.token").join(table, "token")
    best = hits.groupBy(label).agg(F.max_by("code", "words").alias("index_code"))
    return written(shown.join(best, label, "left"), "label-codes")


def with_code(rows: DataFrame, aliases: DataFrame, label: str = "gpu_model") -> DataFrame:
    """``rows`` with the ``index_code`` that the alias table gives their label; a common label is no heavier than a rare one."""
    return rows.join(matched(rows, aliases, label), label, "left")
