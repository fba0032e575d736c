"""From raw documents to mixed and placed ones: five stages, each written and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a table. ``docs`` is what the stage
before kept, read from its files; all stages but the last return the columns of
``documents``.

1. Quality rules: what the base rules or the learned decision list reject goes.
2. Near-duplicates: of texts that share four in five of their five-word shingles one stays.
3. Decontamination: texts in which an item of ``benchmark`` was found go.
4. Mixing: nothing goes; the rows are put into the order in which their sources meet
   the target weights, which is the order of the written files and the rows in them.
5. Sharding: every row gets its shard, and where it stands in the mixed order (``part``
   and ``row``), so a shard read in that order is mixed as well.

Empty tables, null texts, keys and sources, repeated rows and extra columns pass through
as the operators say; a null or empty text fails the base rules and goes in stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwright.llm import decontaminate, mixing, quality, sharding, simhash
from fixwright.llm.common import shadowed, table
from fixwright.sources.staging import written

WORDS, SIMILARITY = 5, 0.8
RADIUS = 22  # bits of 64 within which texts that similar lie, but for a few in ten thousand


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passed(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=WORDS, radius=RADIUS, keys=simhash.MINIMA, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def table_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = docs.metadataColumn("_metadata")
    ordered = shadowed(docs, "part", "row").select(
        "*", F.regexp_extract(at["file_name"], r"part-(\d+)", 1).cast("int").alias("part"), at["row_index"].alias("row")
    )
    return sharding.place(ordered)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", table_sharding),
]

#: The learned list, the similarity and the template matches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
