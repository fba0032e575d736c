"""The registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, decontaminate, katz, licenses, merkle, mixing, quality, sharding, simhash, suffixes, tokens, toxicity
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@_query("op2_pfair_mix", mixing.sql())
def pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).selectExpr("doc_id", "coalesce(source, '') as source", "block", "slot", "place")


@_query("op3_license_scan", licenses.sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@_query("op10_table_sharding", sharding.sql())
def table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


@_query("op4_simhash_components")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex64(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id")
    )


@_query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count(docs, tokens.vocabulary_file(), limit=tokens.LIMIT).drop("text")


@_query("op9_decision_list")
def decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *base, "base_failed", "kept", "rule")


@_query("op5_template_leaks")
def template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op1_toxicity_scores")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), toxicity.HELD_OUT).alias("held_out"), "score", "predicted"
    )


@_query("op6_katz_scores")
def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.evaluate(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query("op8_suffix_dedup", suffixes.sql())
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@_query("op11_centroid_clusters", centroids.sql())
def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, means = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.report(rows, means).withColumnRenamed("id", "vec_id")


@_query("op12_merkle_manifest", merkle.sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.digest(*cut))
    found = merkle.manifest(docs, keep={"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    told = found.withColumns({"proof_sha256": F.sha2(merkle.siblings(F.col("proof")), 256), "folded_root": folded})
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", F.expr("folded_root = root").alias("verified"))


@_query("op13_neighbour_search")
def neighbour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % ann.EVERY == 0)
    return ann.nearest(ann.build(vectors), asked, own=True).withColumnRenamed("id", "vec_id")
