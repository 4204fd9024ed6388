"""One query per operator, with production parameters over the whole table, and SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    decontamination, language_id, lattice_lm, license_scan, merkle_manifest, metric_join, near_duplicates, packing, quality, repeated_passages,
    secret_scan, token_output, whitening,
)
from gridloom.llm.common import held_out
from gridloom.llm.statements import SQL  # noqa: F401
from gridloom.runtime import stage_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, folder, "documents")))


@query
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = repeated_passages.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    runs = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (s["hi"] - s["lo"]))
    return docs.select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), runs.alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        F.when(F.size("_spans") == 0, F.col("text")).otherwise(F.col("_kept_text")).alias("kept_text"),
    )


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


@query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), words=3, percent=85).drop("key")


@query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, folder, "documents"))


@query
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out("doc_id", 10, 0).alias("held_out"))
    return lattice_lm.score_texts(docs)


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    model = language_id.train(docs.where(~F.col("held_out")))
    made = language_id.predict(docs.select("doc_id", "held_out", "text"), model)
    language_id.forget(model)
    return made.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{stage_root(spark)}/training-order-{uuid.uuid4().hex}"
    return token_output.write_training_order(table(spark, folder, "documents"), path)


@query
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.vector_links(table(spark, folder, "embeddings"), 0.93)


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels.where(~held_out("doc_id", 5, 0)))
    rated = quality.score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model)
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    made = whitening.whiten(table(spark, folder, "embeddings"), 8)
    return made.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    forged = F.when(even, F.replace("text", F.lit("\n"), F.lit("")))
    made = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], forged)
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings("proof"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    counts = [F.size(secret_scan.of_kind("secrets", kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE]
    base = F.sha2(secret_scan.listed(secret_scan.of_kind("secrets", *secret_scan.BASE)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.listed("secrets").alias("spans"))
