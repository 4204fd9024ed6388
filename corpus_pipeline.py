"""A cleaning pipeline over ``documents``: each stage takes what its predecessor kept and hands on the same columns.

The last stage returns the packed token pieces of what is left. ``run`` writes every stage's rows as Parquet below the
cluster's shared folder and reads them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language_id, near_duplicates, packing, repeated_passages
from gridloom.llm.common import free_name, stage

#: a document whose best language has a smaller share of the posterior is rejected, as is one without a letter
LEAST_LANGUAGE_SCORE = 0.3
#: bytes of a passage that counts as repeated
PASSAGE_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no determined language. The model learns from the documents' own texts and languages."""
    model = language_id.train(docs)
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    marked = language_id.predict(docs, model, lang_out=lang, score_out=score)
    language_id.forget(model)
    sure = (F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return marked.where(sure).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group (shingles of five words, similarity 0.8 or more)."""
    return near_duplicates.one_of_each_group(docs, words=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat out of the texts. A document that consists of them alone keeps its row with an empty text."""
    cut = repeated_passages.remove_repeats(docs, PASSAGE_BYTES)
    # a cut may fall inside a character: its rest is left out, as the character itself was removed
    text = F.when(F.size("_spans") == 0, F.col("text")).otherwise(F.col("_kept_text"))
    return cut.withColumn("text", text).withColumn(
        "n_chars", F.when(F.size("_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    ).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item of ``benchmark``, exactly or with few edits."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts, packed into sequences of 1024."""
    return packing.pack(packing.cut_pieces(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: SQL cannot express trained models, sketches and tokens; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
