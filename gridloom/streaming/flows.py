"""Structured Streaming flows: file streams and corpus counters in operator state.

They resume from a checkpoint folder and rewrite a micro-batch that is replayed after a
failure instead of adding it twice. Work over several runs is in ``incremental``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridloom.functions.rules import CORPUS_MARKS
from gridloom.plans.corpus import usage_by_language


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def count_corpus(
    files: DataFrame,
    snapshot: str,
    checkpoint: str,
    content: str = "content",
    lang: str = "lang",
    rules: dict[str, dict[str, list[str]]] = CORPUS_MARKS,
    every: str | None = None,
) -> StreamingQuery:
    """Running usage counters per language. State is one row per language, so it needs no watermark.

    Every trigger writes the whole state to ``snapshot/batch=<n>``; ``latest_snapshot`` reads the last.
    With ``every`` the query keeps running, else it stops when the present files are done.
    """
    counters = usage_by_language(files, content, lang, rules)

    def write(state: DataFrame, batch: int) -> None:
        state.coalesce(1).write.mode("overwrite").parquet(f"{snapshot}/batch={batch}")

    writer = counters.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    states = spark.read.parquet(snapshot)
    return states.where(F.col("batch") == states.agg(F.max("batch")).scalar()).drop("batch")
