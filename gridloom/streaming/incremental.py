"""Work that is spread over several runs: counters with a commit log, results with a key index, responses with keyed state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridloom.functions.rules import CORPUS_MARKS
from gridloom.plans.corpus import usage_by_language
from gridloom.runtime import join_null_safe

#: folders that the keys of finished items are dealt to
BUCKETS = 256
#: keyed state with a start value needs the RocksDB store
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_name(checkpoint: str) -> str:
    """Names the files of one checkpoint, whose batch numbers start at 0, apart from those of another."""
    return "r" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def read_if_there(spark: SparkSession, path: str, **options: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing is there yet."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None, mode: str = "append") -> StreamingQuery:
    """Run ``write`` on every micro-batch; without ``every`` until the present files are done."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# ---------------------------------------------------------------- counters


def resumable_counts(
    files: DataFrame,
    store: str,
    checkpoint: str,
    content: str = "content",
    lang: str = "lang",
    rules: dict[str, dict[str, list[str]]] = CORPUS_MARKS,
    every: str | None = None,
    before_snapshot: Callable[[int], None] = lambda batch: None,
) -> StreamingQuery:
    """Usage counters per language, each file counted once whatever fails in between.

    A micro-batch writes its own counts (``deltas``), then the totals up to it (``snapshots``), then a row of the commit
    log (``log``); a batch that is replayed writes the same three over. Totals add the batch's counts to the last snapshot
    that the log names, so one that was half written is never read. Nothing is kept in operator state: a run may
    go on with another number of shuffle partitions, and a batch reads one snapshot of a row per language, however many
    went before. ``before_snapshot`` is called between the first two writes.
    """

    def write(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        delta = f"{store}/deltas/batch={batch}"
        usage_by_language(batch_df, content, lang, rules).write.mode("overwrite").parquet(delta)
        before_snapshot(batch)
        counts = spark.read.parquet(delta)
        last = last_commit(spark, store, batch)
        if last is not None:
            counts = counts.unionByName(spark.read.parquet(f"{store}/snapshots/batch={last}"))
        names = [c for c in counts.columns if c != "lang"]
        totals = counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in names])
        totals.coalesce(1).write.mode("overwrite").parquet(f"{store}/snapshots/batch={batch}")
        committed = spark.range(1).select(F.lit(last).cast("bigint").alias("follows"), F.current_timestamp().alias("at"))
        committed.coalesce(1).write.mode("overwrite").parquet(f"{store}/log/batch={batch}")

    return start(files, write, checkpoint, every)


def last_commit(spark: SparkSession, store: str, before: int | None = None) -> int | None:
    """Number of the last batch in the commit log, or None; with ``before`` the last below it."""
    log = read_if_there(spark, f"{store}/log")
    if log is None:
        return None
    if before is not None:
        log = log.where(F.col("batch") < before)
    return log.agg(F.max("batch")).first()[0]


def read_counts(spark: SparkSession, store: str) -> DataFrame | None:
    """The totals of the last committed batch, or None before the first."""
    last = last_commit(spark, store)
    return None if last is None else spark.read.parquet(f"{store}/snapshots/batch={last}")


# ---------------------------------------------------------------- results


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def append_new(
    items: DataFrame,
    target: str,
    checkpoint: str,
    keys: list[str],
    work: Callable[[DataFrame], DataFrame] = lambda df: df,
    order: Column | str | None = None,
    every: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Work on the items whose keys no earlier batch or run has worked on, and append the results.

    Keys of finished items form an index, ``target/keys``, in folders by a hash of the keys. A micro-batch lists and
    reads only the folders that its own keys fall into, and of those only the keys; earlier results are never read. Null is
    a key like any other. Of several items with one key the first by ``order`` counts (without it, one that is the same in
    every attempt). A run is named by its checkpoint: a replayed batch ignores what it wrote itself and writes it
    over; a run with a fresh checkpoint goes through all files again and finds only what is new. One run may
    write at a time.
    """
    own = {"bucket", "run", "batch"} & set(keys)
    if own:
        raise ValueError(f"keys must not be called {sorted(own)}")
    run = run_name(checkpoint)

    def write(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        others = [c for c in batch_df.columns if c not in keys]
        picked = [F.col(f"`{c}`") for c in others]
        by = F.xxhash64(*picked) if order is None and others else order if order is not None else F.lit(0)
        fresh = batch_df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(F.lit(0).alias("_"), *picked), by).alias("_first"))
        fresh = fresh.select(*[F.col(f"`{k}`") for k in keys], "_first.*").select(*[F.col(f"`{c}`") for c in batch_df.columns])
        held = fresh.withColumn("_bucket", bucket_of(keys, buckets)).persist()
        try:
            fresh = held
            touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
            done = finished_keys(spark, target, touched)
            if done is not None:
                done = done.where((F.col("run") != run) | (F.col("batch") != batch)).select(*[F.col(f"`{k}`") for k in keys])
                fresh = join_null_safe(fresh, done, keys, "left_anti")
            work(fresh.drop("_bucket")).write.mode("overwrite").parquet(f"{target}/results/run={run}/batch={batch}")
            index = fresh.select(*[F.col(f"`{k}`") for k in keys], F.col("_bucket").alias("bucket"), F.lit(run).alias("run"), F.lit(batch).alias("batch"))
            index = index.repartition("bucket").write.partitionBy("bucket", "run", "batch").option("partitionOverwriteMode", "dynamic")
            index.mode("overwrite").parquet(f"{target}/keys")
        finally:
            held.unpersist()

    return start(items, write, checkpoint, every)


def finished_keys(spark: SparkSession, target: str, buckets: list[int]) -> DataFrame | None:
    """The index folders of the given buckets, or None if there are none."""
    if not buckets:
        return None
    return read_if_there(spark, f"{target}/keys/bucket={{{','.join(map(str, buckets))}}}", basePath=f"{target}/keys")


def read_new(spark: SparkSession, target: str) -> DataFrame | None:
    """Results of all runs with their ``run`` and ``batch``, or None before the first."""
    return read_if_there(spark, f"{target}/results")


# ---------------------------------------------------------------- responses


class FirstResponse(StatefulProcessor):
    """Keeps the first response of a key and counts who asked; a row per key and micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "response string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best, requests = None, 0
        for row in rows:
            requests += row["_requests"]
            place = (row["_order"] is None, row["_order"])
            if best is None or place[0] < best[0][0] or place[0] == best[0][0] is False and place[1] < best[0][1]:
                best = (place, row["_response"])
        is_new = not self.kept.exists()
        if is_new:
            self.kept.update((best[1],))
        response = best[1] if is_new else self.kept.get()[0]
        yield Row(_key=key[0], _response=response, is_new=is_new, requests=requests)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.kept.update((initialState["_response"],))

    def close(self) -> None:
        pass


def _first_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key and Arrow batch, with the number of requests: a key that everybody asks for travels once."""
    for frame in frames:
        if len(frame):
            frame = frame.assign(_requests=1).sort_values("_order", na_position="last", kind="stable")
            by_key = frame.groupby("_key", sort=False)
            yield by_key.head(1).assign(_requests=by_key["_requests"].transform("sum"))


def cache_responses(
    responses: DataFrame, cache: str, checkpoint: str, keys: list[str], order: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Append responses to the cache, each key once, and count how often a cached one is used again.

    The first response of a key is kept in operator state, so the cache itself is read only once, when a run starts with a
    fresh checkpoint: its keys are then the initial state. Within a micro-batch the first by ``order`` (a column) counts;
    equal keys are brought together in the map tasks. Null is a key like any other. Each batch writes
    ``cache/run=<checkpoint>/batch=<n>`` with a row per key asked for: its columns, ``is_new`` and ``requests``. A replayed
    batch writes the same rows over. Keys and responses travel as JSON.
    """
    spark = responses.sparkSession
    run = run_name(checkpoint)
    others = [c for c in responses.columns if c not in keys]
    payload = F.struct(F.lit(0).alias("_"), *others)  # there may be no column but the keys
    key_type, other_type = responses.select(*keys).schema, responses.select(payload.alias("r")).schema["r"].dataType
    by = F.col(order) if order else F.xxhash64(*others) if others else F.lit(0)
    asked = responses.select(F.to_json(F.struct(*keys)).alias("_key"), F.to_json(payload).alias("_response"), by.alias("_order"))
    kind = asked.schema["_order"].dataType.simpleString()
    once = asked.mapInPandas(_first_of_batch, f"_key string, _response string, _order {kind}, _requests long")
    known = read_cache(spark, cache)
    if known is None:
        seed = spark.createDataFrame([], "_key string, _response string")
    else:
        known = known.where(F.col("run") != run)
        seed = known.select(F.to_json(F.struct(*keys)).alias("_key"), F.to_json(payload).alias("_response"))
    found = once.groupBy("_key").transformWithState(
        FirstResponse(), "_key string, _response string, is_new boolean, requests long", "Update", "None", seed.groupBy("_key")
    )
    table = found.select(F.from_json("_key", key_type).alias("_k"), F.from_json("_response", other_type).alias("_r"), "is_new", "requests")
    table = table.select("_k.*", *[F.col(f"_r.`{c}`") for c in others], "is_new", "requests").select(*responses.columns, "is_new", "requests")

    def write(batch_df: DataFrame, batch: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{cache}/run={run}/batch={batch}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start(table, write, checkpoint, every, "update")
    finally:  # the query keeps the setting it started with
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    """Every cached response once, or None before the first."""
    rows = read_if_there(spark, cache)
    return None if rows is None else rows.where("is_new")


def reuse_counts(spark: SparkSession, cache: str, keys: list[str]) -> DataFrame:
    """``keys, requests, reused``: how often a key was asked for and how often its response was there already."""
    rows = spark.read.parquet(cache)
    return rows.groupBy(*keys).agg(F.sum("requests").alias("requests"), (F.sum("requests") - F.count_if("is_new")).alias("reused"))
