"""Position-aware building blocks: bucketed scans, distributed ranks, group minima.

Vectors are DataFrames with an explicit integer position. No step here sorts a whole vector
in one task: scans work on buckets of 2**bits positions with a second level above them, ranks
on a range-partitioned copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import join_null_safe, shuffle_width, stage

BUCKET_BITS = 16
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(how: str, local: Column, before: Column) -> Column:
    """Combine a value inside a bucket with what came before it; either may be null (empty)."""
    if how == "sum":
        return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(local + before)
    return F.least(local, before) if how == "min" else F.greatest(local, before)


def running(
    df: DataFrame,
    index: str,
    value: str,
    out: str = "scan",
    how: str = "sum",
    keys: list[str] | None = None,
    exclusive: bool = False,
    bits: int = BUCKET_BITS,
    levels: int = 2,
) -> DataFrame:
    """Running sum/min/max of ``value`` in ``index`` order, per ``keys``.

    ``levels`` bucket levels sit above the rows; with two levels of 16 bits the last, single-window
    step sees one row per 2**32 positions. An exclusive scan leaves null where nothing came before.
    """
    keys = keys or []
    agg = _AGG[how]
    frame_end = -1 if exclusive else 0
    if levels == 0:
        frame = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.withColumn(out, agg(value).over(frame))

    bucket = f"_b{levels}"
    rows = df.withColumn(bucket, F.shiftright(F.col(index).cast("bigint"), bits))
    totals = rows.groupBy(*keys, bucket).agg(agg(value).alias("_total"))
    before = running(totals, bucket, "_total", f"_before{levels}", how, keys, True, bits, levels - 1)
    before = before.select(*keys, bucket, f"_before{levels}")
    frame = Window.partitionBy(*keys, bucket).orderBy(index).rowsBetween(Window.unboundedPreceding, frame_end)
    return (
        join_null_safe(rows.withColumn("_local", agg(value).over(frame)), before, [*keys, bucket], "left")
        .withColumn(out, _merge(how, F.col("_local"), F.col(f"_before{levels}")))
        .select(*df.columns, out)
    )


def ordinal(df: DataFrame, index: str, out: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """0-based ordinal of each row by a unique integer ``index``, per ``keys``; no sort of whole groups."""
    counted = running(df.withColumn("_one", F.lit(1).cast("bigint")), index, "_one", "_seen", "sum", keys)
    return counted.withColumn(out, F.col("_seen") - 1).drop("_one", "_seen")


def rank_rows(
    df: DataFrame,
    order_by: list[str],
    out: str = "pos",
    keys: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """0-based position of each row in sorted order (per ``keys``, of which null is one), ties broken by ``order_by``.

    One range exchange on (keys, order_by) splits hot keys and hot values alike as long as
    ``order_by`` ends in a unique column. The sorted copy is staged once; each partition knows its
    local row numbers, so only one small table of (key, partition) offsets is left to compute.
    """
    keys = keys or []
    n = partitions or shuffle_width(df.sparkSession)
    ranged = (
        df.repartitionByRange(n, *keys, *order_by)
        .sortWithinPartitions(*keys, *order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    staged = (
        stage(ranged, "rank")
        .withColumn("_part", F.shiftright("_mid", LOCAL_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND((1 << LOCAL_BITS) - 1))
        .drop("_mid")
    )
    segments = staged.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_local").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    if not keys:  # one row per partition: bounded by the partition count
        offsets = F.broadcast(offsets)
    return (
        join_null_safe(staged, offsets, [*keys, "_part"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .select(*df.columns, out)
    )


def length(df: DataFrame, index: str) -> Column:
    """Vector length (last position + 1) as a scalar subquery."""
    return df.agg(F.coalesce(F.max(index) + 1, F.lit(0)).cast("bigint")).scalar()


def group_min(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Minimum of ``value`` per group written back to every row: map-side aggregate, then a join."""
    low = df.groupBy(*keys).agg(F.min(value).alias(out))
    return join_null_safe(df, low, keys, "left")
