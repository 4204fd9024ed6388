"""Prefix scans over vectors ``(i, x)``, built on the bucketed scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.index import BUCKET_BITS, length, running


def prefix_sum(df: DataFrame, index: str = "i", x: str = "x", keys: list[str] | None = None, **kw) -> DataFrame:
    return running(df, index, x, "scan", "sum", keys, **kw)


def partial_minimums(df: DataFrame, index: str = "i", x: str = "x", keys: list[str] | None = None, **kw) -> DataFrame:
    return running(df, index, x, "scan", "min", keys, **kw)


def partial_maximums(df: DataFrame, index: str = "i", x: str = "x", keys: list[str] | None = None, **kw) -> DataFrame:
    return running(df, index, x, "scan", "max", keys, **kw)


def sum_of_prefix_sums(df: DataFrame, index: str = "i", x: str = "x", out: str = "result") -> DataFrame:
    """Element i occurs in n - i prefixes, so one weighted sum replaces the scan."""
    # sum x*(n-i) = n*sum(x) - sum(x*i): one pass, no length lookup
    n = F.coalesce(F.max(index) + 1, F.lit(0))
    return df.agg(F.coalesce(n * F.sum(x) - F.sum(F.col(x) * F.col(index)), F.lit(0)).alias(out))


def reverse_prefix_sum(df: DataFrame, index: str = "i", x: str = "x", **kw) -> DataFrame:
    """Prefix sum of the reversed vector; ``index`` of the result counts from the far end."""
    flipped = df.withColumn(index, length(df, index) - 1 - F.col(index))
    return running(flipped, index, x, "scan", "sum", **kw)


def maximum_subarray(
    df: DataFrame, index: str = "i", x: str = "x", out: str = "result", bits: int = BUCKET_BITS
) -> DataFrame:
    """Largest sum of a non-empty contiguous run.

    One shuffle by bucket summarises each bucket by (total, lowest prefix, highest prefix, best run
    inside); the summaries are combined with two scans over the much smaller bucket table.
    """
    in_order = Window.partitionBy("_b").orderBy(index)
    rows = df.select(
        F.shiftright(F.col(index).cast("bigint"), bits).alias("_b"), index, F.col(x).cast("bigint").alias("_x")
    )
    local = rows.withColumn("_p", F.sum("_x").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_low", F.min("_p").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    buckets = local.groupBy("_b").agg(
        F.sum("_x").alias("_total"),
        F.min("_p").alias("_minp"),
        F.max("_p").alias("_maxp"),
        F.max(F.col("_p") - F.least(F.lit(0), F.coalesce("_low", F.lit(0)))).alias("_best"),
    )
    placed = running(buckets, "_b", "_total", "_start", "sum", exclusive=True, bits=bits, levels=1)
    placed = placed.withColumn("_start", F.coalesce("_start", F.lit(0))).withColumn(
        "_floor", F.col("_start") + F.col("_minp")
    )
    carried = running(placed, "_b", "_floor", "_before", "min", exclusive=True, bits=bits, levels=1)
    reach = F.col("_start") + F.col("_maxp") - F.least(F.lit(0), F.coalesce("_before", F.lit(0)))
    return carried.agg(F.max(F.greatest("_best", reach)).cast("bigint").alias(out))
