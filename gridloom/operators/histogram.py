"""Fixed-bin counts: ``(bin, n)`` with every bin present, zeros included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric


def binned_counts(df: DataFrame, bin_of: Column, bins: int) -> DataFrame:
    """Count rows per bin 0..bins-1; rows whose bin is null or outside are ignored.

    Hot bins cost nothing extra: map tasks ship at most ``bins`` partial counts each. The spine is
    ``bins`` rows, a fixed size, so broadcasting the counts is bounded as well.
    """
    counts = (
        df.select(bin_of.cast("int").alias("bin"))
        .where(F.col("bin").between(0, bins - 1))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def pixel_counts(df: DataFrame, v: str = "v") -> DataFrame:
    return binned_counts(df, F.col(v), 256)


def decade_counts(df: DataFrame, x: str = "x") -> DataFrame:
    """Ten bins of width 10 over [0, 100]."""
    return binned_counts(df, numeric.decade_bin(F.col(x)), 10)


def quadrant_counts(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return binned_counts(df, numeric.quadrant(F.col(x), F.col(y)), 4)


def first_letter_counts(df: DataFrame, s: str = "s", fold_case: bool = False) -> DataFrame:
    return binned_counts(df, numeric.letter_bin(F.col(s), fold_case), 26)


def fraction_quarter_counts(df: DataFrame, x: str = "x") -> DataFrame:
    return binned_counts(df, numeric.fraction_quarter(F.col(x)), 4)
