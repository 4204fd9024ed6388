"""Element-wise operators over vectors ``(i, x)`` and pairs of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric


def map_column(df: DataFrame, column: str, fn: Callable[[Column], Column], out: str | None = None) -> DataFrame:
    """Apply any Column -> Column function (or pandas UDF) to one column."""
    return df.withColumn(out or column, fn(F.col(column)))


def relu(df: DataFrame, x: str = "x") -> DataFrame:
    return map_column(df, x, numeric.relu)


def negate_odds(df: DataFrame, x: str = "x") -> DataFrame:
    return map_column(df, x, numeric.negate_odd_halve_even)


def inverse_offset(df: DataFrame, x: str = "x") -> DataFrame:
    return map_column(df, x, numeric.one_minus_inverse)


def squares(df: DataFrame, x: str = "x") -> DataFrame:
    return map_column(df, x, numeric.square)


def power_of_two_mask(df: DataFrame, x: str = "x", out: str = "mask") -> DataFrame:
    return map_column(df, x, numeric.is_power_of_two, out)


def axpy(x: DataFrame, y: DataFrame, alpha: float, index: str = "i", value: str = "x", out: str = "z") -> DataFrame:
    """alpha * x + y, the vectors aligned by position."""
    left = x.select(index, F.col(value).alias("_x"))
    right = y.select(index, F.col(value).alias("_y"))
    return left.join(right, index).select(index, (F.lit(alpha) * F.col("_x") + F.col("_y")).alias(out))
