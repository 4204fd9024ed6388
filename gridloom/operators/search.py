"""Searches by predicate. Positions come from min/max aggregates, so every task stops at its own partials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_position_where(df: DataFrame, predicate: Column, index: str = "i", out: str = "pos") -> DataFrame:
    """Last position that satisfies the predicate, else the vector length."""
    hit = F.max(F.when(predicate, F.col(index)))
    return df.agg(F.coalesce(hit, F.count(F.lit(1))).cast("bigint").alias(out))


def first_position_where(df: DataFrame, predicate: Column, index: str = "i", out: str = "pos") -> DataFrame:
    """First position that satisfies the predicate, else the vector length."""
    hit = F.min(F.when(predicate, F.col(index)))
    return df.agg(F.coalesce(hit, F.count(F.lit(1))).cast("bigint").alias(out))


def last_short_book(df: DataFrame, pages: str = "pages", limit: int = 100, index: str = "i") -> DataFrame:
    return last_position_where(df, F.col(pages) < limit, index)


def first_even(df: DataFrame, x: str = "x", index: str = "i") -> DataFrame:
    return first_position_where(df, F.col(x) % 2 == 0, index)


def contains(df: DataFrame, target, x: str = "x", out: str = "found") -> DataFrame:
    """Membership; the predicate reaches the scan, and one matching row is enough."""
    hit = df.where(F.col(x) == target).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias(out))


def closest_to(df: DataFrame, target: float = math.pi, x: str = "x", index: str = "i", out: str = "pos") -> DataFrame:
    """Position of the value nearest to the target; the first position wins ties."""
    nearest = F.min(F.struct(F.abs(F.col(x) - F.lit(target)), F.col(index).alias("p")))
    return df.agg(nearest["p"].cast("bigint").alias(out))


def in_exactly_one(left: DataFrame, right: DataFrame, target, x: str = "x", out: str = "found") -> DataFrame:
    """True when the value is in exactly one of two vectors: one pass over the matching rows of both."""
    sides = left.where(F.col(x) == target).select(F.lit(1).alias("side")).limit(1)
    sides = sides.union(right.where(F.col(x) == target).select(F.lit(2).alias("side")).limit(1))
    return sides.agg((F.count(F.lit(1)) == 1).alias(out))


def symmetric_difference(left: DataFrame, right: DataFrame, x: str = "x") -> DataFrame:
    """All values that are in exactly one of two vectors: one aggregation instead of two anti joins."""
    sides = left.select(x, F.lit(1).alias("side")).union(right.select(x, F.lit(2).alias("side")))
    per_value = sides.groupBy(x).agg(F.bit_or("side").alias("sides"))
    return per_value.where(F.col("sides") != 3).select(x)
