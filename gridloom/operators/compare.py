"""Tolerance equality of keyed vectors, matrices and point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.index import rank_rows


def close_to(
    left: DataFrame, right: DataFrame, keys: list[str], value: str, eps: float = 1e-6, out: str = "equal"
) -> DataFrame:
    """One row: same keys on both sides, all values within ``eps``; NaN on either side fails."""
    pairs = left.select(*keys, F.col(value).alias("_a")).join(
        right.select(*keys, F.col(value).alias("_b")), keys, "full_outer"
    )
    bad = (
        F.col("_a").isNull()
        | F.col("_b").isNull()
        | F.isnan(F.col("_a").cast("double"))
        | F.isnan(F.col("_b").cast("double"))
        | (F.abs(F.col("_a") - F.col("_b")) > eps)
    )
    return pairs.agg((F.count_if(bad) == 0).alias(out))


def coo_equal(left: DataFrame, right: DataFrame, eps: float = 1e-6, out: str = "equal") -> DataFrame:
    """Coordinate matrices, in any order."""
    return close_to(left, right, ["row", "col"], "value", eps, out)


def point_sets_equal(left: DataFrame, right: DataFrame, eps: float = 1e-6, out: str = "equal") -> DataFrame:
    """Points paired by sorted position; both coordinates within ``eps``. A row number tells equal points apart, so that
    any number of them is spread over the ranges."""
    a, b = (rank_rows(df.select("x", "y", F.monotonically_increasing_id().alias("_n")), ["x", "y", "_n"], "pos") for df in (left, right))
    longer = lambda d: d.select("pos", F.posexplode(F.array("x", "y")).alias("axis", "v"))
    return close_to(longer(a), longer(b), ["pos", "axis"], "v", eps, out)
