"""Sorts that return positions: ``pos`` survives any later shuffle, row order does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.index import ordinal, rank_rows
from gridloom.runtime import stage


def sort_by_key(df: DataFrame, key: Column, index: str = "i", out: str = "pos") -> DataFrame:
    """Sort by any derived key; equal keys keep their ``index`` order."""
    return rank_rows(df.withColumn("_key", key), ["_key", index], out).drop("_key")


def sort_complex_by_magnitude(df: DataFrame, re: str = "re", im: str = "im", index: str = "i") -> DataFrame:
    return sort_by_key(df, F.hypot(F.col(re), F.col(im)), index)


def sort_records(df: DataFrame, key: str = "startTime", index: str = "i") -> DataFrame:
    return sort_by_key(df, F.col(key), index)


def ranks(df: DataFrame, x: str = "x", index: str = "i", out: str = "rank") -> DataFrame:
    """0-based rank of every element, ties told apart by position."""
    return rank_rows(df, [x, index], out)


def order_bits(value: Column, kind: T.DataType) -> Column:
    """A bigint that orders like ``value``; of doubles all bits count, a NaN is the largest and both zeros are one."""
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    number = F.coalesce(value.cast("double") + F.lit(0.0), F.lit(0.0))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("bigint")
    # the bits of negative doubles grow with their size
    return F.when(value.isNull(), None).otherwise(F.when(number < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits))


def from_order_bits(bits: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return bits
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(F.coalesce(bits, F.lit(0)))
    number = F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")
    return F.when(bits.isNotNull(), number)


def at_ranks(values: DataFrame, ranks: DataFrame, bits: int = 64) -> DataFrame:
    """``name, value`` of the rows at the 1-based ``rank`` of each ``name``, by radix selection in ``values(_value)``.

    Each round reads the values once for all ranks and counts them per 16-bit digit among those that share the digits found
    so far for some rank. Counts are combined in the map tasks; there are at most 65536 of them per rank, however
    many values there are and however often one repeats. A rank without a row is left out.
    """
    found = ranks.select("name", F.lit(0).cast("bigint").alias("_prefix"), F.col("rank").cast("bigint").alias("_wanted"))
    for shift in range(bits - 16, -1, -16):
        # the arithmetic shift keeps the sign in the top digit, so digits order like the values
        digit = F.shiftright("_value", shift).alias("_digit")
        prefix = F.shiftright("_value", shift + 16) if shift < bits - 16 else F.lit(0).cast("bigint")
        open_prefixes = F.broadcast(found.select("_prefix").distinct())  # one a rank at most
        counts = values.select(prefix.alias("_prefix"), digit).join(open_prefixes, "_prefix").groupBy("_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        ahead = Window.partitionBy("name").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        found = (
            found.join(counts, "_prefix")
            .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
            .where((F.col("_ahead") < F.col("_wanted")) & (F.col("_ahead") + F.col("_n") >= F.col("_wanted")))
            .select("name", F.col("_digit").alias("_prefix"), (F.col("_wanted") - F.col("_ahead")).alias("_wanted"))
        )
        if shift:  # two uses above read what was found before
            found = stage(found, "digits")
    return found.select("name", F.col("_prefix").alias("value"))


def quantiles(df: DataFrame, x: str, probabilities: list[float]) -> DataFrame:
    """``probability, value``: exact quantiles, interpolated between the two neighbouring rows, of any number column.

    All of them come out of one radix selection: the values are written once as 64-bit numbers that order like them and
    read five times, whatever their distribution. Nulls are no values; without a value there is no row.
    """
    kind = df.schema[x].dataType
    values = stage(df.where(F.col(x).isNotNull()).select(order_bits(F.col(x), kind).alias("_value")), "values")
    last = values.agg(F.count(F.lit(1)) - 1)
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in dict.fromkeys(probabilities)], "probability double")
    at = wanted.select("probability", (F.col("probability") * last.scalar()).alias("at"))
    places = stage(at.select("probability", F.floor("at").alias("low"), F.ceil("at").alias("high"), (F.col("at") - F.floor("at")).alias("part")), "places")
    ranks = places.select(F.explode(F.array("low", "high")).alias("name")).distinct().select("name", (F.col("name") + 1).alias("rank"))
    found = at_ranks(values, ranks).select("name", from_order_bits(F.col("value"), kind).cast("double").alias("value"))
    low, high = (found.select(F.col("name").alias(side), F.col("value").alias(f"{side}_value")) for side in ("low", "high"))
    near = F.when(F.col("part") == 0, F.col("low_value")).otherwise((1 - F.col("part")) * F.col("low_value") + F.col("part") * F.col("high_value"))
    return places.join(low, "low").join(high, "high").select("probability", near.alias("value"))


def kth_smallest(df: DataFrame, k: int, x: str = "x", bits: int = 64, out: str = "result") -> DataFrame:
    """k-th smallest (1-based) of a number column by radix selection; ``bits`` is 32 or 64 (64 for fractions).

    Each round counts rows per 16-bit digit among the rows that share the digits found so far and
    picks the digit that holds the k-th row. Counts are combined in the map tasks and there are at
    most 65536 of them, so ties and hot values need no care and rows are never sorted. Nulls are no values.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    kind = df.schema[x].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        values = stage(df.where(F.col(x).isNotNull()).select(order_bits(F.col(x), kind).alias("_value")), "values")
        found = at_ranks(values, df.sparkSession.createDataFrame([(0, k)], "name int, rank long"))
        missing = F.raise_error(F.lit(f"k={k} is larger than the number of rows")).cast("double")
        value = from_order_bits(F.col("v"), kind)
        return found.agg(F.max("value").alias("v")).select(F.when(F.col("v").isNull(), missing).otherwise(value).alias(out))
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{x} must be an integer, float or double column")
    # the arithmetic shift keeps the sign in the top digit, so digits order like the values
    values = df.select(F.col(x).cast("bigint").alias("_value")).where("_value IS NOT NULL")
    found = None
    for shift in range(bits - 16, -1, -16):
        digit = F.shiftright("_value", shift).alias("_digit")
        if found is None:
            rows = values.select(digit, F.lit(k).cast("bigint").alias("_wanted"))
        else:
            # the one row found so far meets the data in a join, so each round refers to the round before it once
            prefix = found.select(F.col("_digit").alias("_prefix"), F.col("_left").alias("_wanted"))
            rows = values.select(F.shiftright("_value", shift + 16).alias("_prefix"), digit).join(F.broadcast(prefix), "_prefix")
        counts = rows.groupBy("_digit", "_wanted").agg(F.count(F.lit(1)).alias("_n"))
        ahead = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        found = (
            counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
            .where((F.col("_ahead") < F.col("_wanted")) & (F.col("_ahead") + F.col("_n") >= F.col("_wanted")))
            .select("_digit", (F.col("_wanted") - F.col("_ahead")).alias("_left"))
        )
    checked = found.agg(F.max("_digit").alias("v"))
    message = F.lit(f"k={k} is larger than the number of rows")
    return checked.select(F.coalesce("v", F.raise_error(message).cast("bigint")).alias(out))


def sort_ignoring_zeros(df: DataFrame, x: str = "x", index: str = "i") -> DataFrame:
    """Sort the non-zero values among their own positions; zeros stay where they are."""
    filled = df.where(F.col(x) != 0).select(index, x)
    places = ordinal(filled.select(index), index, "_slot")
    values = rank_rows(filled, [x, index], "_slot").select("_slot", x)
    return places.join(values, "_slot").select(index, x).unionByName(df.where(F.col(x) == 0).select(index, x))
