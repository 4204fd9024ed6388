"""Column functions for element-wise transforms. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MAX = 2147483647


def relu(x: Column) -> Column:
    """max(0, x) where NaN counts as 0 (Spark alone would order NaN above 0)."""
    return F.when(F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x)


def negate_odd_halve_even(x: Column) -> Column:
    """Even values are halved (truncating), odd values negated; widened so that -x cannot overflow."""
    wide = x.cast("bigint")
    return F.when(wide % 2 == 0, F.call_function("div", wide, F.lit(2))).otherwise(-wide)


def one_minus_inverse(x: Column) -> Column:
    """1 - 1/x with the IEEE limit at zero instead of an ANSI error; -0.0 equals 0.0 in Spark."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(1 - 1 / x)


def square(x: Column) -> Column:
    wide = x.cast("bigint")
    return wide * wide


def is_power_of_two(x: Column) -> Column:
    wide = x.cast("bigint")
    return (wide > 0) & (wide.bitwiseAND(wide - 1) == 0)


def safe_inverse(x: Column) -> Column:
    """1/x where 1/0 is +inf, as in IEEE arithmetic."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(1 / x)


def fraction_quarter(x: Column) -> Column:
    """Quarter (0..3) of the fractional part; truncation makes negatives fall into quarter 0."""
    frac = x - x.cast("bigint")
    return F.when(frac < 0.25, 0).when(frac < 0.5, 1).when(frac < 0.75, 2).otherwise(3)


def decade_bin(x: Column, width: int = 10, bins: int = 10) -> Column:
    """Bin of fixed width; the top edge belongs to the last bin."""
    return F.least(F.floor(x / width).cast("int"), F.lit(bins - 1))


def quadrant(x: Column, y: Column) -> Column:
    """0: x>=0,y>=0; 1: x<0,y>=0; 2: x<0,y<0; 3: x>=0,y<0 (axes count as positive)."""
    return (
        F.when((x >= 0) & (y >= 0), 0).when((x < 0) & (y >= 0), 1).when((x < 0) & (y < 0), 2).otherwise(3)
    )


def letter_bin(s: Column, fold_case: bool = False) -> Column:
    """0..25 for a lowercase a-z first letter (either case with ``fold_case``), else null."""
    first = F.substring(s, 1, 1)
    code = F.ascii(F.lower(first) if fold_case else first) - 97
    return F.when(code.between(0, 25), code)


def parse_shift_size(s: Column) -> Column:
    """'(1<<n)' -> 2**n."""
    bits = F.regexp_extract(s, r"<<(\d+)\)", 1).cast("int")
    return F.pow(F.lit(2.0), bits).cast("bigint")


def resource_count(model: Column, procs: Column, threads: Column) -> Column:
    """Processes, threads or their product, by execution model."""
    return (
        F.when(model == "mpi", procs)
        .when(model == "mpi+omp", procs * threads)
        .when(model.isin("omp", "kokkos"), threads)
    )
