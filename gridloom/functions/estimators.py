"""Sampling estimators as Column expressions. ``k`` is a Python int, so every product is unrolled into
generated code and no arrays are built, whatever the number of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _product(factors: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def choose(n: Column, r: int, strict: bool = False) -> Column:
    """n over r. By default 1 where n < r, which keeps results comparable; ``strict`` gives 0 there."""
    n = n.cast("double")
    value = _product([(n - float(r - t)) * F.lit(1.0 / t) for t in range(1, r + 1)])
    return F.when(n < r, F.lit(0.0 if strict else 1.0)).otherwise(value)


def success_at_k(samples: Column, correct: Column, k: int) -> Column:
    """Chance that k of the samples, drawn without replacement, hold at least one correct one.

    1 - C(n-c, k)/C(n, k), with k factors instead of c.
    """
    n, wrong = samples.cast("double"), (samples - correct).cast("double")
    # one division per ten factors: short code, and no overflow however many samples there are
    chunks = [range(t, min(t + 10, k)) for t in range(0, k, 10)]
    misses = _product(
        [F.try_divide(_product([wrong - float(t) for t in c]), _product([n - float(t) for t in c])) for c in chunks]
    )
    return F.when(wrong < k, 1.0).when(correct == 0, 0.0).otherwise(1.0 - misses)
