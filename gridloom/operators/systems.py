"""Many independent linear systems, keyed by ``system_id``: LU factors and solutions.

The groups are what is distributed: one system is one row group of its task. With ``max_order`` a larger
one raises instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_CELLS = 1 << 16  # matrix entries that one task group holds on average; a system is never split


def _square(entries: tuple[np.ndarray, ...], order: int, max_order: int | None) -> np.ndarray:
    if max_order is not None and order > max_order:
        raise ValueError(f"system of order {order} is larger than max_order={max_order}")
    rows, cols, values = entries
    full = np.zeros((order, order))
    full[rows, cols] = values
    return full


def _by_system(frame: pd.DataFrame, columns: list[str]) -> dict:
    """Column arrays per system. Many small systems share a group: one call each would cost more than the solving."""
    ids = frame["system_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    arrays = [frame[c].to_numpy()[order] for c in columns]
    return {i: tuple(a[s:e] for a in arrays) for i, s, e in zip(found, starts, [*starts[1:], len(ids)])}


def _group_of_systems(entries: DataFrame):
    """Group number of a row; the count of groups follows the number of entries."""
    groups = entries.agg(F.ceil((F.count(F.lit(1)) + 1) / GROUP_CELLS)).scalar()
    return F.pmod(F.xxhash64("system_id"), groups)


def _eliminate(m: np.ndarray, pivoting: bool) -> bool:
    """Reduce the left square part of ``m`` to upper triangular form in place; False on a zero pivot."""
    n = m.shape[0]
    for i in range(n - 1 if not pivoting else n):
        if pivoting:
            best = i + int(np.argmax(np.abs(m[i:, i])))
            if best != i:
                m[[i, best]] = m[[best, i]]
        if m[i, i] == 0 and not pivoting:
            return False
        with np.errstate(divide="ignore", invalid="ignore"):
            factors = m[i + 1 :, i] / m[i, i]
            m[i + 1 :, i:] -= np.outer(factors, m[i, i:])
    return True


def unique_entries(a: DataFrame, order_by: str | None) -> DataFrame:
    """Coordinates may repeat: keep the last one by ``order_by`` before anything is grouped."""
    if order_by is None:
        return a.select("system_id", "row", "col", "value")
    return a.groupBy("system_id", "row", "col").agg(F.max_by("value", order_by).alias("value"))


def solve(
    a: DataFrame, b: DataFrame, pivot: str = "none", order_by: str | None = None, max_order: int | None = None
) -> DataFrame:
    """Solve A x = b per system; returns ``(system_id, row, x, solved)``.

    ``pivot='none'`` stops at a zero pivot and leaves x at 0 with ``solved`` false; ``'partial'``
    swaps in the largest pivot and lets a singular system yield non-finite values.
    """
    kind = a.schema["system_id"].dataType.simpleString()
    matrix = unique_entries(a, order_by).select("system_id", "row", "col", F.col("value").cast("double").alias("value"))
    right = b.select("system_id", "row", F.col("value").cast("double").alias("value"))

    def one(entries: tuple, rhs: tuple) -> tuple[np.ndarray, bool]:
        order = 1 + max(int(part.max()) for part in (*entries[:2], rhs[0]) if len(part))
        column = np.zeros((order, 1))
        column[rhs[0], 0] = rhs[1]
        m = np.hstack([_square(entries, order, max_order), column])
        x = np.zeros(order)
        if not _eliminate(m, pivot == "partial"):
            return x, False
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(order - 1, -1, -1):
                x[i] = (m[i, order] - m[i, i + 1 : order] @ x[i + 1 :]) / m[i, i]
        return x, True

    def run(key, cells: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        left, right_sides = _by_system(cells, ["row", "col", "value"]), _by_system(rhs, ["row", "value"])
        none = np.zeros(0, dtype=int)
        ids = sorted(left.keys() | right_sides.keys())
        answers = [one(left.get(i, (none, none, none)), right_sides.get(i, (none, none))) for i in ids]
        sizes = [len(x) for x, _ in answers]
        return pd.DataFrame(
            {
                "system_id": np.repeat(np.array(ids, dtype=object), sizes),
                "row": np.concatenate([np.arange(n) for n in sizes]),
                "x": np.concatenate([x for x, _ in answers]),
                "solved": np.repeat([ok for _, ok in answers], sizes),
            }
        )

    group = _group_of_systems(matrix)
    return (
        matrix.groupBy(group.alias("_group"))
        .cogroup(right.groupBy(group.alias("_group")))
        .applyInPandas(run, f"system_id {kind}, row bigint, x double, solved boolean")
    )


def lu_in_place(a: DataFrame, order_by: str | None = None, max_order: int | None = None) -> DataFrame:
    """Packed LU without pivoting: U on and above the diagonal, L's multipliers below it."""
    factors = lu(a, order_by, max_order)
    return factors.where((F.col("part") == "U") & (F.col("row") <= F.col("col")) | (F.col("part") == "L") & (F.col("row") > F.col("col"))).drop("part")


def lu(a: DataFrame, order_by: str | None = None, max_order: int | None = None) -> DataFrame:
    """A = L U per system, L with unit diagonal: dense ``(system_id, part, row, col, value)``."""
    kind = a.schema["system_id"].dataType.simpleString()
    matrix = unique_entries(a, order_by).select("system_id", "row", "col", F.col("value").cast("double").alias("value"))

    def one(entries: tuple) -> tuple[np.ndarray, np.ndarray]:
        order = 1 + max(int(part.max()) for part in entries[:2])
        upper = _square(entries, order, max_order)
        lower = np.eye(order)
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(order - 1):
                lower[i + 1 :, i] = upper[i + 1 :, i] / upper[i, i]
                upper[i + 1 :, i:] -= np.outer(lower[i + 1 :, i], upper[i, i:])
        return lower, np.triu(upper)

    def run(key, cells: pd.DataFrame) -> pd.DataFrame:
        systems = _by_system(cells, ["row", "col", "value"])
        factors = [one(entries) for entries in systems.values()]
        areas = [lower.size for lower, _ in factors]
        places = [np.indices(lower.shape).reshape(2, -1) for lower, _ in factors]
        where = pd.DataFrame(
            {
                "system_id": np.repeat(np.array(list(systems), dtype=object), areas),
                "row": np.concatenate([p[0] for p in places]),
                "col": np.concatenate([p[1] for p in places]),
            }
        )
        parts = [
            where.assign(part=name, value=np.concatenate([f[i].ravel() for f in factors])) for i, name in enumerate("LU")
        ]
        return pd.concat(parts)[["system_id", "part", "row", "col", "value"]]

    return matrix.groupBy(_group_of_systems(matrix).alias("_group")).applyInPandas(
        run, f"system_id {kind}, part string, row bigint, col bigint, value double"
    )
