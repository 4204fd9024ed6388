"""Matrix and vector products over coordinate form ``(row, col, value)`` and vectors ``(i, x)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import grid_join, salted_join, shuffle_width

BLOCK_BITS = 8
#: blocks of a product that a task adds up at a time
HELD_BLOCKS = 64


def add_duplicates(a: DataFrame) -> DataFrame:
    """One entry per coordinate; repeated coordinates add up."""
    return a.groupBy("row", "col").agg(F.sum("value").alias("value"))


def last_duplicate_wins(a: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One entry per coordinate; the entry with the highest ``order`` is kept."""
    return a.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def dense(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """All rows x cols coordinates, absent ones as 0."""
    cells = a.sparkSession.range(rows * cols).select(
        F.call_function("div", F.col("id"), F.lit(cols)).alias("row"), (F.col("id") % cols).alias("col")
    )
    return cells.join(a, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def spmm(a: DataFrame, b: DataFrame, shape: tuple[int, int] | None = None, **salting) -> DataFrame:
    """Sparse product A B; duplicates add. ``shape`` asks for the dense result.

    Both sides are reduced to one entry per coordinate before the join on the inner index. An inner index that
    dominates either side is a grid of slices, over rows of A and columns of B, so that each pair of entries meets
    in one of many tasks. The products are summed inside the join stage before they are shuffled by (row, col).
    """
    left = add_duplicates(a).select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    right = add_duplicates(b).select(F.col("row").alias("_k"), "col", F.col("value").alias("_b"))
    product = (
        grid_join(left, right, ["_k"], ["row"], ["col"], **salting)
        .groupBy("row", "col")
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    )
    return dense(product, *shape) if shape else product


def gemm(a: DataFrame, b: DataFrame, shape: tuple[int, int], bits: int = BLOCK_BITS, inner: int | None = None) -> DataFrame:
    """Dense product C = A B with ``shape`` = (rows of A, columns of B); repeated coordinates add up.

    The cells of either side are shuffled once, by the block of the inner index they belong to, and packed there
    into one row per block of 2**bits x 2**bits cells. The packed rows meet in a join that needs no further shuffle; each
    task adds up what it gets for a block of C, so that a partial block leaves it once in most cases. With fewer
    inner blocks than tasks, the side with more blocks is dealt to slices and the other one goes to every slice.
    ``inner`` is the number of columns of A, which is looked up if it is not given.
    """
    size = 1 << bits
    inner = inner or (a.agg(F.max("col")).first()[0] or 0) + 1
    rows, cols, depth = (-(-n // size) for n in (*shape, inner))
    slices = max(1, min(max(rows, cols), -(-shuffle_width(a.sparkSession) // depth)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))

    dealt = ["bk", "slice"] if slices > 1 else ["bk"]

    def packed(cells: DataFrame, own: str, place: str, deal: bool) -> DataFrame:
        block = F.shiftright(own, bits)
        if slices == 1:  # dealt as they come, so that a repartition of the caller's makes no shuffle of its own
            cells = cells.repartition(F.shiftright(place, bits))
        split = cells.select(
            F.shiftright(place, bits).alias("bk"), *([(block % slices if deal else every).alias("slice")] if slices > 1 else []), block.alias(f"b_{own}"),
            F.col(own).bitwiseAND(size - 1).cast("int").alias("o"), F.col(place).bitwiseAND(size - 1).cast("int").alias("k"),
            F.col("value").cast("double").alias("v"),
        )
        # grouping and join keep to this partitioning
        lists = [F.collect_list(c).alias(f"{own}_{c}") for c in ("o", "k", "v")]
        return (split.repartition(*dealt) if slices > 1 else split).groupBy(*dealt, f"b_{own}").agg(*lists)

    left, right = packed(a, "row", "col", rows >= cols), packed(b, "col", "row", rows < cols)

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        latest: tuple = (None, None)

        def block(own, k, v, turned: bool) -> np.ndarray:
            cells = np.zeros((size, size))
            np.add.at(cells, (k, own) if turned else (own, k), v)
            return cells

        def cells(at) -> pd.DataFrame:
            total, seen = sums.pop(at)
            r, c = np.nonzero(seen)
            return pd.DataFrame({"row": r + (at[0] << bits), "col": c + (at[1] << bits), "value": total[r, c]})

        for frame in frames:
            for pair in frame.itertuples(index=False):
                if latest[0] != (pair.bk, pair.b_row):  # the pairs of one left block follow each other
                    latest = (pair.bk, pair.b_row), block(pair.row_o, pair.row_k, pair.row_v, False)
                at = (int(pair.b_row), int(pair.b_col))
                if at not in sums:
                    if len(sums) >= HELD_BLOCKS:
                        yield cells(next(iter(sums)))
                    sums[at] = [np.zeros((size, size)), np.zeros((size, size), dtype=bool)]
                total, seen = sums[at]
                total += latest[1] @ block(pair.col_o, pair.col_k, pair.col_v, True)
                seen[np.ix_(np.unique(pair.row_o), np.unique(pair.col_o))] = True
        while sums:
            yield cells(next(iter(sums)))

    pairs = left.join(right, dealt)
    return add_duplicates(pairs.mapInPandas(multiply, "row bigint, col bigint, value double"))


def _row_products(a: DataFrame, x: DataFrame, **salting) -> DataFrame:
    entries = a.select(F.col("row").alias("i"), F.col("col").alias("_k"), F.col("value").alias("_a"))
    vector = x.select(F.col("i").alias("_k"), F.col("x").alias("_x"))
    # one vector element per column, so a hot column only needs its matrix entries spread
    return (
        salted_join(entries, vector, ["_k"], ["i"], **salting)
        .groupBy("i")
        .agg(F.sum(F.col("_a") * F.col("_x")).alias("_s"))
    )


def gemv(a: DataFrame, x: DataFrame, **salting) -> DataFrame:
    """y = A x as ``(i, y)``, one row per row of A."""
    return _row_products(a, x, **salting).withColumnRenamed("_s", "y")


def spmv(a: DataFrame, x: DataFrame, y: DataFrame, alpha: float, beta: float, **salting) -> DataFrame:
    """alpha A x + beta y; entries outside the vectors are skipped, rows without entries keep beta y."""
    products = _row_products(a, x, **salting)
    scaled = F.lit(beta) * F.col("x") + F.coalesce(F.lit(alpha) * F.col("_s"), F.lit(0.0))
    return y.join(products, "i", "left").select("i", scaled.alias("y"))


def sparse_axpy(x: DataFrame, y: DataFrame, alpha: float, drop_zeros: bool = False) -> DataFrame:
    """alpha x + y over sparse vectors ``(i, value)``; repeated indices add up on either side."""
    terms = x.select("i", (F.lit(alpha) * F.col("value")).alias("value")).unionByName(y.select("i", "value"))
    total = terms.groupBy("i").agg(F.sum("value").alias("value"))
    return total.where(F.col("value") != 0) if drop_zeros else total


def gram(df: DataFrame, keys: list[str], columns: dict[str, Column], target: Column) -> tuple[DataFrame, DataFrame]:
    """Normal equations per key: ``(keys, row, col, value)`` and right-hand side ``(keys, row, value)``.

    One aggregation with a fixed number of sums per key, combined in the map tasks.
    """
    names = list(columns)
    pairs = [(r, c) for r in range(len(names)) for c in range(len(names)) if r <= c]
    sums = [F.sum(columns[names[r]] * columns[names[c]]).cast("double").alias(f"s{r}_{c}") for r, c in pairs]
    sums += [F.sum(columns[n] * target).cast("double").alias(f"t{r}") for r, n in enumerate(names)]
    wide = df.groupBy(*keys).agg(*sums)
    cells = F.array(
        *[
            F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(f"s{min(r, c)}_{max(r, c)}").alias("value"))
            for r in range(len(names))
            for c in range(len(names))
        ]
    )
    right = F.array(*[F.struct(F.lit(r).alias("row"), F.col(f"t{r}").alias("value")) for r in range(len(names))])
    return wide.select(*keys, F.inline(cells)), wide.select(*keys, F.inline(right))
