"""Whitening of embeddings by principal components, found by contour integration.

The rows pass through Spark: exact sums, the centred products of every batch and the projections are made in the
tasks. What meets on the driver is one matrix of ``dimensions ** 2`` numbers, however many rows there are. Its
eigenvalues are cut into intervals by inertia counts (Sylvester: as many eigenvalues lie below ``s`` as the
factorisation of ``V - s`` has negative pivots). On each interval a circle around it is integrated by quadrature: the
weighted solves of ``(z - V) Q = Y`` project a random block onto the eigenvectors inside, Rayleigh-Ritz extracts
them, and the projection is repeated from them until the residuals are at rounding level. The count of the interval
says how many there must be; fewer or more is an error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick

#: an entry c becomes floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: quadrature points on the upper half of a circle, and the most eigenvalues of an interval that can be cut
POINTS, INTERVAL = 8, 12
#: entries are cut off where a long ends
LONGEST = float(1 << 62)
#: a deviation of more than 38 digits is null
DECIMAL = 10**38
#: rows that are multiplied at once, and the most dimensions (the driver holds a few matrices of that order)
ROWS, DIMENSIONS = 4096, 4096


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column for each value
    trace: float


# ---------------------------------------------------------------- eigenvalues of a symmetric matrix


def negative_pivots(a: np.ndarray) -> int:
    """Number of negative eigenvalues: pivots of the factorisation with symmetric pivoting in blocks of one and two."""
    a, negative, alpha = a.copy(), 0, (1 + math.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[k] == 0 and off[i, j] == 0:
            return negative
        pivot = [k] if diagonal[k] >= alpha * off[i, j] else [i, j]
        rest = np.delete(np.arange(len(a)), pivot)
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        # a block of two has a negative determinant: one eigenvalue of either sign
        negative += int(block[0, 0] < 0) if len(pivot) == 1 else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative


def below(v: np.ndarray, at: float) -> int:
    """Eigenvalues of ``v`` below ``at``."""
    return negative_pivots(v - at * np.eye(len(v)))


def intervals(v: np.ndarray, wanted: int, least: float) -> list[tuple[float, float, int]]:
    """``(lo, hi, count)`` from the top down, disjoint, holding at least the ``wanted`` largest eigenvalues above ``least``.

    An interval of more than ``INTERVAL`` eigenvalues is halved, unless they are equal to rounding.
    """
    size = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger
    top = size * (1 + 1e-9)
    found: list[tuple[float, float, int]] = []
    todo = [(least, top, len(v) - below(v, least))]
    while todo and sum(c for *_, c in found) < wanted:
        lo, hi, count = todo.pop()
        if not count:
            continue
        if count <= INTERVAL or hi - lo <= 1e-12 * size:
            found.append((lo, hi, count))
            continue
        middle = (lo + hi) / 2
        above = len(v) - below(v, middle) - (len(v) - below(v, hi))
        todo += [(lo, middle, count - above), (middle, hi, above)]
    return found


def contour(v: np.ndarray, lo: float, hi: float, count: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of ``v`` in ``[lo, hi)``; there must be ``count``.

    Complex pairs of quadrature points are mirror images, so the upper half of the circle is enough.
    """
    size, order = float(np.abs(v).sum(axis=1).max()), len(v)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles, radius, centre = math.pi / 2 * (nodes + 1), (hi - lo) / 2, (hi + lo) / 2
    shifts = [centre + radius * complex(math.cos(t), math.sin(t)) for t in angles]
    block = np.random.default_rng(11).standard_normal((order, min(order, count + max(4, count // 2))))
    best, values, vectors = math.inf, None, None
    for _ in range(rounds):
        total = np.zeros_like(block)
        for t, w, z in zip(angles, weights, shifts):
            solved = np.linalg.solve(z * np.eye(order) - v, block.astype(complex))
            total += w / 2 * radius * (complex(math.cos(t), math.sin(t)) * solved).real
        q, _ = np.linalg.qr(total)
        ritz, turn = np.linalg.eigh(q.T @ v @ q)
        block = q @ turn
        inside = np.flatnonzero((ritz >= lo) & (ritz < hi))[::-1]
        if len(inside) == count:
            residual = float(np.linalg.norm(v @ block[:, inside] - block[:, inside] * ritz[inside], axis=0).max())
            # at rounding level one more round no longer helps
            if residual < best:
                settled, best = residual > best / 4, residual
                values, vectors = ritz[inside], block[:, inside]
            else:
                settled = True
            if settled and best <= 1e-11 * size:
                break
    if values is None or best > 1e-9 * size:
        raise ArithmeticError(f"{count} eigenvalues lie in [{lo}, {hi}), the contour did not settle on them")
    return values, vectors


def largest_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors; those at rounding level of zero are left out."""
    if not len(v) or not np.trace(v) > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    least = len(v) * np.finfo(float).eps * 8 * float(np.abs(v).sum(axis=1).max())
    parts = [contour(v, *part) for part in intervals(v, wanted, least)]
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    return np.concatenate([p[0] for p in parts])[:wanted], np.hstack([p[1] for p in parts])[:, :wanted]


# ---------------------------------------------------------------- passes over the rows


def clean(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, c array<double>`` of the rows whose vector holds neither nulls nor non-finite entries."""
    rows = pick(vectors, vec_id=id_column, c=vector).withColumn("c", F.col("c").cast("array<double>"))
    finite = F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("c").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole_numbers(cells) -> np.ndarray:
    """The long coordinates of a batch of vectors."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * np.stack(list(cells))), -LONGEST, LONGEST).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` without error: as longs where they suffice, else as Python numbers."""
    if n * max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _added(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("v").alias("v"))


def fit(rows: DataFrame, wanted: int = 8) -> Model:
    """Sums, covariance and largest components of the vectors of ``clean`` rows."""
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, d = lengths["n"], lengths["d"]
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance is held on the driver, which takes {DIMENSIONS}")
    rows = rows.where(F.size("c") == d)

    def add_up(frames):
        # a long holds the sum of as many rows as a batch has, a decimal that of all of them
        for frame in frames:
            if len(frame):
                x = whole_numbers(frame["c"])
                total = x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "v": [str(t) for t in total]})

    parts = rows.mapInPandas(add_up, "i int, v string").withColumn("v", F.col("v").cast("decimal(38,0)"))
    sums = [int(r["v"]) for r in _added(parts, ["i"]).orderBy("i").collect()]
    upper = np.triu_indices(d)

    def multiply(frames):
        total = np.zeros((d, d))
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                y = centred(whole_numbers(frame["c"].iloc[at : at + ROWS]), n, sums).astype(float) / n
                total += y.T @ y
        yield pd.DataFrame({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "v": total[upper]})

    v = np.zeros((d, d))
    for r in _added(rows.mapInPandas(multiply, "i int, j int, v double"), ["i", "j"]).collect():
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["v"] / n
    values, columns = largest_components(v, wanted)
    return Model(n, sums, values, columns, float(np.trace(v)))


def project(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` and the whitened coordinates of a batch."""
    exact = centred(x, model.n, model.sums)
    return exact, (exact.astype(float) / model.n) @ model.vectors / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def multiply(frames):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for frame in frames:
            if len(frame):
                w = project(whole_numbers(frame["c"]), model)[1]
                total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield pd.DataFrame({
            "i": np.concatenate([upper[0], np.arange(k)]).astype(np.int32), "j": np.concatenate([upper[1], np.full(k, -1)]).astype(np.int32),
            "v": np.concatenate([total[upper], mean]),
        })

    cells = {(r["i"], r["j"]): r["v"] / model.n for r in _added(rows.mapInPandas(multiply, "i int, j int, v double"), ["i", "j"]).collect()}
    # the rows are centred already: what is left of the mean is rounding
    return max((abs(v - cells[i, -1] * cells[j, -1] - (i == j)) for (i, j), v in cells.items() if j >= 0), default=0.0)


def whiten(vectors: DataFrame, wanted: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold a null or non-finite entry are dropped, and so are those of another length than most
    (of several such lengths, the largest). ``deviation`` is exact, a ``decimal(38,0)``. Components with an eigenvalue at
    rounding level of zero have no whitened coordinate and are left out, so fewer rows than dimensions, equal
    rows or constant entries give fewer components, and a table of equal rows, of empty vectors or without
    rows gives none. Equal rows and equal ids are rows of their own; a null id stays.
    """
    rows = clean(vectors, id_column, vector)
    model = fit(rows, wanted)
    k = len(model.values)
    kind = rows.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], fields)
    rows = rows.where(F.size("c") == len(model.sums))
    error = identity_error(rows, model)

    def spread(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            many = len(batch)
            exact, w = project(whole_numbers(batch.column(1).to_numpy(zero_copy_only=False)), model)
            if exact.dtype != object and int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 62:
                exact = exact.astype(object)
            deviation = [Decimal(int(t)) if t < DECIMAL else None for t in (exact * exact).sum(axis=1)]
            rows_of = pa.array(np.repeat(np.arange(many), k))
            columns = {
                "vec_id": batch.column(0).take(rows_of), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                "n": pa.array(np.full(many * k, model.n)), "deviation": pa.array(deviation, pa.decimal128(38, 0)).take(rows_of),
                "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(model.values / model.trace, many)),
                "identity_error": pa.array(np.full(many * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(spread, fields)
