"""Fourier transforms of keyed series ``(keys, n, re, im)``; positions that are absent count as 0."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import group_id

GROUP_CELLS = 1 << 16  # cells that one task group of a long series holds, as long as a column fits
AT_ONCE = 1 << 18  # cells of several blocks that are transformed by one call
WHOLE_SERIES = 1 << 16  # longest series that one task transforms on its own


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _is_power_of_two(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def _next_power_of_two(n: Column) -> Column:
    shift = F.ceil(F.log2(n.cast("double"))).cast("int")
    return F.pow(F.lit(2.0), shift).cast("bigint")


def _turn(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    """cos and sin of 2 pi numerator/denominator; the integer remainder keeps large arguments exact."""
    angle = F.lit(2 * math.pi) * F.pmod(numerator, denominator) / denominator
    return F.cos(angle), F.sin(angle)


def _rotate(re: Column, im: Column, cos: Column, sin: Column) -> list[Column]:
    return [(re * cos - im * sin).alias("re"), (re * sin + im * cos).alias("im")]


def _dft(values: np.ndarray, sign: int) -> np.ndarray:
    """Transform along the first axis."""
    return np.fft.fft(values, axis=0) if sign < 0 else np.fft.ifft(values, axis=0) * len(values)


def _whole(series: DataFrame, keys: list[str], sign: int, cells: int) -> DataFrame:
    """Short series, many per task group: groups hold about ``GROUP_CELLS`` of all ``cells``."""
    fields = _fields(series, keys)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable")
        names = pdf[keys]
        starts = np.flatnonzero(np.append(True, (names.to_numpy()[1:] != names.to_numpy()[:-1]).any(axis=1)))
        sizes = pdf["size"].to_numpy()[starts]
        n, z = pdf["n"].to_numpy(), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        spectra = []
        for start, end, size in zip(starts, [*starts[1:], len(pdf)], sizes):
            values = np.zeros(size, dtype=complex)
            values[n[start:end]] = z[start:end]
            spectra.append(_dft(values, sign))
        frame = names.iloc[np.repeat(starts, sizes)].reset_index(drop=True)
        spectrum = np.concatenate(spectra)
        return frame.assign(
            size=np.repeat(sizes, sizes), k=np.concatenate([np.arange(s) for s in sizes]), re=spectrum.real, im=spectrum.imag
        )

    groups = -(-cells // GROUP_CELLS)
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group")
    return series.groupBy(group).applyInPandas(run, f"{fields}, size bigint, k bigint, re double, im double")


def _in_blocks(rows: DataFrame, keys: list[str], shape: Callable[[pd.DataFrame], np.ndarray], run: Callable[..., dict], schema: str) -> DataFrame:
    """``run`` on the blocks of series, many of one shape per call.

    ``shape`` gives two lengths per row, of which the second may be that of a block's rim; ``run`` gets the blocks' cells, the
    number of each row's block in it, the first rows of the blocks, and the shape.
    """
    placed = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block")
    by = [*keys, "block"]

    def starts_of(frame: pd.DataFrame) -> np.ndarray:
        other = np.zeros(max(len(frame) - 1, 0), bool)
        for c in by:
            v = frame[c].to_numpy()
            other |= (v[1:] != v[:-1]).astype(bool)
        return np.concatenate([np.ones(min(len(frame), 1), bool), other])

    def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        first = np.flatnonzero(starts_of(frame))
        count = np.diff(np.append(first, len(frame)))
        shapes, kind = np.unique(shape(frame.iloc[first]), axis=0, return_inverse=True)
        for k, (down, across) in enumerate(shapes.tolist()):
            blocks = np.flatnonzero(kind.reshape(-1) == k)
            at_once = max(1, AT_ONCE // (down * across))
            for some in range(0, len(blocks), at_once):
                chosen = blocks[some : some + at_once]
                number = np.repeat(np.arange(len(chosen)), count[chosen])
                # the rows of the chosen blocks, in order
                begin = np.repeat(first[chosen] - np.append(0, np.cumsum(count[chosen])[:-1]), count[chosen])
                part = frame.iloc[begin + np.arange(len(begin))]
                heads = frame.iloc[first[chosen]]
                cells = run(part, number, heads, down, across)
                yield pd.DataFrame({key: np.repeat(heads[key].to_numpy(), down * across) for key in keys} | cells)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            seam = pd.concat([held[-1].iloc[-1:], batch]) if held else batch
            starts = np.flatnonzero(starts_of(seam)[1:])  # of the batch, without its first row if nothing is held
            starts = starts if held else starts + 1
            if len(starts):
                yield from done(pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True))
                held, batch = [], batch.iloc[starts[-1] :]
            held.append(batch)
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return placed.mapInPandas(work, schema)


def _four_step(series: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Power-of-two series of any length: two shuffles of the series.

    Position n = row * cols + col: first every column is transformed and twisted, then every row. A
    block takes as many neighbouring columns (rows) as fit into about ``GROUP_CELLS`` cells, so long
    series make many blocks; the blocks of short series are transformed together.
    """
    cols = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double")) / 2)).cast("bigint")
    rows = F.call_function("div", F.col("size"), F.col("cols"))
    width = lambda length: F.greatest(F.call_function("div", F.lit(GROUP_CELLS), length), F.lit(1))
    laid_out = (
        series.withColumn("cols", cols)
        .withColumn("rows", rows)
        .withColumn("wide", width(F.col("rows")))
        .withColumn("block", F.call_function("div", F.col("n") % F.col("cols"), F.col("wide")))
    )
    fields = _fields(series, keys)

    def column_shape(heads: pd.DataFrame) -> np.ndarray:
        wide = np.minimum(heads["wide"], heads["cols"] - heads["block"] * heads["wide"])
        return np.stack([heads["rows"], wide], axis=1)

    def columns(part: pd.DataFrame, number: np.ndarray, heads: pd.DataFrame, rows: int, wide: int) -> dict:
        first = (heads["block"] * heads["wide"]).to_numpy()
        size, cols = heads["size"].to_numpy(), heads["cols"].to_numpy()
        n, own = part["n"].to_numpy(), part["cols"].to_numpy()
        values = np.zeros((rows, len(heads), wide), dtype=complex)
        values[n // own, number, n % own - first[number]] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        k1, _, n2 = np.indices(values.shape, sparse=True)
        n2 = n2 + first[None, :, None]
        of = size[None, :, None]
        twisted = _dft(values, sign) * np.exp(sign * 2j * np.pi * (k1 * n2 % of) / of)
        flat = lambda cells: np.broadcast_to(cells, values.shape).transpose(1, 0, 2).ravel()
        each = {"size": flat(of), "cols": flat(cols[None, :, None]), "k1": flat(k1), "n2": flat(n2)}
        return each | {"re": flat(twisted.real), "im": flat(twisted.imag)}

    turned = (
        _in_blocks(laid_out, keys, column_shape, columns, f"{fields}, size bigint, cols bigint, k1 bigint, n2 bigint, re double, im double")
        .withColumn("high", width(F.col("cols")))
        .withColumn("block", F.call_function("div", F.col("k1"), F.col("high")))
    )

    def row_shape(heads: pd.DataFrame) -> np.ndarray:
        high = np.minimum(heads["high"], heads["size"] // heads["cols"] - heads["block"] * heads["high"])
        return np.stack([heads["cols"], high], axis=1)

    def rows_of(part: pd.DataFrame, number: np.ndarray, heads: pd.DataFrame, cols: int, high: int) -> dict:
        first = (heads["block"] * heads["high"]).to_numpy()
        size = heads["size"].to_numpy()
        values = np.zeros((cols, len(heads), high), dtype=complex)
        values[part["n2"].to_numpy(), number, part["k1"].to_numpy() - first[number]] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        spectrum = _dft(values, sign)
        k2, _, k1 = np.indices(values.shape, sparse=True)
        k = k1 + first[None, :, None] + (size // cols)[None, :, None] * k2
        flat = lambda cells: np.broadcast_to(cells, values.shape).transpose(1, 0, 2).ravel()
        return {"size": flat(size[None, :, None]), "k": flat(k), "re": flat(spectrum.real), "im": flat(spectrum.imag)}

    return _in_blocks(turned, keys, row_shape, rows_of, f"{fields}, size bigint, k bigint, re double, im double")


def _chirp(series: DataFrame, sizes: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Long series of any length, as a convolution of power-of-two length (chirp transform)."""
    longest = F.when(F.col("size") >= 1 << 31, F.raise_error(F.lit("series is too long for a chirp transform")))
    padded = _next_power_of_two(2 * F.col("size") - 1)
    a = series.select(
        *keys, F.col("size").alias("len"), padded.alias("size"), "n",
        *_rotate(F.col("re"), F.col("im"), *_conjugate_if(sign, *_turn(F.col("n") * F.col("n"), 2 * F.col("size")))),
    )
    # the filter depends on the length only; positions -(len-1)..len-1 wrap around
    lengths = sizes.select("size").distinct().select(F.coalesce(longest.cast("bigint"), "size").alias("len"), padded.alias("size"))
    step = 1 << 16
    places = lengths.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("size") - 1, F.lit(step)))))
    places = places.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))).withColumn("n", F.col("_hi") * step + F.col("_lo"))
    places = places.where(F.col("n") < F.col("size")).withColumn("_m", F.least("n", F.col("size") - F.col("n"))).where(F.col("_m") < F.col("len"))
    cos, sin = _conjugate_if(-sign, *_turn(F.col("_m") * F.col("_m"), 2 * F.col("len")))
    b = places.select("len", "size", "n", cos.alias("re"), sin.alias("im"))
    fa = _four_step(a, [*keys, "len"], -1)
    fb = _four_step(b, ["len"], -1).select("len", "k", F.col("re").alias("_cos"), F.col("im").alias("_sin"))
    product = fa.join(fb, ["len", "k"]).select(
        *keys, "len", "size", F.col("k").alias("n"), *_rotate(F.col("re"), F.col("im"), F.col("_cos"), F.col("_sin"))
    )
    back = _four_step(product, [*keys, "len"], +1).where(F.col("k") < F.col("len"))
    scaled = back.select(*keys, "len", "k", (F.col("re") / F.col("size")).alias("re"), (F.col("im") / F.col("size")).alias("im"))
    return scaled.select(
        *keys, F.col("len").alias("size"), "k",
        *_rotate(F.col("re"), F.col("im"), *_conjugate_if(sign, *_turn(F.col("k") * F.col("k"), 2 * F.col("len")))),
    )


def _conjugate_if(sign: int, cos: Column, sin: Column) -> tuple[Column, Column]:
    return cos, sin if sign > 0 else -sin


def transform(
    df: DataFrame, keys: list[str], sign: int = -1, pad: bool = False, whole_series: int = WHOLE_SERIES
) -> DataFrame:
    """Discrete Fourier transform per series: ``(keys, size, k, re, im)`` for k in 0..size-1. Null is a key like any other.

    ``pad`` extends each series with zeros to a power of two. Series up to ``whole_series`` long are
    transformed one per task group; longer ones are split over many tasks. Which of these plans are
    needed is decided from a few aggregated numbers about the lengths.
    """
    clash = {"n", "re", "im", "size", "k"} & {key.lower() for key in keys}
    if clash:
        raise ValueError(f"keys must not be called {sorted(clash)}")
    own, names = [F.col(f"`{key}`") for key in keys], keys
    named = df.select(*own, group_id(keys).alias("_g")).distinct()
    df, keys = df.select(group_id(keys).alias("_g"), *[c for c in ("n", "re", "im") if c in df.columns]), ["_g"]
    size = F.col("size")
    sizes = df.groupBy(*keys).agg((F.max("n") + 1).alias("size"))
    if pad:
        sizes = sizes.withColumn("size", _next_power_of_two(size))
    long = size > whole_series
    short_cells, any_long, any_odd = sizes.agg(
        F.sum(F.when(~long, size)), F.bool_or(long & _is_power_of_two(size)), F.bool_or(long & ~_is_power_of_two(size))
    ).first()
    imaginary = F.col("im") if "im" in df.columns else F.lit(0.0)
    series = df.select(
        *keys, F.col("n").cast("bigint").alias("n"), F.col("re").cast("double").alias("re"), imaginary.cast("double").alias("im")
    ).join(sizes, keys)
    plans = []
    if short_cells:
        plans.append(_whole(series.where(~long), keys, sign, short_cells))
    if any_long:
        plans.append(_four_step(series.where(long & _is_power_of_two(size)), keys, sign))
    if any_odd:
        odd = long & ~_is_power_of_two(size)
        plans.append(_chirp(series.where(odd), sizes.where(odd), keys, sign))
    result = plans[0] if plans else _whole(series, keys, sign, 1)
    for plan in plans[1:]:
        result = result.unionByName(plan)
    return result.join(named, "_g").select(*own, "size", "k", "re", "im") if names else result.drop("_g")


def dft(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Transform of real series of any length."""
    return transform(df.select(*keys, "n", "re"), keys, **kw)


def fft(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return transform(df, keys, **kw)


def fft_conjugate(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return transform(df, keys, **kw).withColumn("im", -F.col("im"))


def fft_split(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Real and imaginary parts as two vectors ``r`` and ``i``."""
    return transform(df, keys, **kw).withColumnsRenamed({"re": "r", "im": "i"})


def inverse_fft(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    result = transform(df, keys, sign=+1, **kw)
    return result.withColumn("re", F.col("re") / F.col("size")).withColumn("im", F.col("im") / F.col("size"))
