"""Folds and scans with a function of the user's own, for which Spark has no aggregate.

The function combines two rows of columns into one. It must be associative and need not be commutative; it gets and
returns numpy arrays, one per column, and works on them element by element, so that a batch of rows is combined in
as many calls as its size has binary digits:

    def compose(left, right):  # x -> a x + b, the left map first
        return {"a": left["a"] * right["a"], "b": right["a"] * left["b"] + right["b"]}

Rows have explicit positions. They are combined in buckets of 2**bits positions, the buckets' results in buckets of
buckets, so no task sees more than 2**bits rows of a group at a time however long it is. Many small buckets are worked on
at once: the function is called per Arrow batch of rows, not per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.index import BUCKET_BITS
from gridloom.runtime import group_id

Columns = dict[str, np.ndarray]
Combine = Callable[[Columns, Columns], Columns]


def _columns(frame: pd.DataFrame, names: list[str]) -> Columns:
    return {c: frame[c].to_numpy() for c in names}


def _part(rows: Columns, at: np.ndarray) -> Columns:
    return {c: v[at] for c, v in rows.items()}


def _places(starts: np.ndarray) -> np.ndarray:
    """Place of each row in its segment, from 0; ``starts`` marks the first rows."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def combine_segments(rows: Columns, starts: np.ndarray, combine: Combine) -> Columns:
    """One row per segment: neighbours are combined pair by pair, then the pairs' results."""
    while not starts.all():
        left = np.flatnonzero(_places(starts) % 2 == 0)
        paired = left + 1 < len(starts)
        paired[paired] = ~starts[left[paired] + 1]
        pairs = combine(_part(rows, left[paired]), _part(rows, left[paired] + 1))
        single = _part(rows, left[~paired])
        place = np.argsort(np.concatenate([left[paired], left[~paired]]))
        rows = {c: np.concatenate([pairs[c], single[c]])[place] for c in rows}
        starts = starts[left]
    return rows


def combine_running(rows: Columns, starts: np.ndarray, combine: Combine) -> Columns:
    """Each row combined with all rows before it in its segment: after k steps with the 2**k rows that end at it."""
    places, step = _places(starts), 1
    while len(at := np.flatnonzero(places >= step)):
        later = combine(_part(rows, at - step), _part(rows, at))
        place = np.argsort(np.concatenate([rest := np.flatnonzero(places < step), at]))
        rows = {c: np.concatenate([rows[c][rest], later[c]])[place] for c in rows}
        step *= 2
    return rows


def _keyed(df: DataFrame, keys: list[str], index: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows under a group name that is never null, and the keys of each name."""
    rows = df.select(group_id(keys).alias("_g"), F.col(f"`{index}`").cast("bigint").alias("_i"), *[F.col(f"`{c}`") for c in columns])
    names = df.select(group_id(keys).alias("_g"), *[F.col(f"`{k}`") for k in keys]).distinct()
    return rows, names


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _bucket(bits: int | None) -> Column:
    """Number of a position's bucket; without ``bits`` all positions are in one."""
    return F.lit(0).cast("bigint") if bits is None else F.shiftright("_i", bits)


def _starts(frame: pd.DataFrame) -> np.ndarray:
    """First rows of the buckets of a sorted frame."""
    group, bucket = frame["_g"].to_numpy(), frame["_bucket"]
    missing, number = bucket.isna().to_numpy(), bucket.fillna(0).to_numpy()
    other = (group[1:] != group[:-1]) | (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
    return np.concatenate([np.ones(min(len(frame), 1), bool), other.astype(bool)])


def _whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames that end where a bucket ends, and the first rows of its buckets."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        seam = pd.concat([held[-1].iloc[-1:], batch]) if held else batch
        starts = np.flatnonzero(_starts(seam)[1 if held else 0 :])
        starts = starts if held else starts[1:]
        if len(starts):
            frame = pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
            yield frame, _starts(frame)
            held = []
            batch = batch.iloc[starts[-1] :]
        held.append(batch)
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, _starts(frame)


def _in_buckets(rows: DataFrame, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, *first: Column) -> DataFrame:
    """``run`` on whole buckets, many at a time, with their rows in the order of ``first`` and then of position."""
    placed = rows.repartition("_g", "_bucket").sortWithinPartitions("_g", "_bucket", *first, F.col("_i").asc_nulls_last())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in _whole_buckets(batches):
            yield run(frame, starts)

    return placed.mapInPandas(work, schema)


def _bucket_totals(rows: DataFrame, columns: list[str], combine: Combine, bits: int | None) -> DataFrame:
    """``_g, _i, columns``: the rows of each bucket combined, at the bucket's number."""

    def total(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(combine_segments(_columns(rows, columns), starts, combine))
        return out.assign(_g=rows["_g"].to_numpy()[starts], _i=rows["_bucket"].to_numpy()[starts])[["_g", "_i", *columns]]

    return _in_buckets(rows.withColumn("_bucket", _bucket(bits)), total, f"_g string, _i bigint, {_fields(rows, columns)}")


def fold(
    df: DataFrame, index: str, columns: list[str], combine: Combine, identity: dict, keys: list[str] | None = None, bits: int = BUCKET_BITS
) -> DataFrame:
    """``keys, columns``: all rows of a group combined in the order of ``index``, which is unique in the group.

    Null is a key like any other. Without keys there is one row, the ``identity`` for an empty table. Values must not be
    null. The last of three levels sees one row per 2**(2 * bits) positions.
    """
    keys = keys or []
    rows, names = _keyed(df, keys, index, columns)
    for width in (bits, bits, None):
        rows = _bucket_totals(rows, columns, combine, width)
    if keys:
        return rows.join(names, "_g").select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`") for c in columns])
    default = df.sparkSession.createDataFrame([tuple(identity[c] for c in columns)], _fields(df, columns))
    either = rows.select(F.lit(0).alias("_late"), *[F.col(f"`{c}`") for c in columns]).unionByName(default.withColumn("_late", F.lit(1)))
    return either.orderBy("_late").limit(1).drop("_late")


def scan(
    df: DataFrame, index: str, columns: list[str], combine: Combine, keys: list[str] | None = None, bits: int = BUCKET_BITS, levels: int = 2
) -> DataFrame:
    """``keys, index, columns``: each row combined with all before it in the order of ``index``, per group.

    The rows are shuffled once for the totals of their buckets and once for the result, where each bucket starts from what
    came before it. With two levels of 16 bits the last step sees one row per 2**32 positions.
    """
    keys = keys or []
    rows, names = _keyed(df, keys, index, columns)
    found = _scan(rows, columns, combine, bits, levels, False)
    return found.join(names, "_g").select(*[F.col(f"`{k}`") for k in keys], F.col("_i").alias(index), *[F.col(f"`{c}`") for c in columns])


def _scan(rows: DataFrame, columns: list[str], combine: Combine, bits: int, levels: int, exclusive: bool) -> DataFrame:
    """``_g, _i, _some, columns``; an exclusive scan leaves the row itself out, and ``_some`` says whether one came before.

    What came before a bucket goes to its task as a row ahead of it (``_some`` is null in all others).
    """
    dealt = rows.withColumn("_bucket", _bucket(bits if levels else None)).withColumn("_some", F.lit(None).cast("boolean"))
    if levels:
        earlier = _scan(_bucket_totals(rows, columns, combine, bits), columns, combine, bits, levels - 1, True)
        ahead = earlier.withColumn("_bucket", F.col("_i")).select(dealt.columns)
        dealt = dealt.unionByName(ahead).where(F.col("_bucket").isNotNull())

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ahead = rows["_some"].notna().to_numpy()
        values = _columns(rows, columns)
        if levels:  # each bucket has one row ahead, then its own rows
            carried = np.repeat(rows["_some"].to_numpy()[ahead].astype(bool), np.diff(np.append(np.flatnonzero(ahead), len(rows))) - 1)
            before = {c: np.repeat(v[ahead], np.diff(np.append(np.flatnonzero(ahead), len(rows))) - 1) for c, v in values.items()}
            values, starts = _part(values, ~ahead), np.append(False, starts)[:-1][~ahead]
            rows = rows[~ahead]
        else:
            carried, before = np.zeros(len(rows), bool), {c: np.repeat(v[starts], np.diff(np.append(np.flatnonzero(starts), len(rows)))) for c, v in values.items()}
        done = combine_running(values, starts, combine)
        if carried.any():
            after = combine(_part(before, carried), _part(done, carried))
            place = np.argsort(np.concatenate([np.flatnonzero(~carried), np.flatnonzero(carried)]))
            done = {c: np.concatenate([done[c][~carried], after[c]])[place] for c in columns}
        some = np.full(len(rows), True)
        if exclusive:
            moved = np.maximum(np.arange(len(rows)) - 1, 0)
            place = np.where(starts, len(rows) + np.arange(len(rows)), moved)
            done = {c: np.concatenate([done[c], before[c]])[place] for c in columns}
            some[starts] = carried[starts]
        return pd.DataFrame({"_g": rows["_g"].to_numpy(), "_i": rows["_i"].to_numpy(), "_some": some, **done})

    return _in_buckets(dealt, run, f"_g string, _i bigint, _some boolean, {_fields(rows, columns)}", F.col("_some").isNull())
