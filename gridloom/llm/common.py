"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import stage, unstage  # noqa: F401  (for the modules here)

#: steps to a doubling of a rank, and parts of a step
RANK_STEPS, RANK_PARTS = 16, 8


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names; whatever else the table holds cannot clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """16 bytes that name a row by its values. Equal rows share a key, which is right where equal rows share a result."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls into ``fold``; a null id counts as training data."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def head_of(df: DataFrame, rank: str, name: str, most: int, kind: str | None = None) -> DataFrame:
    """The rows of greatest ``rank`` (above 0), ``most`` of each ``kind`` or somewhat fewer.

    ``limit`` behind ``orderBy`` would send as many rows of every partition to the driver. Here the driver gets counts of
    steps of the rank, each dealt to a few parts by the hash of ``name``, and whole parts are taken while there is room.
    """
    kind_of = F.lit(0) if kind is None else F.col(kind)
    place = F.floor(F.log2(rank) * RANK_STEPS) * RANK_PARTS + F.pmod(F.xxhash64(name), F.lit(RANK_PARTS))
    counts = df.groupBy(kind_of.alias("kind"), place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, last = {}, {}
    for r in sorted(counts, key=lambda r: -r["place"]):
        room[r["kind"]] = room.get(r["kind"], most) - r["n"]
        if room[r["kind"]] >= 0:
            last[r["kind"]] = r["place"]
    taken = [(kind_of == k) & (place >= least) for k, least in last.items()]
    return df.where(reduce(Column.__or__, taken, F.lit(False)))


def mix64(x):
    """Bijective mixing of a uint64 array, so that all output bits depend on all input bits."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def per_worker(name: str, build):
    """``build()``, once per Python worker process: Spark reuses a worker for many tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, build())
    return getattr(kept, name)


def release_workers() -> None:
    """Drop what ``per_worker`` keeps in this worker, and give back what earlier tasks have left behind: a task with large
    tables of its own makes room first."""
    import gc
    import sys

    import pyarrow as pa

    kept = sys.modules.get("_gridloom_worker")
    if kept is not None:
        for name in [n for n in vars(kept) if not n.startswith("__")]:
            delattr(kept, name)
    gc.collect()
    pa.default_memory_pool().release_unused()


#: kind of a pandas function from an iterator of batches to an iterator of batches
ITERATOR = 204
