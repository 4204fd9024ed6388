"""Best-fit packing of documents into sequences of bounded length.

Documents are range-sorted by length, so that every piece knows its rank among the pieces of its length.
Gaps and documents are then matched in bulk-synchronous steps from long to short: in one step all
documents of a length look for their successor among the gaps (the smallest gap that is large enough),
rank decides which of them gets which gap, the gaps are updated, and the next step follows. Both sides of
the sweep are kept as runs: documents as (length, how many), gaps as (gap, first sequence, how many). There
are at most ``capacity`` lengths, and each step splits or opens at most three runs of gaps, so this state
has a proven size whatever the input holds; only the ranks grow with the data, and they stay distributed.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import per_worker, pick, stage
from gridloom.llm.tokens import END, Encoder, default_vocabulary
from gridloom.operators.index import rank_rows

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and ``END``; a null text is an empty one. Up to ``capacity`` ids are one piece; longer
    documents are cut into pieces of ``capacity`` ids, of which only the first may be shorter. ``ids`` and the
    checksum are over little-endian unsigned 32-bit ids. Rows with equal or null ids are documents of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    vocabulary = vocabulary or default_vocabulary()
    end = END.to_bytes(4, "little")

    def cut(frames):
        import pandas as pd

        encoder = per_worker(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
        for frame in frames:
            out = []
            for doc, text in zip(frame["id"], frame["text"]):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * lo : 4 * hi]
                    out.append((doc, k, lo, hi - lo, zlib.crc32(part), part)[: 6 if with_ids else 5])
            columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            pieces = pd.DataFrame(out, columns=columns)
            pieces["doc_id"] = pieces["doc_id"].astype(frame["id"].dtype)
            yield pieces

    rows = pick(docs, id=id_column, text=text)
    schema = PIECES.format(id=rows.schema["id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    return rows.mapInPandas(cut, schema)


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over runs: ``(length, from rank, to rank, first sequence, per sequence, offset)`` rows, and the number of sequences.

    The documents of a length with ranks from..to-1 go, ``per sequence`` at a time, to consecutive sequences
    from ``first sequence`` on, where they start at ``offset``.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many sequences), sorted by gap
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, changed = counts[length], 0, []
        while left:
            at = bisect.bisect_left(gaps, (length,))
            gap, first, many = gaps.pop(at) if at < len(gaps) else (capacity, opened, -(-left // (capacity // length)))
            if first == opened:
                opened += many
            each = gap // length
            full = min(many, left // each)
            for sequences, per in ((full, each), (1 if full < many and left - full * each else 0, left - full * each)):
                if sequences:
                    rows.append((length, rank, rank + sequences * per, first, per, capacity - gap))
                    if gap > per * length:
                        changed.append((gap - per * length, first, sequences))
                    rank, left, first, many = rank + sequences * per, left - sequences * per, first + sequences, many - sequences
            if many:
                changed.append((gap, first, many))
                if left:
                    raise AssertionError("gaps were left over")
        for run in changed:
            bisect.insort(gaps, run)
    return rows, opened


def pack(items: DataFrame, length: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 1024) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: in each sequence items lie gapless from 0 and fill ``capacity`` at most.

    Lengths must lie in 1..capacity, else the job fails. ``order_by`` ranks items of equal length; rows that tie
    are told apart by position. An empty table stays empty.
    """
    clash = {"sequence_id", "offset", "_rank", "_length"} & set(items.columns)
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    spark = items.sparkSession
    checked = F.when(F.col(length).between(1, capacity), F.col(length).cast("int")).otherwise(F.raise_error(F.lit("a length lies outside 1..capacity")))
    items = stage(items.withColumn("_length", checked), "pieces")
    counts = {r["_length"]: r["count"] for r in items.groupBy("_length").count().collect()}  # at most ``capacity`` rows
    rows, _ = plan_runs(counts, capacity)
    plan = spark.createDataFrame(rows, "_run int, _from long, _to long, _first long, _per long, _offset long")
    ranked = rank_rows(items, list(order_by), "_rank", keys=["_length"])
    here = (F.col("_length") == F.col("_run")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(plan), here)
        .withColumn("sequence_id", F.col("_first") + F.floor(nth / F.col("_per")))
        .withColumn("offset", F.col("_offset") + (nth % F.col("_per")) * F.col("_length"))
        .drop("_length", "_rank", "_run", "_from", "_to", "_first", "_per", "_offset")
    )
