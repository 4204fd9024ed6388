"""Test items inside documents, up to a few edits, by pigeonhole pieces and bit-parallel verification.

An item with an error budget of ``k`` edits is split into ``k + 1`` pieces: whatever the edits, one piece is left whole.
All pieces of all items are searched at once in the whole text of each document; each hit names an item and a place,
and there Myers' bit-parallel algorithm computes the edit distance of the item to the best substring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, pick, row_key

#: edits allowed per character of an item, and the fewest characters of a piece
RATE, LEAST_PIECE = 0.08, 8
#: characters of items that one pass over the documents searches for (broadcast); more items take more passes
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, with single spaces for white space."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return max(0, min(int(len(item) * rate), len(item) // LEAST_PIECE - 1))


def split_item(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``pattern`` to a substring of ``text`` and where that ends, if it is at most ``most``."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, doc_id, item_id, distance, ends``: items found in documents, with the least number of edits and where such a match ends.

    Texts and items are compared in lower case with single spaces. An item of ``n`` characters may differ by ``n * rate``
    edits (rounded down; none for items of fewer than 16 characters). Null, empty and white-space items and texts match nothing; of
    equal items each is reported; equal rows of ``docs`` are reported once each.
    """
    source = pick(docs, doc_id=id_column, text=text).withColumn("key", row_key("doc_id", "text"))
    wanted = pick(items, item=item_id, t=item_text).where(F.length(F.trim("t")) > 0)
    chars = wanted.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    parts = [
        _find_block(source, [(r["item"], r["t"]) for r in wanted.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()], wanted, rate)
        for b in range(blocks)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _find_block(source: DataFrame, block: list, wanted: DataFrame, rate: float) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS at most, or one item

    def search(frames):
        import ahocorasick
        import pandas as pd

        items = [(i, normal(t)) for i, t in shared.value]
        items = [(i, t, budget(t, rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(items):
            for offset, piece in split_item(t, k):
                places.setdefault(piece, []).append((n, offset + len(piece) - 1))
        automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            automaton.add_word(piece, at)
        automaton.make_automaton()
        for frame in frames:
            out = []
            for key, doc, text in zip(frame["key"], frame["doc_id"], frame["text"]):
                text = normal(text)
                if not text or not places:
                    continue
                starts: dict[int, set[int]] = {}
                for end, at in automaton.iter(text):
                    for n, offset in at:
                        starts.setdefault(n, set()).add(end - offset)
                for n, found in starts.items():
                    i, item, k = items[n]
                    best, upto = None, -1
                    lo = None
                    for s in [*sorted(found), None]:  # hits of overlapping stretches are verified together
                        if lo is not None and (s is None or s - k > upto):
                            hit = myers(item, text[lo:upto], k)
                            if hit and (best is None or hit[0] < best[0]):
                                best = (hit[0], lo + hit[1])
                            lo = None
                        if s is not None:
                            lo = max(0, s - k) if lo is None else lo
                            upto = s + len(item) + k
                    if best:
                        out.append((key, doc, i, *best))
            hits = pd.DataFrame(out, columns=["key", "doc_id", "item_id", "distance", "ends"])
            yield hits

    ids = source.schema["doc_id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    return source.mapInPandas(search, f"key binary, doc_id {ids[0]}, item_id {ids[1]}, distance int, ends long")


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item. All columns stay."""
    key = free_name(docs, "_key")
    hits = find_items(docs, items, rate, id_column, text).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_column, text)).join(hits, key, "left_anti").drop(key)
