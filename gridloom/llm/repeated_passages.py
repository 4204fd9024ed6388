"""Exact repeated passages: every byte string of a given length that starts in more than one place.

Which shard: every window of ``length`` bytes has a minimizer (its 16-byte gram of least hash), at the same place in
equal windows. Windows of a text with the same minimizer in the same half of the window are consecutive; such a
run (a *piece* of bytes) is keyed by the hash of its context, the bytes around the minimizer that all windows of
its kind hold. So equal windows have equal contexts. A piece whose context occurs nowhere else holds no repeat; equal pieces are repeats as they stand, and one of them
stays for the rest. Only different pieces of one context need their suffixes compared.

Suffix arrays: contexts are dealt to shards of bounded size, a context with too many pieces to several. A shard
joins its pieces, sorts the suffixes by Larsson-Sadakane refinement (groups of equal prefix are refined by the rank
of the suffix further on, prefix lengths double, sorted groups are left alone) and takes common prefixes by Kasai's
order. Suffixes that share ``length`` bytes with a neighbour are repeats. Where a context was dealt to several
shards, the sorted window names of each shard are range-partitioned, and each shard's list is looked up in the
merged ones by binary search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ITERATOR, mix64, pick, row_key, stage

GRAM = 16
#: bytes of pieces in a shard, about
SHARD_BYTES = 1_500_000


def pieces_of(b: bytes, length: int):
    """``(first window, last window, context hash, name of the piece)`` of each run of windows."""
    import hashlib

    import numpy as np

    n = len(b)
    if n < length:
        return []
    w = length - GRAM + 1
    half = (w + 1) // 2
    context = length - half + 1
    words = np.ndarray((n - 7,), dtype="<u8", buffer=b, strides=(1,))
    gram = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(32)
    gram += words[8:]
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.arange(len(gram), dtype=np.uint64)
    starts = n - length + 1
    # minimum of w grams from each start: of the rest of its block and the beginning of the next
    blocks = -(-len(gram) // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(gram)] = gram
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    early = at - np.arange(starts) >= half  # the minimizer lies in the second half of the window
    cuts = np.flatnonzero((at[1:] != at[:-1]) | (early[1:] != early[:-1])) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts, [starts])) - 1
    # bytes that all windows of the run hold, at the same distance from the minimizer
    p = at[first] - np.where(early[first], half, 0)
    offsets = np.array([*range(0, context - 8, 8), context - 8])
    odd = mix64(np.arange(1, len(offsets) + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.empty(len(p), dtype=np.uint64)
    for lo in range(0, len(p), 20_000):
        part = words[p[lo : lo + 20_000, None] + offsets]
        part ^= part >> np.uint64(31)
        h[lo : lo + 20_000] = mix64((part * odd).sum(axis=1, dtype=np.uint64) + early[first[lo : lo + 20_000]])
    names = [hashlib.blake2b(b[lo : hi + length], digest_size=16).digest() for lo, hi in zip(first.tolist(), last.tolist())]
    return list(zip(first.tolist(), last.tolist(), h.view(np.int64).tolist(), names))


def suffix_array(text, ends, depth: int):
    """Order of the suffixes of joined byte pieces, right for prefixes of ``depth`` bytes or more.

    ``ends`` holds the place behind each piece, where a symbol stands that occurs nowhere else. Larsson-Sadakane: a
    suffix's rank is the first place of its group; each pass sorts the suffixes of open groups by the rank of the
    suffix ``k`` further on and doubles ``k``; groups of one are closed. Prefixes of eight bytes are ranked at once.
    """
    import numpy as np

    n, k = len(text), 8
    key = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        key[: n - j] |= text[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    alone = np.unique(np.clip(ends[:, None] - np.arange(k), 0, None))  # prefixes that run into an end
    inner = np.ones(n, dtype=bool)
    inner[alone] = False
    open_ = np.flatnonzero(inner)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = n
    rank[alone] = len(open_) + np.arange(len(alone))
    key = key[open_]
    by = np.argsort(key)
    open_, key = open_[by], key[by]
    old = np.zeros(len(open_), dtype=np.int64)
    while len(open_):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
        starts = np.flatnonzero(new)
        group = np.concatenate(([True], old[1:] != old[:-1]))
        group_start = np.flatnonzero(group)[np.cumsum(group) - 1]
        sizes = np.diff(np.append(starts, len(open_)))
        place = old + np.repeat(starts, sizes) - group_start
        rank[open_] = place
        if k >= depth:
            break
        more = np.repeat(sizes > 1, sizes)
        open_, old = open_[more], place[more]
        key = rank[np.minimum(open_ + k, n)]
        by = np.argsort(old * (n + 1) + key)
        open_, old, key = open_[by], old[by], key[by]
        k *= 2
    return np.argsort(rank[:n], kind="stable")


def common_prefixes(text, ends, order, depth: int):
    """``lcp, before``: the suffix before each in order, and how many bytes they share, up to ``depth``.

    Kasai: the suffix one further on shares at most one byte less with its own neighbour, so a whole stretch whose
    neighbours move along with it shares one mismatch. Stretches that end without one go on where their partner
    leads, eight bytes at a time, once for the whole stretch.
    """
    import numpy as np

    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    ended = np.zeros(n, dtype=bool)
    ended[ends] = True
    partner = np.maximum(before, 0)
    differs = (before < 0) | (text != text[partner]) | ended | ended[partner]
    moved = np.concatenate((before[1:] != before[:-1] + 1, [True]))  # the stretch ends behind this place
    stop = np.minimum.accumulate(np.where(differs | moved, here, n)[::-1])[::-1]
    # up to the mismatch; where a stretch ends without one, its last place is followed on from its partner
    words = np.ndarray((n,), dtype="<u8", buffer=text.tobytes() + b"\0" * 8, strides=(1,))
    left = ends[np.searchsorted(ends, here)] - here
    last = np.flatnonzero(moved & ~differs)
    beyond = np.zeros(n, dtype=np.int64)
    a, b = last + 1, before[last] + 1
    limit = np.minimum(np.minimum(left[last], left[before[last]]) - 1, depth)
    got, going = np.zeros(len(last), dtype=np.int64), np.flatnonzero(limit > 0)
    while len(going):
        x = words[a[going] + got[going]] ^ words[b[going] + got[going]]
        same = x == 0
        low = np.where(same, np.uint64(1), x & (~x + np.uint64(1)))
        got[going] += np.where(same, 8, np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        going = going[same & (got[going] < limit[going])]
    beyond[last] = np.minimum(got, limit)
    lcp = stop - here + np.where(differs[stop], 0, 1 + beyond[stop])
    return np.minimum(lcp, depth), before


def shard_repeats(pieces: list[bytes], length: int):
    """For each piece a boolean array over its windows: the window starts elsewhere in the shard too."""
    import numpy as np

    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(joined, first + sizes, length)
    lcp, before = common_prefixes(joined, first + sizes, order, length)
    hit = np.zeros(len(joined), dtype=bool)
    deep = np.flatnonzero(lcp >= length)
    hit[deep] = True
    hit[before[deep]] = True
    return [hit[a : a + n - length + 1] for a, n in zip(first, sizes)]


def runs_of(mask) -> list[tuple[int, int]]:
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``key, lo, hi``: stretches of windows ``lo..hi-1`` that start elsewhere too, for ``key, text``. Stretches of one
    key may overlap or touch."""
    if length < 80:
        raise ValueError("passages of fewer than 80 bytes are not looked for")
    spark = docs.sparkSession

    def cut(frames):
        import pandas as pd

        for frame in frames:
            out = [(key, *p) for key, text in zip(frame["key"], frame["text"]) for p in pieces_of((text or "").encode(), length)]
            yield pd.DataFrame(out, columns=["key", "first", "last", "context", "piece"])

    runs = stage(docs.mapInPandas(cut, "key binary, first int, last int, context long, piece binary"), "runs", compression="zstd")
    often = runs.groupBy("context").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1).select("context")
    live = stage(runs.join(often, "context"), "live", compression="zstd")
    pieces = live.groupBy("context", "piece").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("key", "first", "last")).alias("at"))
    pieces = stage(pieces, "pieces", compression="zstd")
    whole = pieces.where(F.col("many") > 1).select("context", "piece")
    done = live.join(whole, ["context", "piece"], "left_semi").select("key", F.col("first").alias("lo"), (F.col("last") + 1).alias("hi"))

    # contexts with different pieces, and over how many shards each is dealt
    size = F.col("at.last") - F.col("at.first") + length
    mixed = pieces.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("bytes")).where(F.col("kinds") > 1)
    mixed = stage(mixed.withColumn("parts", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")), "mixed")
    total = mixed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = pieces.join(mixed, "context").select(
        "context", "piece", "many", "at.*", "parts",
        F.pmod(F.xxhash64("context", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("piece"), F.col("parts")))), F.lit(shards)).alias("shard"),
    )
    places = dealt.groupBy("key").agg(F.collect_list(F.struct("first", "last", "context", "piece", "many", "parts", "shard")).alias("places"))

    def slices(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for text, places in zip(frame["text"], frame["places"]):
                b = text.encode()
                out += [(p["shard"], p["context"], p["piece"], p["many"], p["parts"], b[p["first"] : p["last"] + length]) for p in places]
            yield pd.DataFrame(out, columns=["shard", "context", "piece", "many", "parts", "bytes"])

    needed = docs.join(places, "key").dropDuplicates(["key"])
    cut_out = needed.mapInPandas(slices, "shard long, context long, piece binary, many long, parts int, bytes binary")

    def sort_shard(frame):
        import hashlib

        import pandas as pd

        pieces = frame["bytes"].tolist()
        out, names, told = [], [], set()
        for row, hit in zip(frame.itertuples(index=False), shard_repeats(pieces, length)):
            if row.many == 1:
                out += [(row.context, row.piece, lo, hi, None) for lo, hi in runs_of(hit)]
            if row.parts > 1:  # other shards hold this context too
                for x, again in enumerate(hit):
                    name = hashlib.blake2b(row.bytes[x : x + length], digest_size=16).digest()
                    if not again or name not in told:  # repeats inside the shard are settled: one tells the others
                        names.append((row.context, row.piece, x, x + 1, name))
                    if again:
                        told.add(name)
        return pd.DataFrame(out + names, columns=["context", "piece", "lo", "hi", "name"])

    def typed(frame: "pd.DataFrame") -> "pd.DataFrame":  # noqa: F821
        return sort_shard(frame)

    typed.__annotations__.clear()
    found = cut_out.groupBy("shard").applyInPandas(typed, "context long, piece binary, lo int, hi int, name binary")
    found = stage(found, "found", compression="zstd")

    def merge(frames):
        """Range partitions hold all equal names, in order: a name that the list before it holds is found by binary search."""
        import numpy as np
        import pandas as pd

        held = np.empty(0, dtype="S32")
        last = None
        for frame in frames:
            names = np.array([x.hex() for x in frame["name"]], dtype="S32")
            at = np.searchsorted(names, names, side="left")
            upto = np.searchsorted(names, names, side="right")
            again = upto - at > 1
            if last is not None and len(names):
                again |= names == held[-1]
            carried = last
            if len(names):
                open_ = names == names[-1]
                keep = frame[open_].assign(again=again[open_])
                frame = frame.assign(again=again)
                if carried is not None:
                    joined = carried["again"] | (names[0] == held[-1])
                    yield carried.loc[joined, ["context", "piece", "lo", "hi"]]
                yield frame.loc[~open_ & again, ["context", "piece", "lo", "hi"]]
                last, held = keep, names[-1:]
        if last is not None:
            yield last.loc[last["again"], ["context", "piece", "lo", "hi"]]
        else:
            yield pd.DataFrame({"context": [], "piece": [], "lo": [], "hi": []})

    names = found.where(F.col("name").isNotNull()).select("context", "piece", "lo", "hi", "name")
    merged = names.repartitionByRange("name").sortWithinPartitions("name").mapInPandas(merge, "context long, piece binary, lo int, hi int")
    within = found.where(F.col("name").isNull()).select("context", "piece", "lo", "hi").unionByName(merged)
    within = within.groupBy("context", "piece").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rest = (
        live.join(within, ["context", "piece"])
        .select("key", "first", F.explode("spans").alias("s"))
        .select("key", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi")).alias("hi"))
    )
    return done.unionByName(rest)


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_n_bytes, _spans, _kept, _kept_text``: UTF-8 size, maximal removed byte runs ``(lo, hi)``, the bytes left
    and, where some were removed, these as text without what is no whole character (else null). One function makes all
    four: a second one would take another Python worker for each task, and workers stay.

    Every byte that lies in a string of ``length`` bytes which also starts elsewhere (any document, itself included,
    overlaps too) is removed; strings are judged on the input. A null text is an empty one. Rows that are equal in id
    and text are copies of each other, and so lose all that is long enough. All columns of ``docs`` stay.
    """
    clash = {"_n_bytes", "_spans", "_kept", "_kept_text", "_key", "_found"} & set(docs.columns)
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    source = pick(docs, doc_id=id_column, text=text).select(row_key("doc_id", "text").alias("key"), "text")
    spans = repeated_spans(source, length)
    found = spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("_found")).withColumnRenamed("key", "_key")
    joined = docs.withColumn("_key", row_key(id_column, text)).join(found, "_key", "left").drop("_key")

    def strip(batches):
        import pandas as pd

        for texts, found in batches:
            out = []
            for text, spans in zip(texts, found):
                b, runs = (text or "").encode(), []
                for lo, hi in sorted((s["lo"], s["hi"] + length - 1) for s in (spans if spans is not None else ())):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *(x for r in runs for x in r), len(b)]
                kept = b"".join(b[lo:hi] for lo, hi in zip(edges[::2], edges[1::2]))
                out.append((len(b), [{"lo": lo, "hi": hi} for lo, hi in runs], kept, kept.decode("utf-8", "ignore") if runs else None))
            yield pd.DataFrame(out, columns=["n_bytes", "spans", "kept", "kept_text"])

    stripped = F.pandas_udf(strip, "n_bytes long, spans array<struct<lo:int,hi:int>>, kept binary, kept_text string", functionType=ITERATOR)
    return joined.withColumn("_s", stripped(joined[f"`{text}`"], "_found")).withColumns(
        {"_n_bytes": F.col("_s.n_bytes"), "_spans": F.col("_s.spans"), "_kept": F.col("_s.kept"), "_kept_text": F.col("_s.kept_text")}
    ).drop("_s", "_found")
