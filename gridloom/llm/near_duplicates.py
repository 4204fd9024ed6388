"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round ``i`` every shingle is hashed to one of ``t`` bins with a value that starts with ``i``; a bin keeps
its minimum. After ``t`` rounds, round ``t + b`` sends every shingle to bin ``b`` alone, so every bin is filled. Two
sets agree in a bin with probability equal to their similarity, and the mean over bins is concentrated as
for independent hash functions, at the cost of about ``n + t log t`` hashes instead of ``n t``.

Bands of the sketch give buckets. A link is never looked for among all pairs of a bucket: equal sets are one
node; nodes are first compared with the most central node of their buckets; nodes that this leaves in
different components are compared with some members of the largest component in each of their buckets; what is
still apart gets a second, wider sketch of one bit a bin, and the join of each bucket with itself, which Spark splits,
lets only pairs through whose bits say that they may reach the limit. Pairs inside one component need no comparison,
as only components are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, mix64, pick, row_key, stage
from gridloom.operators.graph import component_labels

#: share of the pairs at the limit that no band may bring together; rows of a band, fewer where that takes more bands than these
MISSED, ROWS, MOST_BANDS = 1e-6, 10, 128
#: rounds of comparing with chosen members before what is left is compared in full
CHOSEN_ROUNDS = 2
#: bins of the bit sketch, and how far from the mean a pair at the limit may lie
BITS, DEVIATIONS = 2048, 5


def banding(percent: int) -> tuple[int, int]:
    """Bands and their rows by which pairs at the limit are missed with a probability of ``MISSED`` or less."""
    limit = max(percent, 1) / 100
    for rows in range(ROWS, 0, -1):
        bands = 1 if limit >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(limit**rows)))
        if bands <= MOST_BANDS:
            break
    return bands, rows


def shingle_set(text: str | None, words: int, known: dict):
    """Sorted distinct 64-bit hashes of the word shingles. A-Z is lower-cased, words end at ASCII white space; fewer
    words than ``words`` are one shingle, no word is none."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in set(found).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    x = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(x))
    h = np.full(len(x) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = mix64(h ^ x[k : len(x) - width + 1 + k])
    return np.unique(h)


def sketch(x, bins: int):
    """The filled bins of a non-empty set of 64-bit hashes; equal bins mean equal minima."""
    import numpy as np

    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    seeds = mix64(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rounds = min(bins, max(1, int(bins * np.log(bins) / len(x)) + 1))  # about as many as fill the bins
    done = 0
    while done < bins:
        last = min(bins, done + rounds)
        h = mix64(x[None, :] ^ seeds[done:last, None])
        value = (np.arange(done, last, dtype=np.uint64)[:, None] << half) | (h & low)
        np.minimum.at(out, (((h >> half) * np.uint64(bins)) >> half).astype(np.int64).ravel(), value.ravel())
        done = last
        if out.max() != np.iinfo(np.uint64).max:
            return out
        rounds = max(1, rounds // 4)
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = (np.uint64(bins + b) << half) | (mix64(x ^ seeds[bins + b]) & low).min()
    return out


def band_keys(x, bands: int, rows: int):
    import numpy as np

    s = sketch(x, bands * rows).reshape(bands, rows)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        key = mix64(key ^ s[:, r] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def signatures(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """``key, doc_id, n, node, bands`` for ``key, doc_id, text``: ``node`` names the shingle set (16 bytes)."""

    def sign(frames):
        import hashlib

        import pandas as pd

        known: dict[bytes, int] = {}
        for frame in frames:
            out = []
            for text in frame["text"]:
                x = shingle_set(text, words, known)
                node = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None
                out.append((len(x), node, band_keys(x, bands, band_rows) if len(x) else None))
            yield pd.concat([frame[["key", "doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "node", "bands"])], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(sign, f"key binary, doc_id {kind}, n long, node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``src, dst`` those whose full shingle sets have a similarity of ``percent`` or more."""

    def verify(frames):
        import numpy as np

        known: dict[bytes, int] = {}
        last, held = None, None
        for frame in frames:
            keep = []
            for dst, a, b in zip(frame["dst"], frame["ta"], frame["tb"]):
                if dst != last:
                    last, held = dst, shingle_set(b, words, known)
                x = shingle_set(a, words, known)
                both = len(np.intersect1d(x, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(held) - both) and both > 0)
            yield frame.loc[keep, ["src", "dst"]]

    joined = (
        pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("ta")), "src")
        .join(texts.select(F.col("node").alias("dst"), F.col("text").alias("tb")), "dst")
        .select("src", "dst", "ta", "tb")
    )
    return joined.mapInPandas(verify, "src binary, dst binary")


def similar(a: str, b: str, percent: int):
    """Sets of these sizes can reach ``percent``."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def bit_sketch(x):
    """``BITS`` bits of a wide sketch, as longs: bits of two sets agree with probability ``(1 + similarity) / 2``."""
    import numpy as np

    return np.packbits((sketch(x, BITS) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def with_bits(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``members`` with the bit sketch of each node and all of its bands here, of which a sketch has a fixed number."""

    def sign(frames):
        import pandas as pd

        known: dict[bytes, int] = {}
        for frame in frames:
            bits = [bit_sketch(shingle_set(t, words, known)) for t in frame["text"]]
            yield pd.DataFrame({"node": frame["node"], "bits": bits, "all_bands": frame["all_bands"]})

    here = members.groupBy("node").agg(F.collect_set("band").alias("all_bands"))
    signed = texts.join(here, "node").select("node", "text", "all_bands").mapInPandas(sign, "node binary, bits array<long>, all_bands array<long>")
    return members.join(signed, "node")


def alike(a: str, b: str, percent: int):
    """No more bits differ than ``DEVIATIONS`` standard deviations above the mean of sets at the limit."""
    apart = (1 - percent / 100) / 2
    most = math.ceil(BITS * apart + DEVIATIONS * math.sqrt(BITS * apart * (1 - apart)))
    differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda total, k: total + k) <= most


def links(sigs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``src, dst`` nodes that are linked: enough of them to connect every component."""
    reps = sigs.where(F.col("n") > 0).groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = reps.select("node", "n", F.explode("bands").alias("band"))
    shared = reps.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
    members = stage(rows.join(shared, "band"), "members")
    central = members.groupBy("node").agg(F.sum("many").alias("weight"), F.first("n").alias("n"))
    central = stage(central, "central")
    wanted = central.select("node").join(reps.select("node", "key"), "node")
    texts = stage(docs.join(wanted, "key").dropDuplicates(["node"]).select("node", "text"), "candidates", compression="zstd")

    weighed = members.join(central.select("node", "weight"), "node")
    best = weighed.groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    near = weighed.join(best, "band").where((F.col("node") != F.col("hub.node")) & similar("n", "hub.n", percent))
    first = near.groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("node").alias("src"), F.col("hub.node").alias("dst"))
    tried = stage(first, "tried")
    found = stage(verified(tried, texts, words, percent), "links")

    for turn in range(CHOSEN_ROUNDS + 1):
        labels = component_labels(found)
        placed = members.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("band")
        open_ = stage(placed.join(apart, "band").select("band", "node", "n", "component"), "open")
        if turn < CHOSEN_ROUNDS:
            groups = open_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "n")).alias("hub"))
            hubs = groups.groupBy("band").agg(F.max(F.struct("many", "component", "hub")).alias("top")).select("band", F.col("top.component").alias("there"), F.col("top.hub.node").alias("other"), F.col("top.hub.n").alias("m"))
            pairs = open_.join(hubs, "band").where(F.col("component") != F.col("there"))
        else:
            open_ = stage(with_bits(open_, texts, words), "open-bits")
            others = open_.select("band", F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("there"), F.col("bits").alias("those"), F.col("all_bands").alias("their_bands"))
            # a pair that meets in several buckets comes out of one of them
            once = F.col("band") == F.array_min(F.array_intersect("all_bands", "their_bands"))
            pairs = open_.join(others, "band").where((F.col("component") < F.col("there")) & similar("n", "m", percent) & alike("bits", "those", percent) & once)
        pairs = pairs.where(similar("n", "m", percent)).select(F.col("node").alias("src"), F.col("other").alias("dst")).distinct()
        pairs = stage(pairs.join(tried, ["src", "dst"], "left_anti"), "pairs")
        found = found.unionByName(stage(verified(pairs, texts, words, percent), "links"))
        tried = tried.unionByName(pairs)
    return found


def marked(docs: DataFrame, words: int, percent: int, bands: int | None, rows: int | None, id_column: str, text: str) -> DataFrame:
    """``key, doc_id, n, component, component_id``: ``component`` names the component itself, null without words."""
    source = pick(docs, doc_id=id_column, text=text).withColumn("key", row_key("doc_id", "text"))
    if bands is None or rows is None:
        bands, rows = banding(percent)
    sigs = stage(signatures(source, words, bands, rows), "signatures", compression="zstd")
    labels = component_labels(links(sigs, source.select("key", "text"), words, percent)).withColumnRenamed("id", "node")
    flat = sigs.select("key", "doc_id", "n", "node")
    groups = flat.groupBy("node").agg(F.min("doc_id").alias("lowest")).where(F.col("node").isNotNull()).join(labels, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node"))
    lowest = groups.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_node = groups.select("node", "component").join(lowest, "component").select("node", "component", "component_id")
    return flat.join(by_node, "node", "left").drop("node")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``key, doc_id, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets have a similarity of ``percent`` or more; ``component_id`` is the
    smallest id reachable over links. Each true link is found with probability ``1 - (1 - s**rows)**bands`` or
    better and confirmed on the full sets. Bands and rows follow from ``percent`` (see ``banding``; 64 of 10 at 85, 122 of 10 at
    80), unless both are given, so that fewer than one in a million links is missed; the bit sketch loses fewer than one in a million more. Documents without words (null,
    empty, white space) are linked with nothing. A null id is never the smallest, unless all ids of the component
    are null; rows with equal ids stay rows of their own. ``key`` names a row by its values (see ``row_key``).
    """
    return marked(docs, words, percent, bands, rows, id_column, text).select(
        "key", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group left: the smallest id (null last), then the smallest key. All
    columns stay; of rows that are equal in id and text one stays. Groups are told apart by their links, not by their
    ids, which may be null or repeated."""
    marks = marked(docs, words, percent, None, None, id_column, text)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least")
    key = free_name(docs, "_key")
    chosen = marks.groupBy(F.coalesce("component", "key").alias("group"), F.col("component").isNull().alias("alone")).agg(least).select(F.col("least.key").alias(key))
    keyed = docs.withColumn(key, row_key(id_column, text))
    return keyed.join(chosen.distinct(), key, "left_semi").dropDuplicates([key]).drop(key)
