"""Training order on disk: every sequence gets a global slot by a keyed permutation and is written there.

The permutation is a Feistel network over the next even power of two, walked along its cycles until it
lands inside the number of sequences. Slots are dealt to shards in ranges; a shard is one file of records of
equal size in slot order, so slot ``s`` lies at byte ``(s % shard_rows) * stride`` of shard ``s // shard_rows``
and a reader can go on anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import mix64, per_worker, pick, stage
from gridloom.llm.tokens import END, Encoder, default_vocabulary

#: fills a record behind its last id; no vocabulary of up to 65,535 ids holds it
PAD = 65535
ROUNDS = 6


def permuted(index, total: int, key: int):
    """Slots of an array of indexes in 0..total-1: a bijection that ``key`` chooses."""
    import numpy as np

    half = np.uint64(max(1, ((max(total, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    seeds = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    slots = np.array(index, dtype=np.uint64)
    walking = np.arange(len(slots))
    while len(walking):
        left, right = slots[walking] >> half, slots[walking] & mask
        for seed in seeds:
            left, right = right, left ^ (mix64(right ^ seed) & mask)
        slots[walking] = (left << half) | right
        walking = walking[slots[walking] >= np.uint64(total)]
    return slots.astype(np.int64)


def token_rows(docs: DataFrame, seq_len: int, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, part, local``: a document's ids (16 bit, ``END`` last) and the number of its first
    sequence among those of its task. A null text is an empty one."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(frames):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        encoder = per_worker(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
        if encoder.tokenizer.get_vocab_size() > PAD:
            raise ValueError("the vocabulary has ids that 16 bits cannot hold")
        part, local = TaskContext.get().partitionId(), 0
        for frame in frames:
            ids = [np.append(np.frombuffer(encoder.encode(t or ""), "<u4"), END).astype("<u2") for t in frame["text"]]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            many = -(-n // seq_len)
            first = local + np.cumsum(many) - many
            local += int(many.sum())
            yield pd.DataFrame({"doc_id": frame["id"], "n_tokens": n, "ids": [x.tobytes() for x in ids], "part": part, "local": first})

    rows = pick(docs, id=id_column, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(encode, f"doc_id {kind}, n_tokens long, ids binary, part int, local long")


def write_training_order(
    docs: DataFrame, path: str, key: int = 20240229, seq_len: int = 256, shard_rows: int = 32_768,
    vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write all sequences of ``docs`` below ``path`` and return ``doc_id, piece, start, n_tokens, slot, shard, row``.

    A sequence is a run of at most ``seq_len`` ids of one document. A record holds ``seq_len`` 16-bit ids, filled
    up with ``PAD``, and two zero bytes, so the stride is ``2 * seq_len + 2``. The files are written by Spark's
    own text sink (a record is a line that ends in the two zero bytes), which commits each task once: lost
    executors leave no torn shard. Empty tables write no shard. The order depends on ``key`` and on how the
    input is partitioned, not on the content. Repeated rows are sequences of their own.
    """
    spark = docs.sparkSession
    spark_conf = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
    tokens = stage(token_rows(docs, seq_len, vocabulary, id_column, text), "tokens", **spark_conf)
    counts = tokens.groupBy("part").agg(F.sum(F.ceil(F.col("n_tokens") / seq_len)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))  # one row per task
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = tokens.join(offsets, "part").withColumn("first", F.col("local") + F.col("before")).drop("part", "local", "before")

    def blobs(frames):
        """The records of a batch by shard, each shard's packed together: less to shuffle than single records."""
        import numpy as np
        import pandas as pd
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=9).compress
        for frame in frames:
            n = frame["n_tokens"].to_numpy()
            many = -(-n // seq_len)
            records = np.full((int(many.sum()), seq_len), PAD, dtype="<u2")
            at = np.cumsum(many) - many
            for lo, ids in zip(at, frame["ids"]):
                ids = np.frombuffer(ids, "<u2")
                records[lo : lo + -(-len(ids) // seq_len)].reshape(-1)[: len(ids)] = ids
            index = np.repeat(frame["first"].to_numpy() - at, many) + np.arange(len(records))
            slot = permuted(index, total, key)
            order = np.argsort(slot)
            slot, records = slot[order], records[order]
            shard = slot // shard_rows
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(slot)] if len(slot) else [0]
            yield pd.DataFrame(
                [(int(shard[a]), squeeze(slot[a:b].tobytes()), squeeze(records[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])],
                columns=["shard", "slots", "records"],
            )

    def unpack(frames):
        import numpy as np
        import pandas as pd
        import zstandard

        for frame in frames:
            for shard, slots, records in zip(frame["shard"], frame["slots"], frame["records"]):
                loosen = zstandard.ZstdDecompressor().decompress
                slots = np.frombuffer(loosen(slots), np.int64)
                records = np.frombuffer(loosen(records), f"V{2 * seq_len}")
                yield pd.DataFrame({"shard": shard, "slot": slots, "record": [r.tobytes() for r in records]})

    if total:
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        (
            numbered.mapInPandas(blobs, "shard long, slots binary, records binary")
            .repartition(width, "shard")
            .mapInPandas(unpack, "shard long, slot long, record binary")
            .sortWithinPartitions("shard", "slot")
            .select("shard", F.col("record").cast("string").alias("value"))
            .write.partitionBy("shard")
            .option("lineSep", "\0\0")
            .option("compression", "none")
            .text(path)
        )

    def manifest(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            n = frame["n_tokens"].to_numpy()
            many = -(-n // seq_len)
            piece = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            slot = permuted(np.repeat(frame["first"].to_numpy(), many) + piece, total, key)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].repeat(many).reset_index(drop=True), "piece": piece, "start": piece * seq_len,
                "n_tokens": np.minimum(seq_len, np.repeat(n, many) - piece * seq_len),
                "slot": slot, "shard": slot // shard_rows, "row": slot % shard_rows,
            })

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return numbered.drop("ids").mapInPandas(manifest, f"doc_id {kind}, piece int, start long, n_tokens long, slot long, shard long, row long")


def read_training_order(spark: SparkSession, path: str, seq_len: int = 256, shard_rows: int = 32_768, from_slot: int = 0) -> DataFrame:
    """``slot, ids`` of the written sequences from ``from_slot`` on; earlier shards are not opened."""
    stride = 2 * seq_len + 2

    def records(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for shard, content in zip(frame["shard"], frame["content"]):
                skip = max(0, from_slot - shard * shard_rows)
                rows = np.frombuffer(content, np.uint8).reshape(-1, stride)[skip:, : 2 * seq_len].copy().view("<u2")
                slots = shard * shard_rows + skip + np.arange(len(rows))
                yield pd.DataFrame({"slot": slots, "ids": [r[r != PAD].astype(np.int32) for r in rows]})

    files = spark.read.format("binaryFile").option("basePath", path).load(f"{path}/shard=*").where(F.col("shard") >= from_slot // shard_rows)
    return files.select(F.col("shard").cast("long"), "content").mapInPandas(records, "slot long, ids array<int>")
