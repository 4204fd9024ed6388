"""Language-model scores: the probability of a text over all its segmentations into vocabulary pieces.

The pieces and their order are those of a public subword vocabulary; no tokenizer is trained. The vocabulary's scores
rank its pieces; they become a unigram distribution by Zipf's law over the rank, which is then re-weighted by the
expected number of times that each piece occurs in the distinct training words, summed over all their segmentations.
A text is its words, each led by the space mark, and one end; since no piece runs over a space mark, the lattice of
a text is a chain of word lattices, and its marginal probability is the product of theirs. A word seen in training
has one more arc from end to end, which carries its count; the piece arcs share the weight of as many tokens as there
are distinct words. Words are scored once each, by a log-space forward recursion over all words of a length at a time.

Word counts, and the counts of the re-weighting, come from all training texts by Spark's aggregates. Frequent words
are looked up from a broadcast table of fixed size; all others by a join with the whole word table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import head_of, pick, stage

#: words whose scores are broadcast (the most frequent), weight of the vocabulary's own distribution
HEAD, PRIOR = 100_000, 1000.0
#: steps of re-weighting
STEPS = 2
#: characters of a word up to which words of a length are scored together; longer words are scored one by one, and so
#: many of their characters are looked up at once
LONGEST_WORD, BLOCK = 200, 50_000
#: a product of probabilities that is no greater is done by logarithms
LEAST_PRODUCT = 1e-200
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[str], "object"]:
    """Texts of the vocabulary's normal pieces, the end and 256 byte pieces, and log probabilities by Zipf's law."""
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    usual.sort(key=lambda i: (-model.get_score(i), i))
    texts = [model.id_to_piece(i) for i in usual]
    weights = np.concatenate((1.0 / (np.arange(len(texts)) + 10.0), [0.05], np.full(256, 1e-5)))
    return texts, np.log(weights / weights.sum())


class Lattice:
    """Forward and backward sums over the segmentations of words."""

    def __init__(self, texts: list[str], logp):
        import numpy as np

        self.logp = np.asarray(logp)
        self.end, self.bytes_at = len(texts), len(texts) + 1
        self.longest = max(map(len, texts))
        self.p = np.exp(self.logp)
        prefixes = [self._hashes(t) for t in texts]
        hashes = np.array([h[-1] for h in prefixes], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order
        self.maybe = np.zeros(1 << 20, dtype=bool)  # by the top bits of a hash: most substrings are no piece
        self.maybe[self.keys >> np.uint64(44)] = True
        self.open = np.zeros(1 << 20, dtype=bool)  # and most do not begin a longer one
        self.open[np.array([x for h in prefixes for x in h[:-1]], dtype=np.uint64) >> np.uint64(44)] = True
        self.single = {t for t in texts if len(t) == 1}

    @staticmethod
    def _hashes(text: str) -> list[int]:
        """Hashes of all prefixes, that of the whole text last."""
        h, out = 0xCBF29CE484222325, []
        for c in text:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
            out.append(h)
        return out

    def edges(self, chars):
        """``(i, j, rows, ids)``: the rows of a matrix of characters whose substring i..j is a piece."""
        import numpy as np

        n, m = chars.shape
        columns = np.ascontiguousarray(chars.T)
        for i in range(m):
            live, h = np.arange(n), np.full(n, 0xCBF29CE484222325, dtype=np.uint64)
            for j in range(i + 1, min(m, i + self.longest) + 1):
                h = (h ^ columns[j - 1][live]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                top = h >> np.uint64(44)
                rows = np.flatnonzero(self.maybe[top])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                found = self.keys[at] == h[rows]
                if found.any():
                    yield i, j, live[rows[found]], self.ids[at[found]]
                more = np.flatnonzero(self.open[top])
                if not len(more):
                    break
                live, h = live[more], h[more]

    def spelled(self, chars):
        """Log probability of each character by its bytes where the vocabulary lacks it, else minus infinity."""
        import numpy as np

        seen, at = np.unique(chars, return_inverse=True)
        by = np.full(len(seen), -np.inf)
        for k, c in enumerate(seen.tolist()):
            if chr(c) not in self.single:
                by[k] = sum(self.logp[self.bytes_at + b] for b in chr(c).encode("utf-8", "surrogatepass"))
        return by[at].reshape(chars.shape)

    def sums(self, chars, counts=None):
        """Log probability of each row; with ``counts`` also the expected number of each piece.

        Sums of products; rows whose probability comes near the end of a double's range are done again by logarithms.
        """
        import numpy as np

        n, m = chars.shape
        arcs = self.arcs(chars)
        weights = [np.exp(spelled) if ids is None else self.p[ids] for _, _, _, ids, spelled in arcs]
        ahead = np.zeros((m + 1, n))
        ahead[0] = 1
        for (i, j, rows, _, _), weight in zip(arcs, weights):
            ahead[j, rows] += ahead[i, rows] * weight
        total = np.log(np.maximum(ahead[m], LEAST_PRODUCT))
        low = np.flatnonzero(ahead[m] <= LEAST_PRODUCT)
        expected = None
        if counts is not None:
            ahead[m, low] = np.inf  # counted below
            behind = np.zeros((m + 1, n))
            behind[m] = counts / ahead[m]
            for (i, j, rows, _, _), weight in zip(reversed(arcs), reversed(weights)):
                behind[i, rows] += behind[j, rows] * weight
            shares = [ahead[i, rows] * weight * behind[j, rows] for (i, j, rows, _, _), weight in zip(arcs, weights)]
            expected = self.expected(chars, arcs, shares)
        if len(low):
            total[low], more = self.log_sums(chars[low], None if counts is None else counts[low])
            expected = None if counts is None else expected + more
        return total, expected

    def arcs(self, chars):
        """``(i, j, rows, ids, logs)`` by start: the rows that have an arc from i to j, its piece in each (none: spelled by
        bytes, with the log probabilities)."""
        import numpy as np

        spelled = self.spelled(chars)
        arcs = [(i, j, rows, ids, None) for i, j, rows, ids in self.edges(chars)]
        for i in range(chars.shape[1]):
            rows = np.flatnonzero(np.isfinite(spelled[:, i]))
            if len(rows):
                arcs.append((i, i + 1, rows, None, spelled[rows, i]))
        return sorted(arcs, key=lambda arc: arc[0])

    def expected(self, chars, arcs, shares):
        """Sums of the shares of arcs by piece."""
        import numpy as np

        pieces = [(ids, share) for (*_, ids, _), share in zip(arcs, shares) if ids is not None]
        if pieces:
            expected = np.bincount(np.concatenate([ids for ids, _ in pieces]), np.concatenate([share for _, share in pieces]), len(self.logp))
        else:
            expected = np.zeros(len(self.logp))
        for (i, _, rows, ids, _), share in zip(arcs, shares):
            if ids is None:
                for row, part in zip(rows, share):
                    for b in chr(int(chars[row, i])).encode("utf-8", "surrogatepass"):
                        expected[self.bytes_at + b] += part
        return expected

    def log_sums(self, chars, counts=None):
        """``sums`` by logarithms, for words of any probability."""
        import numpy as np

        n, m = chars.shape
        arcs = self.arcs(chars)
        weights = [logs if ids is None else self.logp[ids] for _, _, _, ids, logs in arcs]
        ahead = np.full((m + 1, n), -np.inf)
        ahead[0] = 0
        for (i, j, rows, _, _), weight in zip(arcs, weights):
            ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + weight)
        if counts is None:
            return ahead[m], None
        behind = np.full((m + 1, n), -np.inf)
        behind[m] = 0
        for (i, j, rows, _, _), weight in zip(reversed(arcs), reversed(weights)):
            behind[i, rows] = np.logaddexp(behind[i, rows], behind[j, rows] + weight)
        shares = [np.exp(ahead[i, rows] + weight + behind[j, rows] - ahead[m, rows]) * counts[rows] for (i, j, rows, _, _), weight in zip(arcs, weights)]
        return ahead[m], self.expected(chars, arcs, shares)

    def arcs_from(self, chars, lo: int, hi: int):
        """``starts, ends, ids, weights`` of the arcs of one word that start in lo..hi, by start; id -1 is a character
        spelled by its bytes."""
        import numpy as np

        h, found = np.full(hi - lo, 0xCBF29CE484222325, dtype=np.uint64), []
        for size in range(1, self.longest + 1):
            h = h[: len(chars) - size + 1 - lo]
            if not len(h):
                break
            h = (h ^ chars[lo + size - 1 : lo + size - 1 + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
            hit = self.keys[at] == h[rows]
            ids = self.ids[at[hit]]
            found.append((lo + rows[hit], lo + rows[hit] + size, ids, self.logp[ids]))
        spelled = self.spelled(chars[lo:hi])
        rows = np.flatnonzero(np.isfinite(spelled))
        found.append((lo + rows, lo + rows + 1, np.full(len(rows), -1), spelled[rows]))
        starts, ends, ids, weights = map(np.concatenate, zip(*found))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], ids[order], weights[order]

    def long_word(self, word: str, count=None):
        """Log probability of one word of any length, and with ``count`` the expected number of each piece: the recursions
        run over the whole word, the arcs of one block of characters at a time."""
        import numpy as np

        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        m, log1p, exp, never = len(chars), math.log1p, math.exp, -math.inf
        blocks = [(lo, min(m, lo + BLOCK)) for lo in range(0, m, BLOCK)]

        def plus(a, b):
            if a < b:
                a, b = b, a
            return a if b == never else a + log1p(exp(b - a))

        ahead = [0.0] + [never] * m
        for lo, hi in blocks:
            starts, ends, _, weights = self.arcs_from(chars, lo, hi)
            for i, j, w in zip(starts.tolist(), ends.tolist(), weights.tolist()):
                ahead[j] = plus(ahead[j], ahead[i] + w)
        if count is None or ahead[m] == never:
            return ahead[m], np.zeros(len(self.logp))
        behind, expected, before = [never] * m + [0.0], np.zeros(len(self.logp)), np.array(ahead)
        for lo, hi in reversed(blocks):
            starts, ends, ids, weights = self.arcs_from(chars, lo, hi)
            for i, j, w in zip(starts[::-1].tolist(), ends[::-1].tolist(), weights[::-1].tolist()):
                behind[i] = plus(behind[i], behind[j] + w)
            top = min(m, hi + self.longest)
            share = np.exp(before[starts] + weights + np.array(behind[lo : top + 1])[ends - lo] - ahead[m]) * count
            expected += np.bincount(ids[ids >= 0], share[ids >= 0], len(expected))
            for i, part in zip(starts[ids < 0].tolist(), share[ids < 0].tolist()):
                for b in word[i].encode("utf-8", "surrogatepass"):
                    expected[self.bytes_at + b] += part
        return ahead[m], expected

    def words(self, words: list[str], counts=None):
        """Log probability of each word, led by the space mark, and the expected pieces of all."""
        import numpy as np

        out, expected = np.zeros(len(words)), np.zeros(len(self.logp)) if counts is not None else None
        parts: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(words):
            w = MARK + w
            if len(w) <= LONGEST_WORD:
                parts.setdefault(len(w), []).append((k, w))
                continue
            out[k], exp = self.long_word(w, None if counts is None else counts[k])
            if counts is not None:
                expected += exp
        for m, some in parts.items():
            step = max(1, 400_000 // m)
            for lo in range(0, len(some), step):
                at = np.array([k for k, _ in some[lo : lo + step]])
                chars = np.frombuffer("".join(p for _, p in some[lo : lo + step]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, m).astype(np.uint64)
                total, exp = self.sums(chars, None if counts is None else counts[at])
                np.add.at(out, at, total)
                if exp is not None:
                    expected += exp
        return out, expected


def count_words(rows: DataFrame) -> DataFrame:
    """``word, c, seen``: how often each word occurs in training texts, and in all, for ``text, held_out``."""

    def count(frames):
        from collections import Counter

        import pandas as pd

        known, others = Counter(), Counter()  # of training texts, and of held out ones

        def out():
            words = [*known, *others.keys() - known.keys()]
            c = [known[w] for w in words]
            frame = pd.DataFrame({"word": words, "c": c, "seen": [n + others[w] for n, w in zip(c, words)]})
            known.clear()
            others.clear()
            return frame

        for frame in frames:
            for text, held in zip(frame["text"], frame["held_out"]):
                (others if held else known).update((text or "").encode("utf-8", "surrogatepass").lower().split())
            if len(known) + len(others) > 400_000:
                yield out()
        yield out()

    counted = rows.mapInPandas(count, "word binary, c long, seen long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def score_texts(docs: DataFrame, held_out: str = "held_out", vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose ``held_out`` is not true. A-Z is lower-cased, words end at ASCII white space, and each
    text has one end, which counts as a token; a null or empty text is the end alone. ``base_score`` is that of single
    words with additive smoothing, ``score`` that of the lattice, both log10. Without training rows the vocabulary's own
    distribution scores. Rows with equal or null ids are documents of their own.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    rows = pick(docs, doc_id=id_column, text=text, held_out=held_out).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    counts = stage(count_words(rows), "words", compression="zstd")
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    texts, logp = load_pieces(vocabulary)
    for _ in range(STEPS):
        used = expected_pieces(counts.where(F.col("c") > 0), texts, logp)
        logp = reweighted(logp, used | {len(texts): v / 100})
    fitted = spark.sparkContext.broadcast((texts, logp))  # the vocabulary: of fixed size
    spread = math.log10(max(v, 1)), math.log10(n + max(v, 1))  # tokens' weight of the piece arcs, and of all arcs

    def rate(frames):
        import numpy as np
        import pandas as pd

        lattice = Lattice(*fitted.value)
        for frame in frames:
            pieces = lattice.words([bytes(w).decode("utf-8", "surrogatepass") for w in frame["word"]])[0] / np.log(10) + spread[0]
            whole = np.log10(np.maximum(frame["c"].to_numpy(float), 1e-300))
            high = np.maximum(pieces, whole)
            lp = high + np.log10(np.power(10, pieces - high) + np.power(10, whole - high)) - spread[1]
            yield pd.DataFrame({"word": frame["word"], "c": frame["c"], "seen": frame["seen"], "lp": lp})

    words = stage(counts.mapInPandas(rate, "word binary, c long, seen long, lp double"), "scored", compression="zstd")
    head = head_of(words, "seen", "word", HEAD).select("word", "c", "lp").collect()
    scale = n + 0.1 * (v + 1)
    top = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["lp"]) for r in head})

    def partly(frames):
        """The frequent words of each text, and the others with their counts."""
        from collections import Counter
        from itertools import repeat

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        at = {w: i for i, w in enumerate(top.value)}
        # of each frequent word, and of none at the end
        seen_of = np.array([c > 0 for c, _ in top.value.values()] + [False])
        base_of = np.array([math.log10((c + 0.1) / scale) for c, _ in top.value.values()] + [0.0])
        lp_of = np.array([lp for _, lp in top.value.values()] + [0.0])
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            out = []
            for doc, text, held in zip(frame["doc_id"], frame["text"], frame["held_out"]):
                found = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
                places = np.fromiter(map(at.get, found, repeat(-1)), np.int64, len(found))
                k = np.fromiter(found.values(), np.int64, len(found))
                tokens, seen = 1 + int(k.sum()), int(k @ seen_of[places])
                base, lp = (k * base_of[places]).tolist(), (k * lp_of[places]).tolist()
                rest = [{"word": w, "k": n} for w, n in found.items() if w not in at]
                out.append((row, doc, held, tokens, seen, math.fsum(base), math.fsum(lp), rest))
                row += 1
            frame_out = pd.DataFrame(out, columns=["row", "doc_id", "held_out", "n_tokens", "seen", "base", "lp", "rest"])
            frame_out["doc_id"] = frame_out["doc_id"].astype(frame["doc_id"].dtype)
            yield frame_out

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInPandas(partly, f"row long, doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, lp double, rest array<struct<word:binary,k:long>>")
    parts = stage(parts, "texts", compression="zstd")
    rest = parts.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
    log = lambda c: F.log10((c + 0.1) / F.lit(float(scale)))
    tail = rest.join(words.select("word", "c", F.col("lp").alias("wlp")), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_seen"),
        F.sum(F.col("k") * log(F.col("c"))).alias("tail_base"),
        F.sum(F.col("k") * F.col("wlp")).alias("tail_lp"),
    )
    q_end = math.exp(logp[len(texts)]) / sum(math.exp(x) for x, t in zip(logp, [*texts, MARK]) if t.startswith(MARK))
    end_base, end_lp = math.log10((ends + 0.1) / scale), math.log10(ends + max(v, 1) * q_end) - spread[1]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("rest").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("seen") + zero("tail_seen") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base") + F.lit(end_base)).alias("base_score"),
        (F.col("lp") + zero("tail_lp") + F.lit(end_lp)).alias("score"),
    )


def expected_pieces(words: DataFrame, texts: list[str], logp) -> dict[int, float]:
    """Expected number of each piece in the distinct words, over all their segmentations; as many numbers as pieces."""
    shared = words.sparkSession.sparkContext.broadcast((texts, logp))  # the vocabulary: of fixed size

    def expect(frames):
        import numpy as np
        import pandas as pd

        lattice, sums = Lattice(*shared.value), 0
        for frame in frames:
            some = [bytes(w).decode("utf-8", "surrogatepass") for w in frame["word"]]
            sums = sums + lattice.words(some, np.ones(len(some)))[1]
        if np.ndim(sums):
            used = np.flatnonzero(sums > 0)
            yield pd.DataFrame({"piece": used, "n": sums[used]})

    rows = words.mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
    return {r["piece"]: r["n"] for r in rows}


def reweighted(logp, expected: dict[int, float]):
    """Log probabilities after one step of expectation maximisation from ``logp``, which keeps a weight of ``PRIOR`` tokens."""
    import numpy as np

    weights = PRIOR * np.exp(logp)
    for piece, n in expected.items():
        weights[piece] += n
    return np.log(weights / weights.sum())
