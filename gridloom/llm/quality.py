"""Quality score: a generalised additive model with pairwise interactions over features of the text.

Per feature a lookup table over quantile bins is learned by cyclic boosting: round after round, one shallow tree per
feature is fitted to the gradient left by all others and added to that feature's table. Then the pairs of features
with the largest gain left get tables of their own, in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ITERATOR, pick

#: labelled rows used for fitting, at most (those of least hash, so a uniform choice)
FIT_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 48, 12, 120, 8, 40, 0.15

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "upper", "lower", "digit", "space", "newline", "comma_dot",
    "exclaim", "symbol", "bar", "other_ascii", "non_ascii", "entropy", "distinct_lines", "line_words", "words_by_stop",
    "top_word", "short_words", "long_words", "upper_words", "ends_symbol",
)


def text_features(text: str | None):
    """The features of a whole text, all finite; an empty or null text has zeros."""
    from collections import Counter

    import numpy as np

    b = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not b:
        return out
    n = len(b)
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words = b.split()
    w = max(1, len(words))
    lines = b.split(b"\n")
    known = Counter(words)
    total = lambda chars: int(count[list(chars)].sum())
    share = count[count > 0] / n
    upper, lower, digit = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    space, stops, symbols = total(b" \t\r\x0b\x0c"), total(b".!?"), total(b"#$%&*@^~+=<>{}[]\\/_")
    listed = upper + lower + digit + space + int(count[10]) + total(b",.;:") + int(count[33]) + symbols + int(count[124])
    sizes = np.array([len(x) for x in known])
    times = np.array(list(known.values()))
    out[:] = (
        np.log1p(n), np.log1p(len(words)), (sizes * times).sum() / w if len(known) else 0, len(known) / w, upper / n, lower / n, digit / n,
        space / n, count[10] / n, total(b",.;:") / n, count[33] / n, symbols / n, count[124] / n, max(0, int(count[:128].sum()) - listed) / n,
        count[128:].sum() / n, -(share * np.log2(share)).sum(), len(set(lines)) / len(lines), len(words) / len(lines), len(words) / (stops + 1),
        max(times, default=0) / w, times[sizes <= 2].sum() / w if len(known) else 0, times[sizes >= 12].sum() / w if len(known) else 0,
        sum(t for x, t in known.items() if x.isupper()) / w, sum(t for x, t in known.items() if x[-1] in b"#$%&*!|") / w,
    )
    return out


def _leaves(g, h, parts: int, least: float):
    """Cut points of a tree over ordered bins with at most ``parts`` leaves, by gain."""
    import numpy as np

    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(cuts) <= parts:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            m = np.arange(a + 1, b)
            m = m[(ch[m] - ch[a] >= least) & (ch[b] - ch[m] >= least)]
            if len(m):
                gain = value(a, m) + value(m, b) - value(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return step


def fit(x, y) -> dict:
    """The model of a feature matrix and 0/1 labels. Without rows, or of one class only, it scores the smoothed mean."""
    import numpy as np

    y = np.asarray(y, dtype=float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for f in range(len(FEATURES))]
    mean = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(mean / (1 - mean))), "edges": edges, "tables": [np.zeros(len(e) + 1) for e in edges], "pairs": []}
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    score = np.full(len(y), model["base"])

    def residual():
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            r, h = residual()
            m = len(model["tables"][f])
            step = RATE * _leaves(np.bincount(b, r, m), np.bincount(b, h, m), 4, 2.0)
            model["tables"][f] += step
            score += step[b]
    coarse = [np.minimum(b * COARSE // max(1, len(e) + 1), COARSE - 1) for b, e in zip(bins, edges)]
    r, h = residual()
    gains = []
    for f in range(len(bins)):
        for k in range(f + 1, len(bins)):
            at = coarse[f] * COARSE + coarse[k]
            gains.append(((np.bincount(at, r, COARSE**2) ** 2 / (np.bincount(at, h, COARSE**2) + 1)).sum(), f, k))
    tables = {(f, k): np.zeros((COARSE, COARSE)) for _, f, k in sorted(gains, reverse=True)[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (f, k), table in tables.items():
            r, h = residual()
            at = coarse[f] * COARSE + coarse[k]
            g2, h2 = np.bincount(at, r, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, h, COARSE**2).reshape(COARSE, COARSE)
            top = _leaves(g2.sum(axis=1), h2.sum(axis=1), 2, 2.0)  # two sides of one feature, then each by the other
            step = np.zeros_like(table)
            for side in np.unique(top):
                on = top == side
                step[on] = RATE * _leaves(g2[on].sum(axis=0), h2[on].sum(axis=0), 2, 2.0)
            table += step
            score += step.ravel()[at]
    model["pairs"] = [(f, k, table) for (f, k), table in tables.items()]
    return model


def score_rows(model: dict, x):
    """Probabilities of label 1: bin every feature, add the table entries."""
    import numpy as np

    total = np.full(len(x), model["base"])
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model["edges"])]
    for b, table in zip(bins, model["tables"]):
        total += table[b]
    coarse = [np.minimum(b * COARSE // max(1, len(e) + 1), COARSE - 1) for b, e in zip(bins, model["edges"])]
    for f, k, table in model["pairs"]:
        total += table[coarse[f], coarse[k]]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents; the features are computed by Spark, the fit runs on this bounded sample.

    Rows with a null id or label teach nothing; a document with several labels counts once for each.
    """
    import numpy as np

    known = pick(labels, id=id_column, y=label).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    some = known.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = pick(docs, id=id_column, text=text).join(F.broadcast(some), "id").select("text", F.col("y").cast("double").alias("y"))

    def features(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"x": [text_features(t) for t in frame["text"]], "y": frame["y"]})

    got = texts.mapInPandas(features, "x array<double>, y double").collect()
    got.sort(key=lambda r: (r["x"], r["y"]))  # so that the fit does not depend on the order of arrival
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), [r["y"] for r in got])


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every text, null and empty ones too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def rate(batches):
        import numpy as np
        import pandas as pd

        for texts in batches:
            x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(score_rows(shared.value, x))

    return docs.withColumn(out, F.pandas_udf(rate, "double", functionType=ITERATOR)(docs[f"`{text}`"]))
