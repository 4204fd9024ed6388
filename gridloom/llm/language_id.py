"""Language identification: known words first, then ever shorter character n-grams.

Counts come from every training text: words by language, and from the table of distinct words the n-grams of each
length. All of them are kept in staged tables. A known word scores its log frequency in each language; an unknown word
falls back to its n-grams of the longest length of which it has known ones.

The entries that are frequent in some language are broadcast as a cache of fixed size. The other words of a text, and the
other n-grams of words that are unknown, are looked up by joins with the whole tables, each distinct word once; so the
size of the cache does not change a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, head_of, pick, release_workers, stage, unstage

#: entries of the cache: words, and n-grams of each length
WORDS, GRAMS, ORDERS = 60_000, 20_000, (5, 4, 3, 2, 1)
UNDETERMINED = "und"
#: words that a task counts at a time
ENTRIES = 120_000
#: words outside the cache that a task holds before it hands them on
HELD = 100_000
#: characters of a word that are cut into n-grams at once
PIECE = 64
#: shares of the texts whose words outside the cache are looked up one after another: the shuffles of one are on disk at a time
SHARES = 4


def word_counts(train: DataFrame) -> DataFrame:
    """``word, lang, n`` over all texts of ``text, lang``; a task counts before it sends anything."""

    def count(frames):
        from collections import Counter, defaultdict

        import pandas as pd

        release_workers()
        counts: dict[str, Counter] = defaultdict(Counter)

        def rows(least: int = 0):
            """Entries of at most ``least`` occurrences leave, or all; frequent ones stay and go on counting."""
            out = {"word": [], "lang": [], "n": []}
            for lang, c in counts.items():
                leaving = {w: n for w, n in c.items() if n <= least} if least else c
                out["word"] += leaving
                out["lang"] += [lang] * len(leaving)
                out["n"] += leaving.values()
                counts[lang] = Counter({w: n for w, n in c.items() if n > least} if least else {})
            return pd.DataFrame(out)

        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                counts[lang].update(text.lower().split())
                if sum(map(len, counts.values())) > ENTRIES:
                    yield rows(3)
                    if sum(map(len, counts.values())) > ENTRIES // 2:
                        yield rows()
        yield rows()

    return train.mapInPandas(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def with_logs(entries: DataFrame, totals: dict[str, int]) -> DataFrame:
    """``entry, peak, logs`` of ``entry, lang, n``: log10 frequencies by language, each smoothed towards the entry's
    frequency in all of them, and the largest share of a language that the entry is."""
    whole = float(sum(totals.values()))
    langs = sorted(totals)
    by = entries.groupBy("entry").agg(F.sum("n").alias("all"), F.array(*[F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)) for g in langs]).alias("by"))
    of = lambda i: F.get("by", F.lit(i))
    logs = [F.log10((of(i) + 0.5 * F.col("all") / whole) / (totals[g] + 0.5)) for i, g in enumerate(langs)]
    return by.select("entry", F.array_max(F.array(*[of(i) / (totals[g] + 0.5) for i, g in enumerate(langs)])).alias("peak"), F.array(*logs).alias("logs"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> dict:
    """A model: languages, staged tables of all words and n-grams with their log frequencies by language, and a cache.

    ``words`` and ``grams`` bound the cache alone, which holds what is most frequent in any one language, so that a
    language with few texts has its share. Rows with a null text or language teach nothing; without any row the model
    knows no language.
    """
    rows = pick(docs, text=text, lang=lang).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = stage(word_counts(rows), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model = {"langs": sorted(totals), "cache": []}
    if not totals:
        return model
    # all grams at a place are prefixes of the longest one there; chr(0) fills up behind the word
    longest = max(ORDERS)
    # a word is read in pieces, each with the first characters of the next: no place is looked for from the beginning of a long word
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    pieces = F.regexp_extract_all(padded, F.lit("(?s).{1,%d}+" % PIECE), F.lit(0))
    behind = lambda ps, i: F.rpad(F.substring(F.coalesce(F.get(ps, i + 1), F.lit("")), 1, longest - 1), longest - 1, "\0")
    several = F.flatten(F.transform(F.array(pieces), lambda ps: F.transform(ps, lambda p, i: F.concat(p, behind(ps, i)))))
    filled = F.when(F.length("word") <= PIECE - 2, F.array(F.concat(padded, F.lit("\0" * (longest - 1))))).otherwise(several)
    cut = counts.select(F.explode(filled).alias("filled"), "lang", "n")
    cut = cut.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("filled") - (longest - 1))))
    at_place = cut.select(F.col("filled").substr(F.col("place"), F.lit(longest)).alias("entry"), "lang", "n")
    at_place = stage(at_place.groupBy("entry", "lang").agg(F.sum("n").alias("n")), "grams")
    starts = F.filter(F.array(*[F.substring("entry", 1, order) for order in ORDERS]), lambda g: ~g.contains("\0"))
    model["words"] = stage(with_logs(counts.withColumnRenamed("word", "entry"), totals), "word-logs", compression="zstd")
    model["grams"] = stage(with_logs(at_place.select(F.explode(starts).alias("entry"), "lang", "n"), totals), "gram-logs", compression="zstd")
    tables = {order: {} for order in (0, *ORDERS)}
    for r in head_of(model["words"], "peak", "entry", words).select("entry", "logs").collect():
        tables[0][r["entry"]] = r["logs"]
    by_order = model["grams"].withColumn("order", F.length("entry"))
    for r in head_of(by_order, "peak", "entry", grams, "order").select("order", "entry", "logs").collect():
        tables[r["order"]][r["entry"]] = r["logs"]
    model["cache"] = list(tables.items())
    unstage(counts, at_place)
    return model


def forget(model: dict) -> None:
    """Delete the staged tables of a model that predicts nothing more; what it has predicted does not read them."""
    unstage(*[model[name] for name in ("words", "grams") if name in model])


def sums(k: str, logs: str, n: int) -> Column:
    """Element-wise sum of ``k`` times an array of length ``n``."""
    return F.array(*[F.sum(F.col(k) * F.get(logs, F.lit(i))) for i in range(n)])


def spell(unknown: DataFrame, model: dict) -> tuple[DataFrame, DataFrame]:
    """``entry, logs`` of words that the model does not know: the mean over their known n-grams of the longest length of
    which they have any. A word without any has no row. Also the staged table that this reads."""
    n = len(model["langs"])
    shared = unknown.sparkSession.sparkContext.broadcast(model["cache"][1:])  # of fixed size

    def cached(frames):
        """The sums over n-grams in the cache, and the others, down to the longest length of which some are in it."""
        from collections import Counter

        import pandas as pd
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            out = []
            for w in frame["entry"]:
                padded = f" {w} "
                for order, table in shared.value:
                    hits, total, others = 0, [0.0] * n, Counter()
                    for g, k in Counter(padded[i : i + order] for i in range(len(padded) - order + 1)).items():
                        logs = table.get(g)
                        if logs is None:
                            others[g] = k
                        else:
                            hits += k
                            total = [a + k * b for a, b in zip(total, logs)]
                    out.append((row, w, order, hits, total, list(others), list(others.values())))
                    if hits:
                        break
                row += 1
            yield pd.DataFrame(out, columns=["row", "entry", "order", "hits", "total", "grams", "k"])

    tries = stage(unknown.mapInPandas(cached, "row long, entry string, order int, hits long, total array<double>, grams array<string>, k array<long>"), "tries", compression="zstd")
    others = tries.select("row", "order", F.explode(F.arrays_zip("grams", "k")).alias("g")).select("row", "order", F.col("g.grams").alias("gram"), "g.k")
    found = others.join(model["grams"].select(F.col("entry").alias("gram"), "logs"), "gram")
    found = found.groupBy("row", "order").agg(F.sum("k").alias("more"), sums("k", "logs", n).alias("add"))
    every = tries.select("row", "order", "hits", "total").join(found, ["row", "order"], "left").select(
        "row", "order", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"),
        F.when(F.col("add").isNull(), F.col("total")).otherwise(F.zip_with("total", "add", lambda a, b: a + b)).alias("total"),
    ).where(F.col("hits") > 0)
    best = every.groupBy("row").agg(F.max(F.struct("order", "hits", "total")).alias("top"))
    named = tries.where(F.col("order") == max(ORDERS)).select("row", "entry").join(best, "row")
    return named.select("entry", F.transform("top.total", lambda x: x / F.col("top.hits")).alias("logs")), tries


def predict(docs: DataFrame, model: dict, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language of each text and its share of the posterior (0 to 1). A text without a letter, or a
    null one, is ``und`` with score 0; so is every text when the model knows no language. Ties go to the first in
    alphabetical order. Columns of the same names are replaced."""
    langs = model["langs"]
    n = len(langs)
    if not langs:
        return docs.withColumns({lang_out: F.lit(UNDETERMINED), score_out: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model["cache"][0][1])  # of fixed size
    key = F.unhex(F.md5(F.coalesce(docs[f"`{text}`"], F.lit(""))))  # equal texts have equal labels
    guess, name = free_name(docs, "_guess"), free_name(docs, "_text_key")

    def cached(frames):
        """The sums over words in the cache, and the others; texts without a letter are left out."""
        from collections import Counter
        from itertools import compress, repeat

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        at = {w: i for i, w in enumerate(shared.value)}
        logs = np.array(list(shared.value.values())).reshape(-1, n)
        row = TaskContext.get().partitionId() << 33
        names = ["row", "key", "total", "words", "k"]
        for frame in frames:
            out, held = [], 0
            for name, t in zip(frame["key"], frame["text"]):
                if not any(map(str.isalpha, t)):
                    continue
                words = Counter(t.lower().split())
                places = np.fromiter(map(at.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
                here = places >= 0
                others = list(compress(words, (~here).tolist()))
                out.append((row, name, times[here].astype(float) @ logs[places[here]], others, times[~here]))
                row += 1
                held += len(others)
                if held > HELD:  # the other words of a whole batch would be many strings at once
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    texts = docs.select(key.alias("key"), docs[f"`{text}`"].alias("text")).where(F.col("text").isNotNull())
    parts = stage(texts.mapInPandas(cached, "row long, key binary, total array<double>, words array<string>, k array<long>"), "texts", compression="zstd")
    others = parts.select("row", F.explode(F.arrays_zip("words", "k")).alias("w")).select("row", F.col("w.words").alias("entry"), "w.k")
    # one join with all words rates those that the model knows; only the unknown ones stay apart, to be spelled
    tails, known = [], model["words"].select("entry", "logs").hint("shuffle_hash")  # a word has one row: no key is hot, nothing to sort
    for i in range(SHARES):
        met = others.where(F.pmod("row", F.lit(SHARES)) == i).join(known, "entry", "left")
        unknown = F.when(F.col("logs").isNull(), F.col("entry")).alias("unknown")
        tails.append(stage(met.groupBy("row", unknown).agg(F.sum("k").alias("k"), sums("k", "logs", n).alias("add")), "tails", compression="zstd"))
    rest = reduce(DataFrame.unionByName, tails)
    unknown = rest.where(F.col("unknown").isNotNull()).select("row", F.col("unknown").alias("entry"), "k")
    spelled, tries = spell(unknown.select("entry").distinct(), model)
    rated = stage(spelled, "rated", compression="zstd")
    unstage(tries)
    adds = rest.where(F.col("unknown").isNull()).select("row", F.lit(1).alias("k"), F.col("add").alias("logs")).unionByName(unknown.join(rated, "entry").select("row", "k", "logs"))
    adds = adds.groupBy("row").agg(sums("k", "logs", n).alias("add"))
    total = F.when(F.col("add").isNull(), F.col("total")).otherwise(F.zip_with("total", "add", lambda a, b: a + b))
    made = stage(parts.select("row", "key", "total").join(adds, "row", "left").select("key", total.alias("total")), "totals")
    unstage(parts, rated, *tails)
    sure = made.withColumn("top", F.array_max("total"))
    share = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), F.greatest(x - F.col("top"), F.lit(-300.0))))
    label = F.get(F.array(*map(F.lit, langs)), (F.array_position("total", F.col("top")) - 1).cast("int"))
    labels = sure.groupBy("key").agg(F.min(F.struct(label.alias("lang"), (1 / share).alias("share"))).alias(guess)).withColumnRenamed("key", name)
    marked = docs.withColumn(name, key).join(labels, name, "left")
    named = {lang_out: F.coalesce(F.col(guess)["lang"], F.lit(UNDETERMINED)), score_out: F.coalesce(F.col(guess)["share"], F.lit(0.0))}
    return marked.withColumns(named).drop(guess, name)
