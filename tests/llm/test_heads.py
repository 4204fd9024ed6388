"""The most frequent rows are chosen without sending rows of every partition to the driver; lattice sums by products."""

import pathlib
import sys

import numpy as np

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import language_id, lattice_lm  # noqa: E402
from gridloom.llm.common import head_of  # noqa: E402


def test_head_of_takes_the_greatest(spark):
    """Close to the wanted number, of each kind, whatever ties; nothing left out is a step above what is taken."""
    ranks = {"few": range(1, 4), "ties": [1] * 3000 + [2] * 40, "even": range(1, 4000)}
    rows = [(kind, f"{kind}-{i}", r) for kind, some in ranks.items() for i, r in enumerate(some)] + [("none", "x", 5), (None, "y", 5)]
    df = spark.createDataFrame(rows, "kind string, name string, n long").repartition(7)
    got = {}
    for r in head_of(df.where("kind is not null"), "n", "name", 1000, "kind").collect():
        got.setdefault(r.kind, []).append(r.n)
    assert sorted(got["few"]) == [1, 2, 3] and got["none"] == [5]
    assert got["ties"].count(2) == 40 and 600 <= len(got["ties"]) <= 1000
    assert 850 <= len(got["even"]) <= 1000 and min(got["even"]) >= 2900
    assert head_of(df, "n", "name", 10**6).count() == len(rows) and head_of(df.where("false"), "n", "name", 5).count() == 0


def test_driver_gets_no_rows_of_every_partition(spark, monkeypatch):
    """``orderBy().limit().collect()`` merges up to the limit of each partition on the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    few = DataFrame.limit

    def refused(self, n):
        assert n == 1, "the driver would merge rows of all partitions"
        return few(self, n)

    monkeypatch.setattr(DataFrame, "limit", refused)
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(docs, words=20, grams=20)
    assert [order for order, _ in model["cache"]] == [0, *language_id.ORDERS] and all(len(t) <= 20 for _, t in model["cache"])
    language_id.forget(model)
    assert lattice_lm.score_texts(docs.withColumn("held_out", F.lit(False))).count() == 40


def test_lattice_products_equal_logarithms():
    texts = [lattice_lm.MARK, "a", "b", "ab", "abba", lattice_lm.MARK + "a", "ba"]
    weights = np.array([4, 3, 2, 2, 1, 1, 1, 1.0] + [1e-9] * 256)
    lattice = lattice_lm.Lattice(texts, np.log(weights / weights.sum()))
    rng = np.random.default_rng(3)
    # those of the longest length lie far below a double's range
    for m, letters in ((1, "ab"), (6, "abc"), (40, "abcé"), (180, "é鿿b")):
        chars = rng.choice([ord(c) for c in letters], (9, m)).astype(np.uint64)
        counts = rng.integers(1, 5, 9)
        got, want = lattice.sums(chars, counts), lattice.log_sums(chars, counts)
        assert np.allclose(got[0], want[0], rtol=1e-11) and np.allclose(got[1], want[1], rtol=1e-9, atol=1e-9)
        assert np.allclose(lattice.sums(chars)[0], want[0], rtol=1e-11) and (m < 180 or want[0].max() < -800)
