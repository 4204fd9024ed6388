"""Whitening against exact sums and a direct eigenvalue solver, and the counts and contours on difficult spectra."""

import pathlib
import random
import sys
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from gridloom.llm import whitening  # noqa: E402


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q * np.array(values, float) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 9, 40), "one": [5.0], "falling": 2.0 ** -np.arange(30), "two groups": [10.0] * 3 + [1.0] * 30,
    "equal": [4.0] * 25, "close": 100 + 1e-5 * np.arange(24), "rank three": [9.0, 5.0, 2.0] + [0.0] * 20, "wide": [1e12, 1e6, 30.0, 20.0, 10.0, 5.0],
    "many near the cut": list(1 + 1e-3 * np.arange(60)),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_of_a_spectrum(name):
    a = symmetric(SPECTRA[name])
    want = np.linalg.eigvalsh(a)[::-1]
    want = want[want > 1e-12 * want[0]][:8]
    values, vectors = whitening.largest_components(a, 8)
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-7)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-10 * want[0] * len(a)


def test_inertia():
    rng = np.random.default_rng(5)
    for order in [1, 2, 3, 7, 20]:
        for _ in range(30):
            a = rng.standard_normal((order, order))
            a = a + a.T - np.diag(np.diag(a)) * rng.integers(0, 3)  # with zeros on the diagonal too
            assert whitening.negative_pivots(a) == int((np.linalg.eigvalsh(a) < 0).sum())
            cut = float(rng.standard_normal())
            assert whitening.below(a, cut) == int((np.linalg.eigvalsh(a) < cut).sum())
    assert whitening.negative_pivots(np.zeros((3, 3))) == 0


def test_intervals_hold_what_they_count():
    a = symmetric(np.concatenate([np.linspace(1, 2, 50), [7.0] * 20, [9.0]]))
    spectrum = np.linalg.eigvalsh(a)
    parts = whitening.intervals(a, 30, 1e-9)
    assert sum(c for *_, c in parts) >= 30 and all(c == ((spectrum >= lo) & (spectrum < hi)).sum() for lo, hi, c in parts)
    assert all(before[0] >= after[1] for before, after in zip(parts, parts[1:]))


def test_a_wrong_count_is_an_error():
    with pytest.raises(ArithmeticError, match="eigenvalues lie in"):
        whitening.contour(symmetric(np.arange(1.0, 9.0)), 2.5, 4.5, 3, rounds=5)


def checked(rows, got, k=None):
    """Hold a result against exact sums and numpy; ``rows`` are the clean vectors by id."""
    n, d = len(rows), len(rows[0][1])
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(d)] for r in x])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, d) if k is None else k
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    want_deviation = {}
    for (i, _), r in zip(rows, x):
        want_deviation.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(r, sums)))
    whitened = {c: y @ vectors[:, c - 1] / np.sqrt(values[c - 1]) for c in range(1, k + 1)}
    for c in range(1, k + 1):
        mine = sorted((i, r.whitened) for i, per in by.items() for r in per[c])
        for sign in (1, -1):
            theirs = sorted((i, sign * w) for (i, _), w in zip(rows, whitened[c]))
            if np.allclose([m[1] for m in mine], [t[1] for t in theirs], atol=1e-6):
                break
        else:
            raise AssertionError(f"component {c}")
        for i, per in by.items():
            assert sorted(int(r.deviation) for r in per[c]) == sorted(want_deviation[i])
            assert all(r.n == n and abs(r.explained / (values[c - 1] / np.trace(v)) - 1) < 1e-6 and r.identity_error < 1e-6 for r in per[c])
    assert len({r.identity_error for r in got}) == 1


def test_whole_table(spark):
    from gridloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    checked(rows, QUERIES["op11_embedding_whitening"](spark, folder).collect())


def test_odd_rows(spark):
    rng = random.Random(9)
    sound = [(i, [rng.gauss(0, 1 + j) + 50 for j in range(5)]) for i in range(60)]
    sound += [sound[3], (3, sound[7][1]), ((1 << 60) + 1, sound[5][1])]
    odd = [(70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [float("nan")] * 5), (73, [float("inf")] * 5), (74, []), (75, [1.0, 2.0])]
    docs = spark.createDataFrame([(*r, "x", "y") for r in sound + odd], "vec_id long, embedding array<double>, c string, n string").repartition(4)
    checked(sound, whitening.whiten(docs).collect())
    with_null = docs.selectExpr("CASE WHEN vec_id < 5 THEN NULL ELSE vec_id END AS vec_id", "embedding")
    got = whitening.whiten(with_null).collect()
    assert len(got) == 5 * len(sound) and {r.vec_id for r in got if r.vec_id and r.vec_id > 100} == {(1 << 60) + 1}


@pytest.mark.parametrize("rows, k", [([], 0), ([[]] * 3, 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [1.0, 3.0], [1.0, 7.0]], 1), ([None, [float("nan")]], 0)])
def test_tables_with_few_components(spark, rows, k):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    if k:
        checked(list(enumerate(rows)), got, k)
    else:
        assert got == []


def test_numbers_beyond_a_long(spark):
    """Products that leave 64 bits are formed exactly; what a long cannot hold at all is cut off."""
    rows = [(0, [3.0e12, 1.0]), (1, [-2.0e12, 5.0]), (2, [1.0e12, -4.0]), (3, [7.0e11, 4.0])]
    checked(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), 1)  # the second value is rounding
    huge = whitening.whiten(spark.createDataFrame([(0, [1e300, 1.0]), (1, [0.0, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert huge and all(np.isfinite(r.whitened) for r in huge)
