"""Transforms, reductions, histograms, scans, searches and sorts against plain restatements."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from gridloom.operators import compare, histogram, reduce, scan, search, sort, transform
from gridloom.operators.index import group_min, ordinal, rank_rows, running
from gridloom.runtime import salted_join

PARTS = [1, 3, 17]


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_relu(vec):
    assert column(transform.relu(vec([-1.8, 24.0, 1.2, float("nan"), 0.0])), "x") == [0.0, 24.0, 1.2, 0.0, 0.0]


def test_negate_odds(vec):
    assert column(transform.negate_odds(vec([16, 11, 12, 14, 1, 0, 5, -7, -8])), "x") == [8, -11, 6, 7, -1, 0, -5, 7, -4]


def test_inverse_offset(vec):
    got = column(transform.inverse_offset(vec([2.0, 4.0, 1.0, 12.0, -2.0, 0.0])), "x")
    assert got[:5] == pytest.approx([0.5, 0.75, 0, 11 / 12, 1.5]) and got[5] == -math.inf


def test_squares_do_not_overflow(vec):
    df = vec([5, 1, 2, -4, 2**31 - 1]).withColumn("x", F.col("x").cast("int"))
    assert column(transform.squares(df), "x") == [25, 1, 4, 16, (2**31 - 1) ** 2]


def test_power_of_two_mask(vec):
    assert column(transform.power_of_two_mask(vec([8, 0, 9, 7, 15, 64, 3, -4, 1])), "mask") == [
        True, False, False, False, False, True, False, False, True]


def test_axpy(vec):
    z = transform.axpy(vec([1.0, -5.0, 2.0, 9.0]), vec([0.0, 4.0, 1.0, -1.0]), 2.0)
    assert column(z, "z") == [2.0, -6.0, 5.0, 17.0]


@pytest.mark.parametrize("parts", PARTS)
def test_reductions(vec, rng, parts):
    bits = rng.random(1024) < 0.5
    assert one(reduce.logical_xor(vec(bits, parts))) == bool(bits.sum() % 2)
    x = rng.uniform(1, 100, 100)
    expected = np.prod(np.where(np.arange(100) % 2 == 1, 1 / x, x))
    assert one(reduce.product_of_inverses(vec(x, parts))) == pytest.approx(expected)
    assert one(reduce.log_magnitude_of_product(vec(x, parts))) == pytest.approx(math.log(expected))
    assert one(reduce.average(vec(x, parts))) == pytest.approx(x.mean())
    ints = rng.integers(-100, 100, 1000)
    assert one(reduce.smallest_odd(vec(ints, parts))) == min(v for v in ints if v > 0 and v % 2 == 1)
    assert one(reduce.smallest_odd(vec([2, -3, 4], parts))) == 2147483647
    y = rng.uniform(0, 100, 100)
    assert one(reduce.sum_of_pair_minima(vec(x, parts), vec(y, parts))) == pytest.approx(np.minimum(x, y).sum())


def test_reduction_worked_examples(vec):
    assert one(reduce.logical_xor(vec([False, False, False, True]))) is True
    assert one(reduce.product_of_inverses(vec([4.0, 2.0, 10.0, 4.0, 5.0]))) == pytest.approx(25)
    assert one(reduce.average(vec([1.0, 8.0, 4.0, 5.0, 1.0]))) == pytest.approx(3.8)
    assert one(reduce.smallest_odd(vec([7, 9, 5, 2, 8, 16, 4, 1]))) == 1
    assert one(reduce.sum_of_pair_minima(vec([3, 4, 0, 2, 3]), vec([2, 5, 3, 1, 7]))) == 10
    assert one(reduce.all_equal(vec([3, 3, 3]))) and not one(reduce.all_equal(vec([3, 4])))
    empty = vec([1.0]).where("i < 0")
    assert one(reduce.average(empty)) is None and one(reduce.mean_or_zero(empty)) == 0.0
    assert one(reduce.fold(empty, F.max("x"), -1.0)) == -1.0
    stats = reduce.describe(vec([1, 2, 3, 10]), "x").first()
    assert (stats["mean"], stats["min"], stats["max"], stats["median"], stats["total"]) == (4.0, 1, 10, 2.5, 16)
    assert stats["std"] == pytest.approx(np.std([1, 2, 3, 10]))


def bins(df):
    return [r["n"] for r in df.orderBy("bin").collect()]


def test_histograms(vec, spark, rng):
    pixels = np.append(rng.integers(0, 255, 1000), [255])
    assert bins(histogram.pixel_counts(vec(pixels), "x")) == np.bincount(pixels, minlength=256).tolist()
    assert bins(histogram.decade_counts(vec([7.0, 32.0, 95.0, 12.0, 39.0, 32.0, 11.0, 71.0, 70.0, 66.0, 100.0]))) == [
        1, 2, 0, 3, 0, 0, 1, 2, 0, 2]
    points = vec([1.5, 3.0, -1.5, -2.0, 0.0], y=[2.5, 0.0, 0.0, -1.0, -2.0])
    assert bins(histogram.quadrant_counts(points)) == [2, 1, 1, 1]
    words = spark.createDataFrame([("dog",), ("cat",), ("xray",), ("cow",), ("code",), ("type",), ("Flower",), ("",)], "s string")
    counts = bins(histogram.first_letter_counts(words))
    assert (counts[2], counts[3], counts[19], counts[23], sum(counts)) == (3, 1, 1, 1, 6)
    assert bins(histogram.fraction_quarter_counts(vec([7.8, 4.2, 9.1, 7.6, 0.27, 1.5, 3.8, -0.9]))) == [3, 1, 2, 2]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("bits", [2, 5, 16])
def test_scans(vec, rng, parts, bits):
    x = rng.integers(-100, 100, 700)
    df = vec(x, parts)
    assert column(scan.prefix_sum(df, bits=bits), "scan") == np.cumsum(x).tolist()
    assert column(scan.partial_minimums(df, bits=bits), "scan") == np.minimum.accumulate(x).tolist()
    assert column(scan.partial_maximums(df, bits=bits), "scan") == np.maximum.accumulate(x).tolist()
    assert column(scan.reverse_prefix_sum(df, bits=bits), "scan") == np.cumsum(x[::-1]).tolist()
    assert one(scan.sum_of_prefix_sums(df)) == np.cumsum(x).sum()
    best = current = x[0]
    for v in x[1:]:
        current = max(v, current + v)
        best = max(best, current)
    assert one(scan.maximum_subarray(df, bits=bits)) == best
    before = column(running(df, "i", "x", exclusive=True, bits=bits), "scan")
    assert before[0] is None and before[1:] == np.cumsum(x)[:-1].tolist()


def test_scan_worked_examples(vec):
    assert column(scan.prefix_sum(vec([1, 7, 4, 6, 6, 2])), "scan") == [1, 8, 12, 18, 24, 26]
    assert column(scan.partial_minimums(vec([8, 6, -1, 7, 3, 4, 4])), "scan") == [8, 6, -1, -1, -1, -1, -1]
    assert one(scan.sum_of_prefix_sums(vec([-7, 2, 1, 9, 4, 8]))) == 15
    assert column(scan.reverse_prefix_sum(vec([1, 7, 4, 6, 6, 2])), "scan") == [2, 8, 14, 18, 25, 26]
    assert one(scan.maximum_subarray(vec([-2, 1, -3, 4, -1, 2, 1, -5, 4]))) == 6
    assert one(scan.maximum_subarray(vec([-5, -3, -9]))) == -3


def test_scan_by_key(vec, rng):
    x, key = rng.integers(-9, 9, 400), np.where(rng.random(400) < 0.6, "hot", "cold")
    got = running(vec(x, key=key), "i", "x", keys=["key"], bits=3).toPandas().sort_values("i")
    assert (got["scan"] == pd.Series(x).groupby(key).cumsum()[got["i"].to_numpy()].to_numpy()).all()
    places = ordinal(vec(x, key=key), "i", keys=["key"]).toPandas().sort_values("i")
    assert (places["pos"].to_numpy() == pd.Series(x).groupby(key).cumcount().to_numpy()).all()


def test_searches(vec, rng):
    assert one(search.last_position_where(vec([101, 95, 50, 400]), F.col("x") < 100)) == 2
    books = vec([0, 0, 0]).withColumn("pages", F.lit(300) + F.col("i"))
    assert one(search.last_short_book(books)) == 3
    assert one(search.first_even(vec([7, 3, -4, 8]))) == 2 and one(search.first_even(vec([7, 3]))) == 2
    assert one(search.contains(vec([1, 8, 2, 6, 4, 6]), 3)) is False and one(search.contains(vec([1, 8, 2]), 8)) is True
    assert one(search.closest_to(vec([9.18, 3.05, 7.24, 11.3, -166.49, 2.1]))) == 1
    assert one(search.closest_to(vec([3.0, 3.0, 9.0]))) == 0
    x, y = vec([1, 8, 4, 3, 4, 2]), vec([3, 4, 4, 1, 1, 7])
    assert one(search.in_exactly_one(x, y, 7)) is True and one(search.in_exactly_one(x, y, 1)) is False
    assert sorted(r[0] for r in search.symmetric_difference(x, y).collect()) == [2, 7, 8]


@pytest.mark.parametrize("parts", PARTS)
def test_sorts(vec, rng, parts):
    x = rng.integers(-50, 50, 1000)
    df = vec(x, parts)
    order = np.lexsort((np.arange(1000), x))
    rank = np.empty(1000, dtype=int)
    rank[order] = np.arange(1000)
    assert column(sort.ranks(df), "rank") == rank.tolist()
    for k in (1, 2, 500, 999, 1000):
        assert one(sort.kth_smallest(df, k)) == np.sort(x)[k - 1]
        assert one(sort.kth_smallest(df, k, bits=32)) == np.sort(x)[k - 1]
    big = rng.integers(-(2**62), 2**62, 500)
    assert one(sort.kth_smallest(vec(big, parts), 77)) == np.sort(big)[76]
    sparse = np.where(rng.random(1000) < 0.8, 0, x)
    expected = sparse.copy()
    expected[sparse != 0] = np.sort(sparse[sparse != 0])
    assert column(sort.sort_ignoring_zeros(vec(sparse, parts)), "x") == expected.tolist()


def test_sort_examples(vec):
    z = vec([0, 0, 0], re=[3.0, 1.0, -1.0], im=[-1.0, 0.0, 0.5]).drop("x")
    assert [(r.re, r.im) for r in sort.sort_complex_by_magnitude(z).orderBy("pos").collect()] == [(1.0, 0.0), (-1.0, 0.5), (3.0, -1.0)]
    records = vec([0, 0, 0], startTime=[8, 2, 8], duration=[4, 10, 7], value=[-1.22, 1.0, 0.5])
    assert [(r.startTime, r.duration) for r in sort.sort_records(records).orderBy("pos").collect()] == [(2, 10), (8, 4), (8, 7)]
    with pytest.raises(ValueError):
        sort.kth_smallest(vec([1, 2]), 0)
    with pytest.raises(Exception, match="larger than"):
        sort.kth_smallest(vec([1, 2]), 3).collect()
    assert one(sort.kth_smallest(vec([1, 7, 6, 0, 2, 2, 10, 6]), 4)) == 2


def test_rank_with_a_hot_key(vec, rng):
    """One key with most rows is spread over partitions and still ranked as a whole."""
    key = np.where(rng.random(2000) < 0.7, "hot", rng.choice(list("abcdef"), 2000))
    x = np.where(rng.random(2000) < 0.5, 1.0, rng.uniform(0, 9, 2000))
    got = rank_rows(vec(x, 5, key=key), ["x", "i"], keys=["key"], partitions=9).toPandas().sort_values(["key", "x", "i"])
    assert len(got) == 2000 and (got.groupby("key").cumcount() == got["pos"]).all()


def test_salted_join_splits_hot_keys_without_changing_results(spark, rng):
    left = spark.createDataFrame(pd.DataFrame({"k": np.where(rng.random(900) < 0.5, 0, rng.integers(0, 40, 900)), "v": range(900)}))
    right = spark.range(30).selectExpr("id as k", "id * 10 as w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = salted_join(left, right, ["k"], ["v"], how, hot_rows=20, share=50)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(plain.columns).collect()))


def test_group_min(vec):
    got = group_min(vec([3, 1, 2, 9], g=["a", "a", "b", "b"]), ["g"], "x", "low")
    assert sorted((r.x, r.low) for r in got.collect()) == [(1, 1), (2, 2), (3, 1), (9, 2)]


def test_compare(spark, vec):
    a, b = vec([1.0, 2.0]), vec([1.0, 2.0 + 1e-7])
    assert one(compare.close_to(a, b, ["i"], "x")) and not one(compare.close_to(a, b, ["i"], "x", 1e-9))
    assert not one(compare.close_to(a, vec([1.0, float("nan")]), ["i"], "x"))
    assert not one(compare.close_to(a, vec([1.0, 2.0, 3.0]), ["i"], "x"))
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "row long, col long, value double")
    assert one(compare.coo_equal(m, m.orderBy("row", ascending=False)))
    p = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert one(compare.point_sets_equal(p, p.orderBy("x", ascending=False)))
    assert not one(compare.point_sets_equal(p, p.limit(1)))


@pytest.mark.parametrize("values", [[3.5], [2.0, -1.0], [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, 5.0, 5.0, 5.0], [math.inf, -math.inf, 0.25], None])
def test_exact_quantiles_of_doubles(spark, rng, vec, values):
    from gridloom.operators import sort

    values = list(rng.normal(0, 1, 400) * 10.0 ** rng.integers(-300, 300, 400)) + [0.5] * 300 if values is None else values
    finite = [v for v in values if math.isfinite(v)]
    df = vec(values)
    probabilities = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    if len(finite) == len(values):
        got = {r.probability: r.value for r in sort.quantiles(df, "x", probabilities).collect()}
        for p in probabilities:
            at = p * (len(values) - 1)
            low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
            assert got[p] == pytest.approx(low if at % 1 == 0 else low * (1 - at % 1) + high * (at % 1), rel=1e-12)
    for k in {1, len(values) // 2 + 1, len(values)}:
        assert one(sort.kth_smallest(df, k)) == sorted(values)[k - 1]
    with pytest.raises(Exception, match="larger than the number of rows"):
        one(sort.kth_smallest(df, len(values) + 1))


def test_quantiles_of_odd_columns(spark):
    from gridloom.operators import reduce, sort

    df = spark.createDataFrame([(1, 2.5, None), (None, None, None), (4, float("nan"), None), (2, -1.0, None)], "a int, b double, c double")
    assert [r.value for r in sort.quantiles(df, "a", [0.5]).collect()] == [2.0]
    assert [r.value for r in sort.quantiles(df, "b", [0.0, 0.5]).orderBy("probability").collect()] == [-1.0, 2.5]
    assert sort.quantiles(df, "c", [0.5]).count() == 0
    row = reduce.describe(df, "a").first()
    assert (row["min"], row["max"], row["median"], row["total"]) == (1, 4, 2.0, 7) and reduce.describe(df, "c").first()["median"] is None
    # nothing holds the distinct values: the aggregates of the selection are counts of digits
    plan = reduce.describe(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_user_folds_and_scans(spark, rng, bits):
    from gridloom.operators import monoid

    def compose(first, second):
        return {"a": first["a"] * second["a"] % 101, "b": (second["a"] * first["b"] + second["b"]) % 101}

    rows = [(None if g == 2 else int(g), int(i) * 3 - 70, int(a), int(b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 3, 150), rng.integers(1, 101, 150), rng.integers(0, 101, 150)))]
    df = spark.createDataFrame(rows, "g long, i long, a long, b long").repartition(6)
    want, ends = {}, {}
    for g, i, a, b in rows:
        x, y = ends.get(g, (1, 0))
        ends[g] = want[g, i] = (x * a % 101, (a * y + b) % 101)
    got = monoid.scan(df, "i", ["a", "b"], compose, ["g"], bits=bits)
    assert {(r.g, r.i): (r.a, r.b) for r in got.collect()} == want and got.columns == ["g", "i", "a", "b"]
    assert {r.g: (r.a, r.b) for r in monoid.fold(df, "i", ["a", "b"], compose, {}, ["g"], bits=bits).collect()} == ends
    x, y = 1, 0
    for _, _, a, b in rows:
        x, y = x * a % 101, (a * y + b) % 101
    identity = {"a": 1, "b": 0}
    assert tuple(monoid.fold(df, "i", ["a", "b"], compose, identity, bits=bits).first()) == (x, y)
    assert tuple(monoid.fold(df.where("false"), "i", ["a", "b"], compose, identity).first()) == (1, 0)
    assert monoid.fold(df.where("false"), "i", ["a", "b"], compose, identity, ["g"]).count() == 0 == monoid.scan(df.where("false"), "i", ["a"], compose).count()


def test_user_functions_of_other_types(spark):
    from gridloom.operators import monoid

    def last(first, second):
        return {"t": second["t"]}

    df = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "i long, t string").repartition(4)
    assert monoid.fold(df, "i", ["t"], last, {"t": ""}, bits=2).first()[0] == "t39"
    assert all(r.t == f"t{r.i}" for r in monoid.scan(df, "i", ["t"], last, bits=2).collect())


def test_small_buckets_share_calls(spark):
    from gridloom.operators import monoid

    def run(work, n):
        calls = spark.sparkContext.accumulator(0)

        def add(first, second):
            calls.add(1)
            return {"x": first["x"] + second["x"]}

        rows = work(spark.range(n).selectExpr("id % 3 AS g", "id AS i", "id AS x"), "i", ["x"], add).collect()
        return rows, calls.value

    fold = lambda *a: monoid.fold(*a, {}, ["g"], bits=2)
    scan = lambda *a: monoid.scan(*a, ["g"], bits=2)
    assert {r.g: r.x for r in run(fold, 6000)[0]} == {g: sum(range(g, 6000, 3)) for g in range(3)}
    # buckets of four positions, one or two rows of a group each: far fewer calls than buckets
    assert run(fold, 6000)[1] < 200 and run(scan, 6000)[1] < 200
    assert {(r.g, r.i): r.x for r in run(scan, 6000)[0]} == {(i % 3, i): sum(range(i % 3, i + 1, 3)) for i in range(6000)}


def test_equal_points_are_spread_over_ranges(spark):
    df = spark.range(4000).selectExpr("double(id % 2) AS x", "0.0D AS y")
    more = df.union(spark.createDataFrame([(1.0, 0.0)], "x double, y double"))
    assert one(compare.point_sets_equal(df, df.repartition(3))) and not one(compare.point_sets_equal(df, more))
