"""Null keys are a group like any other; NaN is no value."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry, index, sort
from gridloom.sources import results


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(i, None if i % 2 else "a", float(i % 5)) for i in range(40)]
    return spark.createDataFrame(rows, "i long, k string, x double").repartition(4)


def test_running_sums_of_the_null_key(keyed):
    out = index.running(keyed, "i", "x", keys=["k"], bits=3).collect()
    for key in (None, "a"):
        total = 0.0
        for r in sorted((r for r in out if r.k == key), key=lambda r: r.i):
            total += r.x
            assert r.scan == total


def test_ranks_within_the_null_key(keyed):
    out = index.rank_rows(keyed, ["x", "i"], keys=["k"]).collect()
    assert len(out) == 40
    for key in (None, "a"):
        group = sorted((r.x, r.i) for r in out if r.k == key)
        assert {(r.x, r.i): r.pos for r in out if r.k == key} == {v: n for n, v in enumerate(group)}


def test_minimum_of_the_null_key(keyed):
    assert {r.low for r in index.group_min(keyed.where("x > 1"), ["k"], "x", "low").collect()} == {2.0}


def test_closest_pair_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 11.0), (3, None)], "i long, x double")
    assert geometry.closest_pair_1d(df).first()[0] == 10.0


def test_selection_takes_fractions_and_refuses_other_types(keyed):
    values = sorted(r.x for r in keyed.collect() if r.x is not None)
    assert [sort.kth_smallest(keyed, k).first()[0] for k in (1, 2)] == values[:2]
    with pytest.raises(TypeError):
        sort.kth_smallest(keyed.withColumn("x", F.col("x").cast("string")), 2)


def test_selection_skips_nulls_and_reads_the_table_once_a_round(spark):
    df = spark.createDataFrame([(5,), (None,), (-3,), (70000,), (None,), (5,)], "x long")
    assert [sort.kth_smallest(df, k).first()[0] for k in (1, 2, 3, 4)] == [-3, 5, 5, 70000]
    plan = sort.kth_smallest(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 4


def test_console_form_prints_every_row(spark, capsys):
    results.write_table(spark.range(1500))
    assert len(capsys.readouterr().out.splitlines()) == 1501


@pytest.mark.parametrize("whole", [2, 1 << 16])
def test_series_with_null_keys(spark, whole):
    import numpy as np

    from gridloom.operators import spectral

    values = {None: [1.0, 2.0, 0.5, 4.0], "a": [3.0, -1.0, 2.0], "": [7.0]}
    rows = [(key, n, x, "x") for key, series in values.items() for n, x in enumerate(series)]
    df = spark.createDataFrame(rows, "s string, n long, re double, _g string").repartition(3)
    got = {}
    for r in spectral.fft(df, ["s"], whole_series=whole).collect():
        got.setdefault(r.s, {})[r.k] = complex(r.re, r.im)
    assert set(got) == set(values)
    for key, series in values.items():
        assert np.allclose([got[key][k] for k in range(len(series))], np.fft.fft(series))
    with pytest.raises(ValueError, match="must not be called"):
        spectral.fft(df.withColumnRenamed("s", "k"), ["k"])
    assert spectral.fft(df.where("false"), ["s"]).count() == 0
    assert spectral.fft(df.where("s = 'a'"), []).count() == 3
