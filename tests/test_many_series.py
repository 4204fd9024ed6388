"""Blocks of many short series are transformed together, whatever batch they come in."""

import numpy as np
import pytest

from gridloom.operators import spectral


@pytest.mark.parametrize("cells", [16, 1 << 16])
@pytest.mark.parametrize("records", [7, 10_000])
def test_blocks_of_many_series(spark, rng, monkeypatch, cells, records):
    monkeypatch.setattr(spectral, "GROUP_CELLS", cells)
    series = {(None if k == 3 else k): rng.uniform(-1, 1, 2) @ [1, 1j] * rng.uniform(-1, 1, n) for k, n in enumerate([1, 2, 3, 5, 8, 64, 70, 128, 31, 64])}
    rows = [(k, n, float(x.real), float(x.imag)) for k, xs in series.items() for n, x in enumerate(xs) if n % 5 != 1 or n == len(xs) - 1]
    df = spark.createDataFrame(rows, "s long, n long, re double, im double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        for pad in (True, False):
            result = spectral.fft(df, ["s"], pad=pad, whole_series=0)
            # no task group per series
            assert "FlatMapGroupsInPandas" not in result._jdf.queryExecution().optimizedPlan().toString()
            got = {}
            for r in result.collect():
                got.setdefault(r.s, {})[r.k] = complex(r.re, r.im)
            assert got.keys() == series.keys()
            for k, xs in series.items():
                size = 1 << (len(xs) - 1).bit_length() if pad else len(xs)
                held = np.zeros(size, complex)
                for n, x in enumerate(xs):
                    if n % 5 != 1 or n == len(xs) - 1:
                        held[n] = x
                assert np.allclose([got[k][f] for f in range(size)], np.fft.fft(held), atol=1e-9), (k, pad)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
