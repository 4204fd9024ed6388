"""Every registered query against its SQL in DuckDB, and what the plans must and must not contain."""

import os
import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from check_queries import TABLES, keyed  # noqa: E402

DATA = os.environ.get("GRIDLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="test tables are absent")

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = keyed(df.select(*[df[f"`{c}`"] for c in order]).collect())
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == order
    assert got == keyed([[row[columns.index(c)] for c in order] for row in result.fetchall()])


def test_transform_of_one_long_series(spark):
    """No SQL for this one: an event is recovered from the whole spectrum."""
    import numpy as np

    values = [r.value for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").collect()]
    got = QUERIES["fft_of_all_events"](spark, DATA).orderBy("k").toPandas()
    spectrum = np.fft.fft(values, len(got))
    assert np.allclose(got["re"], spectrum.real, atol=0.006) and np.allclose(got["im"], spectrum.imag, atol=0.006)


def test_entry(spark):
    df = contract.entry(spark)
    assert "pass@1" in df.columns and df.count() > 0


def plan_of(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["prefix_sum", "sorted_ranks", "closest_pair", "spmm", "spmv", "gemm", "edge_filter", "convex_hull", "metric_table", "translation_prompts"]
)
def test_no_cross_products(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "selected_prompts")
    assert "EqualTo(source,src3)" in plan
    plan = plan_of(spark, "average")
    assert "ReadSchema: struct<value:double>" in plan


def test_worker_functions_travel_by_value(tmp_path):
    """Python workers need no copy of the package."""
    import subprocess

    from pyspark import cloudpickle

    from gridloom.operators.geometry import _corners

    code = "import pickle, sys, numpy; print(len(pickle.load(sys.stdin.buffer)(numpy.array([[0, 0], [2, 0], [0, 2], [.5, .5]]))))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(_corners), capture_output=True, cwd=tmp_path, check=True)
    assert done.stdout.strip() == b"3"


def test_metric_plan_joins_only_what_is_paired(spark):
    """Sizes and baselines come with the sums: the one join of samples is that of the paired kind."""
    plan = QUERIES["metric_table"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 9 and plan.count("Aggregate") <= 16, (plan.count("Join"), plan.count("Aggregate"))
