"""Plane geometry on hard inputs: clusters, lines, circles, null keys, and how the work grows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from conftest import one
from test_structures import brute_closest, monotone, points

from gridloom.operators import geometry
from gridloom.runtime import stage_root


def brute_triangle(xy):
    return min((0.5 * abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) for p, q, r in itertools.combinations(xy, 3)), default=0.0)


def shapes(rng):
    turn = np.linspace(0, 2 * np.pi, 70, endpoint=False)
    cluster = np.vstack([rng.normal(0, 1e-3, (35, 2)) + 5, rng.normal(0, 1e-6, (20, 2)) - 3, rng.uniform(-10, 10, (15, 2))])
    line = np.column_stack([np.linspace(0, 1, 60), np.linspace(0, 1, 60) * 0.3 + rng.normal(0, 1e-7, 60)])
    return {
        "random": rng.uniform(-1, 1, (90, 2)), "circle": np.column_stack([np.cos(turn), np.sin(turn)]), "clusters": cluster, "near a line": line,
        "parabola": np.column_stack([np.arange(60.0), np.arange(60.0) ** 2]), "far off": rng.uniform(-1, 1, (50, 2)) * [1e-4, 1e4] + [1e6, -1e6],
    }


def test_smallest_triangle_of_hard_shapes(spark, rng):
    named = shapes(rng)
    frame = pd.concat([pd.DataFrame(xy, columns=["x", "y"]).assign(g=name) for name, xy in named.items()])
    df = spark.createDataFrame(frame.assign(i=range(len(frame)))).repartition(5)
    for chunk in (3, 12):
        got = {r.g: r.area for r in geometry.smallest_triangle(df, ["g"], chunk=chunk).collect()}
        for name, xy in named.items():
            # rounding of the products decides below this level
            noise = 1e-14 * np.ptp(xy, axis=0).max() ** 2
            assert got[name] == pytest.approx(brute_triangle(xy.tolist()), rel=1e-9, abs=noise), (name, chunk)


def test_smallest_triangle_of_odd_groups(spark):
    rows = [(None, k, k * k, k) for k in range(5)] + [(1, k, 2 * k, k) for k in range(4)] + [(2, 0, 0, 0), (2, 5, 5, 1)]
    rows += [(3, 0, 0, 0), (3, 0, 0, 1), (3, 9, 1, 2), (4, None, 1, 0), (4, 0, 0, 1), (4, 4, 0, 2), (4, 0, 5, 3), (4, math.nan, 0, 4), (5, None, None, 0)]
    rows = [(g, None if x is None else float(x), None if y is None else float(y), i) for g, x, y, i in rows]
    df = spark.createDataFrame(rows, "g long, x double, y double, i long")
    got = {r.g: r.area for r in geometry.smallest_triangle(df, ["g"]).collect()}
    assert got == {None: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 10.0, 5: 0.0}
    assert geometry.smallest_triangle(df.where("false"), ["g"]).count() == 0
    assert one(geometry.smallest_triangle(df.where("g = 4").select("x", "y", "i"), [])) == 10.0


def shuffled(spark):
    """Rows written to shuffles so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_triangle_work_grows_below_the_cube(spark, rng):
    moved = []
    for n in (1000, 2000, 4000):
        df = points(spark, rng.uniform(-1, 1, (n, 2)), 4, g=["a"] * n).cache()
        df.count()
        before = shuffled(spark)
        area = geometry.smallest_triangle(df, ["g"]).first().area
        assert 0 < area < 1e-5
        moved.append(shuffled(spark) - before)
        assert moved[-1] < n**2.2 / 20
    assert moved[2] < moved[0] * 4**2.2
    twice = points(spark, np.vstack([rng.uniform(-1, 1, (4000, 2)), [[0.5, 0.5]] * 2]), 4, g=["a"] * 4002)
    before = shuffled(spark)
    assert geometry.smallest_triangle(twice, ["g"]).first().area == 0.0
    assert shuffled(spark) - before < 4 * 4002


def test_smallest_triangle_needs_few_sizes(spark, rng):
    xy = rng.uniform(-1, 1, (700, 2))
    named = {"random": xy, "flat": xy * [1e3, 1e-2] @ [[0.8, 0.6], [-0.6, 0.8]], "far off": xy + [50, -80]}
    frame = pd.concat([pd.DataFrame(v, columns=["x", "y"]).assign(g=name) for name, v in named.items()])
    df = spark.createDataFrame(frame.assign(i=range(len(frame)))).repartition(5)
    folder = __import__("pathlib").Path(stage_root(spark).removeprefix("file://"))
    before = set(folder.glob("triangles-*"))
    got = {r.g: r.area for r in geometry.smallest_triangle(df, ["g"], chunk=16).collect()}
    assert len(set(folder.glob("triangles-*")) - before) <= 3  # nine, when each size was half the last one
    for name, v in named.items():
        best = math.inf
        for k in range(len(v) - 2):
            x, y = (v[k + 1 :] - v[k]).T
            area = 0.5 * np.abs(np.outer(x, y) - np.outer(y, x))
            best = min(best, area[np.triu_indices(len(x), 1)].min())
        assert got[name] == pytest.approx(best, rel=1e-6, abs=2.0**-50 * np.ptp(v, axis=0).max() ** 2), name


def test_closest_pair_in_a_dense_cluster(spark, rng):
    xy = np.vstack([rng.uniform(0, 1000, (1500, 2)), rng.uniform(0, 1e-3, (1500, 2)) + 500])  # half of the points in one cell
    df = points(spark, xy, 7)
    gaps = [np.sort(np.hypot(*(xy[k + 1 :] - xy[k]).T))[:1] for k in range(len(xy) - 1)]
    assert one(geometry.closest_pair(df)) == pytest.approx(min(g[0] for g in gaps), rel=1e-9)
    nested = np.vstack([rng.uniform(-1, 1, (12, 2)) * 10.0**-k + 3 for k in range(0, 12)])
    assert one(geometry.closest_pair(points(spark, nested, 3), cell_limit=4)) == pytest.approx(brute_closest(nested.tolist()), rel=1e-6)
    many = points(spark, np.vstack([xy[:100], [[7.0, 7.0]] * 500]), 3)
    assert one(geometry.closest_pair(many)) == 0.0 and one(geometry.closest_pair(many, ("x",))) == 0.0


def test_no_crowded_cell_is_joined(spark, rng):
    xy = np.vstack([rng.uniform(0, 1000, (3000, 2)), rng.uniform(0, 1e-3, (3000, 2)) + 500])
    df = points(spark, xy, 7).cache()
    df.count()
    before = shuffled(spark)
    one(geometry.closest_pair(df))
    assert shuffled(spark) - before < 20 * len(xy)  # 6 rows a point meet in the join, the rest are counts
    plan = geometry.closest_pair(df)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Python" not in plan and "Pandas" not in plan


def test_closest_pair_ignores_what_is_no_number(spark):
    rows = [(0, 0.0, 0.0), (1, None, 0.0), (2, math.nan, 0.0), (3, math.inf, 0.0), (4, 3.0, 4.0), (5, None, 0.0)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    assert one(geometry.closest_pair(df)) == 5.0 and one(geometry.closest_pair(df.where("i < 4"))) == 0.0
    assert one(geometry.closest_pair(df.where("false"))) == 0.0


def test_a_hull_of_many_tasks(spark, rng, tmp_path):
    turn = rng.permutation(np.linspace(0, 2 * np.pi, 1200, endpoint=False))
    xy = np.column_stack([1e6 * np.cos(turn), 1e6 * np.sin(turn)])
    inside = rng.uniform(-5e5, 5e5, (300, 2))
    expected = monotone(np.vstack([xy, inside]).tolist())
    df = points(spark, np.vstack([xy, inside]), 6)
    assert {(r.x, r.y) for r in geometry.convex_hull(df, side_rows=40).collect()} == expected and len(expected) == 1200
    edges = geometry.hull_edges(df, side_rows=40)
    newest = max(__import__("pathlib").Path(stage_root(spark).removeprefix("file://")).glob("sides-*"), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(str(newest)).count() >= 32  # sides, each a task of its own
    ring = {(r.x, r.y): (r.next_x, r.next_y) for r in edges.collect()}
    at, seen = next(iter(ring)), 0
    while seen < len(ring):
        at, seen = ring[at], seen + 1
    assert at == next(iter(ring)) and len(ring) == 1200
    ring_length = one(geometry.hull_perimeter(df, side_rows=40))
    assert ring_length == pytest.approx(2 * 1200 * 1e6 * math.sin(math.pi / 1200), rel=1e-9)


@pytest.mark.parametrize("side_rows", [1, 2, 7])
def test_split_sides_of_lattices(spark, rng, side_rows):
    xy = rng.integers(-9, 10, (250, 2)).astype(float)
    assert {(r.x, r.y) for r in geometry.convex_hull(points(spark, xy, 5), side_rows=side_rows).collect()} == monotone(xy.tolist())


def test_hulls_of_odd_groups(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 1.0)]
    rows = [(None, x, y) for x, y in square] + [("a", x, y) for x, y in square] + [("", 1.0, 1.0), ("", None, 2.0), ("n", None, None), ("n", math.nan, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    hulls = {}
    for r in geometry.convex_hull(df, ["g"]).collect():
        hulls.setdefault(r.g, set()).add((r.x, r.y))
    assert hulls == {None: set(square[:4]), "a": set(square[:4]), "": {(1.0, 1.0)}}
    assert {r.g: r.perimeter for r in geometry.hull_perimeter(df, ["g"]).collect()} == {None: 16.0, "a": 16.0, "": 0.0, "n": 0.0}
    assert geometry.convex_hull(df.where("false"), ["g"]).count() == 0
