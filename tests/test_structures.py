"""Matrices, systems, grids, points, graphs and spectra against numpy or brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from gridloom.operators import geometry, graph, matrix, spectral, stencil, systems


def coo(spark, dense, parts=3, drop_zeros=True):
    rows, cols = np.indices(dense.shape).reshape(2, -1)
    frame = pd.DataFrame({"row": rows, "col": cols, "value": dense.ravel()})
    if drop_zeros:
        frame = frame[frame["value"] != 0]
    return spark.createDataFrame(frame).repartition(parts)


def vector(spark, values):
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(len(values)), "x": values}))


def to_dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


def sparse(rng, m, n, density=0.1):
    return np.where(rng.random((m, n)) < density, rng.uniform(-1, 1, (m, n)), 0)


@pytest.mark.parametrize("bits", [2, 8])
def test_gemm(spark, rng, bits):
    a, b = rng.uniform(-1, 1, (19, 13)), rng.uniform(-1, 1, (13, 11))
    got = to_dense(matrix.gemm(coo(spark, a), coo(spark, b), (19, 11), bits), (19, 11))
    assert np.allclose(got, a @ b)


def test_spmm_adds_duplicates_and_survives_a_hot_inner_index(spark, rng):
    a, b = sparse(rng, 40, 30), sparse(rng, 30, 20)
    a[:, 3], b[3, :] = 1.0, 2.0
    twice = coo(spark, a).union(coo(spark, a))
    plain = to_dense(matrix.spmm(twice, coo(spark, b)), (40, 20))
    assert np.allclose(plain, 2 * a @ b)
    salted = to_dense(matrix.spmm(twice, coo(spark, b), hot_rows=10, share=40), (40, 20))
    assert np.allclose(salted, 2 * a @ b)
    assert matrix.spmm(coo(spark, a), coo(spark, b), (40, 20)).count() == 800


def test_gemv_and_spmv(spark, rng):
    a, x, y = sparse(rng, 30, 20, 0.3), rng.uniform(-1, 1, 20), rng.uniform(-1, 1, 31)
    got = {r.i: r.y for r in matrix.gemv(coo(spark, a, drop_zeros=False), vector(spark, x)).collect()}
    assert np.allclose([got[i] for i in range(30)], a @ x)
    outside = spark.createDataFrame([(2, 99, 5.0), (99, 2, 5.0)], "row long, col long, value double")
    z = matrix.spmv(coo(spark, a).union(outside), vector(spark, x), vector(spark, y), 0.5, 2.0)
    got = {r.i: r.y for r in z.collect()}
    assert np.allclose([got[i] for i in range(31)], 2 * y + np.append(0.5 * a @ x, 0))


def test_sparse_axpy(spark):
    schema = "i long, value double"
    x = spark.createDataFrame([(5, 12.0), (8, 3.0), (12, -1.0)], schema)
    y = spark.createDataFrame([(3, 1.0), (5, -2.0), (7, 1.0), (8, -3.0)], schema)
    got = {r.i: r.value for r in matrix.sparse_axpy(x, y, 1.0).collect()}
    assert got == {3: 1.0, 5: 10.0, 7: 1.0, 8: 0.0, 12: -1.0}
    assert 8 not in {r.i for r in matrix.sparse_axpy(x, y, 1.0, drop_zeros=True).collect()}


def keyed(df, system):
    return df.withColumn("system_id", F.lit(system))


def test_solve_and_lu(spark, rng):
    mats, rhs, truth = [], [], {}
    for s in range(3):
        a, x = rng.uniform(-10, 10, (12, 12)), rng.uniform(-10, 10, 12)
        truth[s] = (a, x)
        mats.append(keyed(coo(spark, a), s))
        b = vector(spark, a @ x).select(F.col("i").alias("row"), F.col("x").alias("value"))
        rhs.append(keyed(b, s))
    a_all = mats[0].union(mats[1]).union(mats[2])
    b_all = rhs[0].union(rhs[1]).union(rhs[2])
    for pivot in ("none", "partial"):
        got = systems.solve(a_all, b_all, pivot).toPandas()
        for s, (_, x) in truth.items():
            assert np.allclose(got[got.system_id == s].sort_values("row")["x"], x, atol=1e-4)
    parts = systems.lu(a_all)
    packed = systems.lu_in_place(a_all)
    for s, (a, _) in truth.items():
        lower = to_dense(parts.where(f"system_id = {s} and part = 'L'"), (12, 12))
        upper = to_dense(parts.where(f"system_id = {s} and part = 'U'"), (12, 12))
        assert np.allclose(lower @ upper, a, atol=1e-6)
        assert np.allclose(to_dense(packed.where(f"system_id = {s}"), (12, 12)), upper + lower - np.eye(12))


def test_solve_examples(spark):
    a = keyed(coo(spark, np.array([[1, 4, 2], [1, 2, 3], [2, 1, 3.0]])), 0)
    b = spark.createDataFrame([(0, 0, 11.0), (0, 1, 11.0), (0, 2, 13.0)], "system_id int, row long, value double")
    assert [round(r.x, 9) for r in systems.solve(a, b).orderBy("row").collect()] == [3, 1, 2]
    zero_pivot = keyed(coo(spark, np.array([[0, 1], [1, 0.0]])), 0)
    b2 = b.where("row < 2")
    assert [(r.x, r.solved) for r in systems.solve(zero_pivot, b2).collect()] == [(0.0, False)] * 2
    assert [r.x for r in systems.solve(zero_pivot, b2, "partial").orderBy("row").collect()] == [11.0, 11.0]
    rows = [(0, 0, 0, 1.0, 0), (0, 0, 0, 4.0, 1), (0, 0, 1, 3.0, 2), (0, 1, 0, 6.0, 3), (0, 1, 1, 3.0, 4)]
    dup = spark.createDataFrame(rows, "system_id int, row long, col long, value double, ord int")
    u = systems.lu(dup, "ord").where("part = 'U' and row = 1 and col = 1").first()
    assert u.value == -1.5
    with pytest.raises(Exception, match="max_order"):
        systems.lu(a, max_order=2).collect()


def grid(spark, values, parts=4):
    rows, cols = np.indices(values.shape).reshape(2, -1)
    return spark.createDataFrame(pd.DataFrame({"r": rows, "c": cols, "v": values.ravel()})).repartition(parts)


def from_grid(df, shape):
    got = df.toPandas()
    assert len(got) == shape[0] * shape[1]
    out = np.zeros(shape)
    out[got["r"], got["c"]] = got["v"]
    return out


def brute(values, weights):
    n, m = values.shape
    out = np.zeros((n, m))
    for r, c in itertools.product(range(n), range(m)):
        for (dr, dc), w in weights.items():
            if 0 <= r + dr < n and 0 <= c + dc < m:
                out[r, c] += w * values[r + dr, c + dc]
    return out


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_stencils(spark, rng, bits):
    binary, grey = rng.integers(0, 2, (21, 17)), rng.integers(0, 255, (21, 17))
    ones = brute((binary == 1).astype(int), stencil.CROSS)
    assert (from_grid(stencil.one_neighbour_cells(grid(spark, binary), bits=bits), ones.shape) == (ones == 1)).all()
    edges = np.clip(brute(grey, stencil.EDGE), 0, 255)
    assert (from_grid(stencil.edge_filter(grid(spark, grey), bits=bits), edges.shape) == edges).all()
    real = rng.uniform(-100, 100, (21, 17))
    assert np.allclose(from_grid(stencil.jacobi_2d(grid(spark, real), bits=bits), real.shape), brute(real, stencil.FIVE_POINT) / 5)
    around = brute(binary, stencil.MOORE)
    expected = np.where(binary == 1, (around == 2) | (around == 3), around == 3)
    assert (from_grid(stencil.neighbour_rule(grid(spark, binary), bits=bits), expected.shape) == expected).all()


def test_wide_kernel_and_gaps(spark, rng):
    values = rng.integers(0, 9, (9, 9))
    weights = {(-2, 1): 2.0, (0, -2): 1.0, (2, 2): -1.0}
    got = stencil.convolve2d(grid(spark, values), weights, bits=2).select("r", "c", F.col("s").alias("v"))
    assert (from_grid(got, values.shape) == brute(values, weights)).all()
    sparse_cells = stencil.convolve2d(grid(spark, values).where("(r + c) % 3 != 0"), stencil.MOORE, bits=2)
    kept = np.where(np.add.outer(range(9), range(9)) % 3 != 0, values, 0)
    for row in sparse_cells.collect():
        assert row.s == brute(kept, stencil.MOORE)[row.r, row.c]


def test_edge_filter_example(spark):
    image = np.array([[112, 118, 141, 152], [93, 101, 119, 203], [45, 17, 16, 232], [82, 31, 49, 101]])
    expected = [[255, 255, 255, 255], [255, 147, 0, 255], [36, 0, 0, 255], [255, 39, 0, 255]]
    assert from_grid(stencil.edge_filter(grid(spark, image)), (4, 4)).tolist() == expected


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_jacobi_1d(spark, rng, bits):
    x = rng.uniform(-100, 100, 100)
    got = stencil.jacobi_1d(vector(spark, x).repartition(5), bits=bits).orderBy("i").collect()
    padded = np.pad(x, 1)
    assert np.allclose([r.y for r in got], (padded[:-2] + x + padded[2:]) / 3)


def points(spark, xy, parts=3, **extra):
    frame = pd.DataFrame({"i": np.arange(len(xy)), "x": [float(p[0]) for p in xy], "y": [float(p[1]) for p in xy], **extra})
    return spark.createDataFrame(frame).repartition(parts)


def brute_closest(xy):
    return min(math.dist(p, q) for p, q in itertools.combinations(xy, 2))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_closest_pair(spark, rng, parts):
    xy = rng.uniform(-1000, 1000, (300, 2))
    assert one(geometry.closest_pair(points(spark, xy, parts))) == pytest.approx(brute_closest(xy), abs=1e-9)
    assert one(geometry.closest_pair(points(spark, xy, parts), cell_limit=1)) == pytest.approx(brute_closest(xy), abs=1e-9)
    line = np.column_stack([np.full(60, 5.0), rng.uniform(0, 1, 60)])
    assert one(geometry.closest_pair(points(spark, line, parts))) == pytest.approx(brute_closest(line), abs=1e-12)
    assert one(geometry.closest_pair(points(spark, np.vstack([xy, xy[:1]]), parts))) == 0.0
    flat = points(spark, xy, parts)
    gaps = np.diff(np.sort(xy[:, 0])).min()
    assert one(geometry.closest_pair_1d(flat)) == pytest.approx(gaps, abs=1e-9)
    assert one(geometry.closest_pair(flat, ("x",))) == pytest.approx(gaps, abs=1e-9)


def test_closest_pair_edges(spark):
    assert one(geometry.closest_pair(points(spark, [(1, 2)]))) == 0.0
    assert one(geometry.closest_pair_1d(points(spark, [(1, 2)]))) == 0.0
    assert one(geometry.closest_pair(points(spark, [(0, 0), (3, 4)], 8))) == 5.0
    assert one(geometry.closest_pair_1d(points(spark, [(7, 0), (3, 0), (9, 0), (12, 0), (2, 0)]))) == 1.0
    dense_cluster = [(0, 0), (1000, 1000), *[(500 + k * 1e-3, 500 + (k % 7) * 1e-3) for k in range(50)]]
    assert one(geometry.closest_pair(points(spark, dense_cluster, 40), cell_limit=4)) == pytest.approx(brute_closest(dense_cluster))


@pytest.mark.parametrize("chunk", [3, 5, 96])
def test_smallest_triangle(spark, rng, chunk):
    xy = rng.uniform(-1000, 1000, (34, 2))
    key = ["a"] * 20 + ["b"] * 12 + ["c"] * 2
    got = {r.g: r.area for r in geometry.smallest_triangle(points(spark, xy, g=key), ["g"], chunk=chunk).collect()}
    for name in "ab":
        mine = [p for p, k in zip(xy, key) if k == name]
        area = min(
            0.5 * abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) for p, q, r in itertools.combinations(mine, 3)
        )
        assert got[name] == pytest.approx(area, abs=1e-6)
    assert got["c"] == 0.0


def monotone(xy):
    xy = sorted(set(map(tuple, xy)))
    if len(xy) < 3:
        return set(xy)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return set(half(xy)) | set(half(xy[::-1]))


@pytest.mark.parametrize(
    "name", ["random", "integers", "line", "vertical", "square", "circle", "two", "one", "same", "triangle"]
)
def test_convex_hull(spark, rng, name):
    xy = {
        "random": rng.uniform(-1000, 1000, (400, 2)),
        "integers": rng.integers(0, 6, (60, 2)),
        "line": [(k, 2 * k) for k in range(9)],
        "vertical": [(3, k) for k in range(9)],
        "square": [(0, 0), (0, 2), (2, 0), (2, 2), (1, 0), (0, 1), (1, 2), (2, 1), (1, 1)],
        "circle": [(round(math.cos(t), 6), round(math.sin(t), 6)) for t in np.linspace(0, 6, 50)],
        "two": [(0, 0), (3, 4)],
        "one": [(1, 1)],
        "same": [(1, 1)] * 5,
        "triangle": [(0, 0), (5, 1), (2, 7), (2, 3)],
    }[name]
    expected = monotone([(float(a), float(b)) for a, b in xy])
    for parts in (1, 6):
        df = points(spark, xy, parts)
        assert {(r.x, r.y) for r in geometry.convex_hull(df).collect()} == expected
        ring = sorted(expected, key=lambda p: math.atan2(p[1] - np.mean([q[1] for q in expected]), p[0] - np.mean([q[0] for q in expected])))
        length = sum(math.dist(p, q) for p, q in zip(ring, ring[1:] + ring[:1]))
        assert one(geometry.hull_perimeter(df)) == pytest.approx(length if len(xy) >= 3 else 0.0)


def test_hulls_per_group(spark, rng):
    xy = rng.uniform(-5, 5, (200, 2))
    key = rng.choice(["a", "b"], 200, p=[0.9, 0.1])
    got = geometry.convex_hull(points(spark, xy, g=key), ["g"]).collect()
    for name in "ab":
        assert {(r.x, r.y) for r in got if r.g == name} == monotone(xy[key == name])


def test_hull_perimeter_example(spark):
    xy = [(0, 3), (1, 1), (2, 2), (4, 4), (0, 0), (1, 2), (3, 1), (3, 3)]
    assert one(geometry.hull_perimeter(points(spark, xy))) == pytest.approx(13.4477, abs=1e-4)


def edges_of(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def union_find(n, pairs):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("shape", ["sparse", "path", "star", "dense", "none"])
def test_components(spark, rng, shape):
    n = 60
    pairs = {
        "sparse": [tuple(p) for p in rng.integers(0, n, (35, 2))],
        "path": list(zip(rng.permutation(n)[:-1], rng.permutation(n)[1:])),
        "star": [(7, v) for v in range(0, n, 2)],
        "dense": [tuple(p) for p in rng.integers(0, 30, (300, 2))],
        "none": [(3, 3)],
    }[shape]
    expected = union_find(n, pairs)
    vertices = spark.range(n)
    kw = {"hot_rows": 5, "share": 20} if shape == "star" else {}
    got = {r.id: r.component for r in graph.component_labels(edges_of(spark, pairs), vertices, **kw).collect()}
    assert [got[v] for v in range(n)] == expected
    if shape == "sparse":
        assert one(graph.component_count(edges_of(spark, pairs), vertices)) == len(set(expected))
        assert one(graph.largest_component(edges_of(spark, pairs), vertices)) == np.bincount(expected).max()


def test_degrees_and_edges(spark):
    rows = [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 1), (2, 0, 1), (2, 2, -5)]
    adjacency = spark.createDataFrame(rows, "src long, dst long, a int")
    assert one(graph.edge_count(adjacency)) == 3 and one(graph.max_degree(adjacency)) == 3
    assert one(graph.max_degree(adjacency.where("src > 9"))) == 0


def test_hop_distance(spark, rng):
    pairs = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (5, 6), (3, 0)]
    links = edges_of(spark, pairs)
    assert [one(graph.hop_distance(links, 0, d)) for d in (0, 1, 3, 6)] == [0, 1, 2, 2147483647]
    assert one(graph.hop_distance(links, 3, 2)) == 3


def series(spark, frames):
    parts = [pd.DataFrame({"s": s, "n": np.arange(len(z)), "re": z.real, "im": z.imag}) for s, z in frames.items()]
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def spectrum_of(df, s, re="re", im="im"):
    got = df.where(F.col("s") == s).orderBy("k").toPandas()
    return got[re].to_numpy() + 1j * got[im].to_numpy()


@pytest.mark.parametrize("whole", [4, 64, 1 << 16])
def test_transforms(spark, rng, whole):
    frames = {k: rng.uniform(-1, 1, n) + 1j * rng.uniform(-1, 1, n) for k, n in {"a": 256, "b": 100, "c": 1, "d": 37}.items()}
    df = series(spark, frames)
    forward = spectral.fft(df, ["s"], whole_series=whole).cache()
    backward = spectral.inverse_fft(df, ["s"], whole_series=whole).cache()
    for s, z in frames.items():
        assert np.allclose(spectrum_of(forward, s), np.fft.fft(z), atol=1e-9)
        assert np.allclose(spectrum_of(backward, s), np.fft.ifft(z), atol=1e-9)
    if whole == 64:
        real = spectral.dft(df.drop("im"), ["s"], whole_series=whole)
        assert np.allclose(spectrum_of(real, "b"), np.fft.fft(frames["b"].real), atol=1e-9)
        assert np.allclose(spectrum_of(spectral.fft_conjugate(df, ["s"]), "a"), np.conj(np.fft.fft(frames["a"])))
        assert np.allclose(spectrum_of(spectral.fft_split(df, ["s"]), "a", "r", "i"), np.fft.fft(frames["a"]))
        padded = spectral.fft(df, ["s"], pad=True, whole_series=whole)
        assert np.allclose(spectrum_of(padded, "b"), np.fft.fft(frames["b"], 128), atol=1e-9)


@pytest.mark.parametrize("shape, bits", [((40, 3, 5), 2), ((3, 50, 4), 2), ((2, 2, 60), 3), ((33, 33, 33), 4), ((1, 1, 1), 8)])
def test_gemm_of_any_shape(spark, rng, shape, bits):
    m, k, n = shape
    a, b = rng.uniform(-1, 1, (m, k)), rng.uniform(-1, 1, (k, n))
    left = coo(spark, a).union(coo(spark, a)).repartition(3)  # repeated coordinates add up
    for inner in (None, k):
        assert np.allclose(to_dense(matrix.gemm(left, coo(spark, b), (m, n), bits, inner), (m, n)), 2 * a @ b)
    assert matrix.gemm(left.where("false"), coo(spark, b), (m, n), bits).count() == 0


def test_gemm_shuffles_each_side_once(spark, rng):
    a, b = rng.uniform(-1, 1, (30, 64)), rng.uniform(-1, 1, (64, 30))
    plan = matrix.gemm(coo(spark, a), coo(spark, b), (30, 30), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "RoundRobin" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("hot_side", ["left", "right", "both"])
def test_spmm_with_a_hot_index_on_either_side(spark, rng, hot_side):
    a, b = sparse(rng, 60, 12), sparse(rng, 12, 50)
    if hot_side != "right":
        a[:, 3] = rng.uniform(1, 2, 60)
    if hot_side != "left":
        b[3, :] = rng.uniform(1, 2, 50)
    got = to_dense(matrix.spmm(coo(spark, a), coo(spark, b), hot_rows=12, share=1000), (60, 50))
    assert np.allclose(got, a @ b)


def test_grid_join_meets_every_pair_once(spark):
    from gridloom.runtime import grid_join, hot_keys

    left = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 1 WHEN id < 202 THEN NULL ELSE id % 7 END AS k", "id AS l")
    right = spark.range(200).selectExpr("CASE WHEN id < 100 THEN 2 WHEN id < 101 THEN NULL ELSE id % 7 END AS k", "id AS r")
    got = grid_join(left, right, ["k"], ["l"], ["r"], hot_rows=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, ["k"]).collect()))
    assert {r.k: r._slices for r in hot_keys(left, ["k"], 30).collect()} == {1: 8}  # 214 rows, 30 a task


def test_hop_distance_over_a_long_path(spark, rng):
    n = 21
    names = rng.permutation(n)
    pairs = [(names[k], names[k + 1]) for k in range(n - 1)] + [(names[k + 1], names[k]) for k in range(0, n - 1, 3)] + [(names[5], 100), (101, names[7])]
    edges = edges_of(spark, pairs).repartition(3).cache()
    assert one(graph.hop_distance(edges, int(names[0]), int(names[-1]))) == n - 1
    assert one(graph.hop_distance(edges, int(names[0]), int(names[-1]), max_hops=n - 2)) == 2147483647
    assert one(graph.hop_distance(edges, int(names[3]), 100)) == 3
    assert one(graph.hop_distance(edges, 100, 101)) == 2147483647


def test_hop_distances_of_random_graphs(spark, rng):
    for _ in range(4):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 25, (35, 2))]
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
        source, dest = (int(v) for v in rng.integers(0, 25, 2))
        seen, wave, hops, want = {source}, {source}, 0, 2147483647
        while wave:
            if dest in wave:
                want = hops
                break
            wave = {b for a in wave for b in near.get(a, ())} - seen
            seen |= wave
            hops += 1
        assert one(graph.hop_distance(edges_of(spark, pairs), source, dest, hot_rows=3)) == want


def test_visited_vertices_lie_in_few_segments(spark):
    from gridloom.operators.graph import _merged
    from gridloom.runtime import stage

    segments, rows = [], []
    for k in range(20):
        segments.append(stage(spark.range(k, k + 1), "wave"))
        rows.append(1)
        _merged(segments, rows)
        assert sum(rows) == k + 1 and len(rows) <= 3
    assert sorted(r.id for part in segments for r in part.collect()) == list(range(20))


def test_superseded_rounds_are_deleted(spark):
    import pathlib

    from gridloom.runtime import stage, stage_root, unstage

    root = pathlib.Path(stage_root(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()}
    path = edges_of(spark, [(k, k + 1) for k in range(30)])
    assert graph.component_labels(path).where("component <> 0").count() == 0
    left = {p.name.rsplit("-", 1)[0] for p in root.iterdir()} if not before else [p.name.rsplit("-", 1)[0] for p in root.iterdir() if p.name not in before]
    assert list(left).count("pairs") == 1 and "hung" not in left
    table = stage(spark.range(3), "gone")
    unstage(table)
    assert not pathlib.Path(table._staged_at.removeprefix("file://")).exists()
