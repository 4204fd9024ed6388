"""Queries for the vector, matrix, grid, point, graph and spectral operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import views as v
from gridloom.catalog.registry import query, rounded
from gridloom.functions import numeric
from gridloom.operators import (
    compare,
    geometry,
    graph,
    histogram,
    index,
    matrix,
    monoid,
    reduce,
    scan,
    search,
    sort,
    spectral,
    stencil,
    systems,
    transform,
)

# ---------------------------------------------------------------- transforms


@query("relu", f"WITH {v.VEC} SELECT i, greatest(x - 50, 0.0) AS x FROM vec")
def _(t):
    return transform.relu(v.vec(t).withColumn("x", F.col("x") - 50))


@query("negate_odds", f"WITH {v.IVEC} SELECT i, CASE WHEN x % 2 = 0 THEN x // 2 ELSE -x END AS x FROM ivec")
def _(t):
    return transform.negate_odds(v.ivec(t))


@query(
    "inverse_offset",
    f"WITH {v.IVEC} SELECT i, CASE WHEN x = 0 THEN NULL ELSE round(1 - 1 / CAST(x AS DOUBLE), 9) + 0.0 END AS x FROM ivec",
)
def _(t):
    # the limit at zero is shown as null: infinities have no portable rounding
    out = transform.inverse_offset(v.ivec(t).withColumn("x", F.col("x").cast("double")))
    return out.select("i", F.when(F.abs("x") != float("inf"), rounded("x", 9)).alias("x"))


@query("squares", f"WITH {v.IVEC} SELECT i, x * x AS x FROM ivec")
def _(t):
    return transform.squares(v.ivec(t))


@query("power_of_two_mask", f"WITH {v.IVEC} SELECT i, (x > 0 AND (x & (x - 1)) = 0) AS mask FROM ivec")
def _(t):
    return transform.power_of_two_mask(v.ivec(t)).select("i", "mask")


@query("axpy", f"WITH {v.VEC} SELECT i, 2.5 * CAST(x AS DOUBLE) + o_totalprice AS z FROM vec JOIN orders ON i = o_orderkey")
def _(t):
    y = t.orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))
    return transform.axpy(v.vec(t), y, 2.5)


# ---------------------------------------------------------------- reductions


@query("logical_xor", f"WITH {v.VEC} SELECT count(*) FILTER (WHERE x > 50) % 2 = 1 AS result FROM vec")
def _(t):
    return reduce.logical_xor(v.vec(t).withColumn("x", F.col("x") > 50))


@query(
    "product_of_inverses",
    f"WITH {v.VEC} SELECT round(ln(product(CASE WHEN i % 2 = 1 THEN 1 / x ELSE x END)), 6) AS ln_result FROM vec",
)
def _(t):
    product = reduce.product_of_inverses(v.vec(t))
    return product.select(rounded(F.ln("result"), 6).alias("ln_result"))


@query(
    "log_magnitude_of_product",
    f"WITH {v.VEC} SELECT round(sum(CASE WHEN i % 2 = 1 THEN -ln(x) ELSE ln(x) END), 6) AS result FROM vec",
)
def _(t):
    return reduce.log_magnitude_of_product(v.vec(t)).select(rounded("result", 6).alias("result"))


@query("average", f"WITH {v.VEC} SELECT round(avg(x), 6) AS result FROM vec")
def _(t):
    return reduce.average(v.vec(t)).select(rounded("result", 6).alias("result"))


@query("smallest_odd", f"WITH {v.IVEC} SELECT coalesce(min(x) FILTER (WHERE x % 2 = 1), 2147483647) AS result FROM ivec")
def _(t):
    return reduce.smallest_odd(v.ivec(t))


@query(
    "sum_of_pair_minima",
    f"WITH {v.DVEC}, {v.OVEC} SELECT CAST(sum(least(a.x, b.x)) AS DOUBLE) AS result FROM dvec a JOIN ovec b USING (i)",
)
def _(t):
    return reduce.sum_of_pair_minima(v.dvec(t), v.ovec(t)).select(F.col("result").cast("double").alias("result"))


@query("fold_largest", f"WITH {v.IVEC} SELECT coalesce(max(x), -1) AS result FROM ivec")
def _(t):
    return reduce.fold(v.ivec(t), F.max("x"), -1)


@query("all_equal", "SELECT count(DISTINCT event_type) <= 1 AS result FROM events")
def _(t):
    return reduce.all_equal(t.events, "event_type")


@query("mean_or_zero", "SELECT round(coalesce(avg(o_totalprice), 0.0), 6) AS result FROM orders")
def _(t):
    return reduce.mean_or_zero(t.orders, "o_totalprice").select(rounded("result", 6).alias("result"))


# ---------------------------------------------------------------- histograms


def _histogram_sql(ctes: str, bins: int, expression: str, table: str) -> str:
    return (
        f"WITH {ctes}, spine AS (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin),"
        f" hits AS (SELECT CAST({expression} AS INTEGER) AS bin, count(*) AS n FROM {table} GROUP BY 1)"
        " SELECT s.bin, coalesce(n, 0) AS n FROM spine s LEFT JOIN hits h ON s.bin = h.bin"
    )


@query("pixel_counts", _histogram_sql(v.GRID, 256, "v", "grid"))
def _(t):
    return histogram.pixel_counts(v.grid(t))


@query("decade_counts", _histogram_sql(v.VEC, 10, "least(floor(least(x, 100.0) / 10), 9)", "vec"))
def _(t):
    return histogram.decade_counts(v.vec(t).withColumn("x", F.least("x", F.lit(100.0))))


@query(
    "quadrant_counts",
    _histogram_sql(
        v.QPTS, 4, "CASE WHEN y >= 0 THEN CASE WHEN x >= 0 THEN 0 ELSE 1 END WHEN x < 0 THEN 2 ELSE 3 END", "qpts"
    ),
)
def _(t):
    return histogram.quadrant_counts(v.qpts(t))


@query("first_letter_counts", _histogram_sql("w AS (SELECT lower(text) AS s FROM documents)", 26, "ascii(s) - 97", "w"))
def _(t):
    return histogram.first_letter_counts(t.documents, "text", fold_case=True)


@query("fraction_quarter_counts", _histogram_sql(v.VEC, 4, "floor((x - trunc(x)) * 4)", "vec"))
def _(t):
    return histogram.fraction_quarter_counts(v.vec(t))


# ---------------------------------------------------------------- scans

_UP = "OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)"


@query("prefix_sum", f"WITH {v.DVEC} SELECT i, CAST(sum(x) {_UP} AS DOUBLE) AS scan FROM dvec")
def _(t):
    return scan.prefix_sum(v.dvec(t)).select("i", F.col("scan").cast("double").alias("scan"))


@query("partial_minimums", f"WITH {v.VEC} SELECT i, CAST(min(CAST(x AS FLOAT)) {_UP} AS DOUBLE) AS scan FROM vec")
def _(t):
    floats = v.vec(t).withColumn("x", F.col("x").cast("float"))
    return scan.partial_minimums(floats).select("i", F.col("scan").cast("double").alias("scan"))


@query("partial_maximums", f"WITH {v.VEC} SELECT i, max(x) {_UP} AS scan FROM vec")
def _(t):
    return scan.partial_maximums(v.vec(t)).select("i", "scan")


@query(
    "prefix_sum_by_type",
    "SELECT event_id AS i, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS scan FROM events",
)
def _(t):
    keyed = t.events.select(F.col("event_id").alias("i"), "event_type", F.col("value").cast("decimal(18,2)").alias("x"))
    return scan.prefix_sum(keyed, keys=["event_type"]).select("i", "event_type", F.col("scan").cast("double").alias("scan"))


@query(
    "sum_of_prefix_sums",
    f"WITH {v.DVEC}, p AS (SELECT sum(x) {_UP} AS s FROM dvec) SELECT CAST(sum(s) AS DOUBLE) AS result FROM p",
)
def _(t):
    return scan.sum_of_prefix_sums(v.dvec(t)).select(F.col("result").cast("double").alias("result"))


@query(
    "reverse_prefix_sum",
    f"WITH {v.IVEC}, f AS (SELECT (SELECT max(i) FROM ivec) - i AS i, x FROM ivec)"
    f" SELECT i, CAST(sum(x) {_UP} AS BIGINT) AS scan FROM f",
)
def _(t):
    return scan.reverse_prefix_sum(v.ivec(t)).select("i", "scan")


@query(
    "maximum_subarray",
    f"WITH {v.IVEC}, p AS (SELECT i, sum(x) {_UP} AS s FROM ivec),"
    " q AS (SELECT s - least(0, coalesce(min(s) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM p)"
    " SELECT CAST(max(best) AS BIGINT) AS result FROM q",
)
def _(t):
    return scan.maximum_subarray(v.ivec(t))


@query(
    "ordinal_by_user",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events",
)
def _(t):
    return index.ordinal(t.events.select("event_id", "user_id"), "event_id", keys=["user_id"])


@query("group_minimum", "SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type) AS low FROM events")
def _(t):
    return index.group_min(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "low")


# ---------------------------------------------------------------- searches


@query(
    "last_short_book",
    "SELECT coalesce(max(event_id) FILTER (WHERE trunc(value * 3) < 100), count(*)) AS pos FROM events",
)
def _(t):
    books = t.events.select(F.col("event_id").alias("i"), F.col("event_type").alias("title"), (F.col("value") * 3).cast("bigint").alias("pages"))
    return search.last_short_book(books)


@query("contains", f"WITH {v.IVEC} SELECT count(*) FILTER (WHERE x = 42) > 0 AS found FROM ivec")
def _(t):
    return search.contains(v.ivec(t), 42)


@query("closest_to_pi", f"WITH {v.VEC} SELECT i AS pos FROM vec ORDER BY abs(x - pi()), i LIMIT 1")
def _(t):
    return search.closest_to(v.vec(t))


@query("first_even", f"WITH {v.IVEC} SELECT coalesce(min(i) FILTER (WHERE x % 2 = 0), count(*)) AS pos FROM ivec")
def _(t):
    return search.first_even(v.ivec(t))


@query(
    "in_exactly_one",
    f"WITH {v.IVEC}, {v.OIVEC} SELECT (SELECT count(*) > 0 FROM ivec WHERE x = 77) <> (SELECT count(*) > 0 FROM oivec WHERE x = 77) AS found",
)
def _(t):
    return search.in_exactly_one(v.ivec(t), v.oivec(t), 77)


@query(
    "symmetric_difference",
    f"WITH {v.IVEC}, {v.OIVEC} (SELECT x FROM ivec EXCEPT SELECT x FROM oivec) UNION ALL (SELECT x FROM oivec EXCEPT SELECT x FROM ivec)",
)
def _(t):
    return search.symmetric_difference(v.ivec(t), v.oivec(t))


# ---------------------------------------------------------------- sorts


@query(
    "sort_complex_by_magnitude",
    f"WITH {v.QPTS} SELECT row_number() OVER (ORDER BY sqrt(x*x + y*y), i) - 1 AS pos, i, x AS re, y AS im FROM qpts",
)
def _(t):
    z = v.qpts(t).withColumnsRenamed({"x": "re", "y": "im"})
    key = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))  # as the SQL text rounds it
    return sort.sort_by_key(z, key).select("pos", "i", "re", "im")


@query("kth_smallest", f"WITH {v.IVEC} SELECT x AS result FROM ivec ORDER BY x LIMIT 1 OFFSET 99")
def _(t):
    return sort.kth_smallest(v.ivec(t), 100, bits=32)  # 32-bit values


@query("kth_smallest_price", "SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS result FROM orders ORDER BY 1 LIMIT 1 OFFSET 499")
def _(t):
    cents = t.orders.select(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("x"))
    return sort.kth_smallest(cents, 500)


@query("kth_smallest_value", "SELECT value AS result FROM events ORDER BY 1 LIMIT 1 OFFSET 99")
def _(t):
    return sort.kth_smallest(t.events, 100, "value")


@query(
    "price_quantiles",
    "SELECT p AS probability, round(q, 6) AS value FROM (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]::DOUBLE[]) AS p,"
    " unnest(quantile_cont(o_totalprice - 150000.0, [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0])) AS q FROM orders)",
)
def _(t):
    """Exact quantiles of positive and negative doubles, all in one selection."""
    around = t.orders.select((F.col("o_totalprice") - 150000.0).alias("x"))
    return sort.quantiles(around, "x", [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]).select("probability", rounded("value", 6).alias("value"))


@query("sorted_ranks", f"WITH {v.VEC} SELECT i, row_number() OVER (ORDER BY CAST(x AS FLOAT), i) - 1 AS \"rank\" FROM vec")
def _(t):
    return sort.ranks(v.vec(t).withColumn("x", F.col("x").cast("float"))).select("i", "rank")


@query(
    "sort_records",
    "SELECT row_number() OVER (ORDER BY trunc(value), event_id) - 1 AS pos, CAST(trunc(value) AS BIGINT) AS \"startTime\","
    " user_id AS duration, value FROM events",
)
def _(t):
    records = t.events.select(
        F.col("event_id").alias("i"), F.col("value").cast("bigint").alias("startTime"), F.col("user_id").alias("duration"), "value"
    )
    return sort.sort_records(records).select("pos", "startTime", "duration", "value")


@query(
    "sort_ignoring_zeros",
    f"WITH {v.IVEC}, z AS (SELECT i, CASE WHEN x < 0 THEN 0 ELSE x END AS x FROM ivec),"
    " a AS (SELECT i, row_number() OVER (ORDER BY i) AS s FROM z WHERE x <> 0),"
    " b AS (SELECT x, row_number() OVER (ORDER BY x, i) AS s FROM z WHERE x <> 0)"
    " SELECT i, x FROM a JOIN b USING (s) UNION ALL SELECT i, x FROM z WHERE x = 0",
)
def _(t):
    return sort.sort_ignoring_zeros(v.ivec(t).withColumn("x", F.greatest("x", F.lit(0))))


# ---------------------------------------------------------------- matrices


@query(
    "gemm",
    f"WITH {v.EMBEDDING_CELLS} SELECT a.col AS \"row\", b.col AS col, round(sum(a.value * b.value), 4) + 0.0 AS value"
    " FROM embedding_cells a JOIN embedding_cells b ON a.\"row\" = b.\"row\" GROUP BY 1, 2",
)
def _(t):
    e = v.embedding_cells(t)
    flipped = e.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return matrix.gemm(flipped, e, (64, 64)).select("row", "col", rounded("value", 4).alias("value"))


@query(
    "gemv",
    f"WITH {v.ORDER_PARTS}, {v.PART_PRICES} SELECT \"row\" AS i, CAST(sum(value * x) AS DOUBLE) AS y"
    " FROM order_parts JOIN part_prices ON col = i GROUP BY 1",
)
def _(t):
    return matrix.gemv(v.order_parts(t), v.part_prices(t)).select("i", F.col("y").cast("double").alias("y"))


@query(
    "spmm",
    f"WITH {v.SUPPLIER_PARTS}, {v.PART_LINES}, a AS (SELECT \"row\", col, sum(value) AS value FROM supplier_parts GROUP BY 1, 2),"
    " b AS (SELECT \"row\", col, sum(value) AS value FROM part_lines GROUP BY 1, 2)"
    " SELECT a.\"row\" AS \"row\", b.col AS col, CAST(sum(a.value * b.value) AS DOUBLE) AS value FROM a JOIN b ON a.col = b.\"row\" GROUP BY 1, 2",
)
def _(t):
    product = matrix.spmm(v.supplier_parts(t), v.part_lines(t))
    return product.select("row", "col", F.col("value").cast("double").alias("value"))


@query(
    "spmv",
    f"WITH {v.ORDER_PARTS}, {v.PART_PRICES}, s AS (SELECT \"row\" AS i, sum(value * x) AS s FROM order_parts JOIN part_prices ON col = i GROUP BY 1)"
    " SELECT o_orderkey AS i, round(2.0 * o_totalprice + coalesce(0.5 * CAST(s AS DOUBLE), 0.0), 4) AS y FROM orders LEFT JOIN s ON o_orderkey = i",
)
def _(t):
    y = t.orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))
    return matrix.spmv(v.order_parts(t), v.part_prices(t), y, 0.5, 2.0).select("i", rounded("y", 4).alias("y"))


@query(
    "sparse_axpy",
    "WITH terms AS (SELECT o_custkey AS i, 3 * CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders"
    " UNION ALL SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer)"
    " SELECT i, CAST(sum(value) AS DOUBLE) AS value FROM terms GROUP BY 1",
)
def _(t):
    x = t.orders.select(F.col("o_custkey").alias("i"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    y = t.customer.select(F.col("c_custkey").alias("i"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"))
    return matrix.sparse_axpy(x, y, 3).select("i", F.col("value").cast("double").alias("value"))


_SOLUTION = (
    f"WITH {v.PRICE_FIT}, x2 AS (SELECT *, e2/u22 AS x2 FROM step4), x1 AS (SELECT *, (c1 - u12*x2)/u11 AS x1 FROM x2),"
    " x0 AS (SELECT *, (b0 - a01*x1 - a02*x2)/a00 AS x0 FROM x1)"
    " SELECT system_id, CAST(0 AS BIGINT) AS \"row\", round(x0, 3) + 0.0 AS x FROM x0 UNION ALL SELECT system_id, 1, round(x1, 3) + 0.0 FROM x0"
    " UNION ALL SELECT system_id, 2, round(x2, 3) + 0.0 FROM x0"
)


@query("solve", _SOLUTION)
def _(t):
    a, b = v.price_fit(t)
    return systems.solve(a, b).select("system_id", "row", rounded("x", 3).alias("x"))


@query("solve_with_pivoting", _SOLUTION)
def _(t):
    a, b = v.price_fit(t)
    # every coordinate appears twice; the later entry is the one that counts
    versions = F.array(F.struct((F.col("value") + 1).alias("value"), F.lit(0).alias("ord")), F.struct("value", F.lit(1).alias("ord")))
    repeated = a.select("system_id", "row", "col", F.inline(versions))
    return systems.solve(repeated, b, "partial", "ord").select("system_id", "row", rounded("x", 3).alias("x"))


_LU_CELLS = (
    "('U', 0, 0, a00), ('U', 0, 1, a01), ('U', 0, 2, a02), ('U', 1, 1, u11), ('U', 1, 2, u12), ('U', 2, 2, u22),"
    " ('L', 1, 0, l10), ('L', 2, 0, l20), ('L', 2, 1, l21)"
)
_LU_FILL = (
    ", ('L', 0, 0, 1.0), ('L', 1, 1, 1.0), ('L', 2, 2, 1.0), ('L', 0, 1, 0.0), ('L', 0, 2, 0.0), ('L', 1, 2, 0.0),"
    " ('U', 1, 0, 0.0), ('U', 2, 0, 0.0), ('U', 2, 1, 0.0)"
)


def _lu_sql(cells: str, part: str) -> str:
    return (
        f"WITH {v.PRICE_FIT} SELECT system_id, {part} CAST(r AS BIGINT) AS \"row\", CAST(c AS BIGINT) AS col, round(w, 4) + 0.0 AS value"
        f" FROM step4, LATERAL (VALUES {cells}) AS m(part, r, c, w)"
    )


@query("lu_in_place", _lu_sql(_LU_CELLS, ""))
def _(t):
    a, _b = v.price_fit(t)
    return systems.lu_in_place(a).select("system_id", "row", "col", rounded("value", 4).alias("value"))


@query("lu_factors", _lu_sql(_LU_CELLS + _LU_FILL, "part,"))
def _(t):
    a, _b = v.price_fit(t)
    return systems.lu(a).select("system_id", "part", "row", "col", rounded("value", 4).alias("value"))


# ---------------------------------------------------------------- grids


def _stencil_sql(ctes: str, table: str, weights: dict, value: str) -> str:
    cells = ", ".join(f"({dr}, {dc}, {w})" for (dr, dc), w in sorted(weights.items()))
    return (
        f"WITH {ctes}, k(dr, dc, w) AS (VALUES {cells}),"
        f" hits AS (SELECT g.r - k.dr AS r, g.c - k.dc AS c, sum(g.v * k.w) AS s FROM {table} g, k GROUP BY 1, 2),"
        f" g2 AS (SELECT g.r, g.c, g.v, coalesce(s, 0) AS s FROM {table} g LEFT JOIN hits h ON g.r = h.r AND g.c = h.c)"
        f" SELECT r, c, {value} AS v FROM g2"
    )


@query("one_neighbour_cells", _stencil_sql(v.BIT_GRID, "bit_grid", stencil.CROSS, "CASE WHEN s = 1 THEN 1 ELSE 0 END"))
def _(t):
    return stencil.one_neighbour_cells(v.bit_grid(t))


@query("edge_filter", _stencil_sql(v.GRID, "grid", stencil.EDGE, "CAST(least(greatest(s, 0), 255) AS INTEGER)"))
def _(t):
    return stencil.edge_filter(v.grid(t))


@query("jacobi_2d", _stencil_sql(v.GRID, "grid", stencil.FIVE_POINT, "CAST(s AS DOUBLE) / 5"))
def _(t):
    return stencil.jacobi_2d(v.grid(t))


@query(
    "neighbour_rule",
    _stencil_sql(v.BIT_GRID, "bit_grid", stencil.MOORE, "CASE WHEN s = 3 OR (v = 1 AND s = 2) THEN 1 ELSE 0 END"),
)
def _(t):
    return stencil.neighbour_rule(v.bit_grid(t))


@query(
    "jacobi_1d",
    f"WITH {v.VEC} SELECT i, round((coalesce(lag(x) OVER (ORDER BY i), 0) + x + coalesce(lead(x) OVER (ORDER BY i), 0)) / 3, 6) AS y FROM vec",
)
def _(t):
    return stencil.jacobi_1d(v.vec(t)).select("i", rounded("y", 6).alias("y"))


# ---------------------------------------------------------------- points

# a point is a hull vertex when all others fit into less than a half turn around it
_HULL = (
    f"{v.PTS}, u AS (SELECT DISTINCT GROUPED x, y FROM pts),"
    " turns AS (SELECT GROUPA p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS a FROM u p JOIN u q ON JOINED (p.x <> q.x OR p.y <> q.y)),"
    " gaps AS (SELECT GROUPED x, y, lead(a) OVER (PARTITION BY GROUPED x, y ORDER BY a) - a AS g,"
    " 2 * pi() - (max(a) OVER (PARTITION BY GROUPED x, y) - min(a) OVER (PARTITION BY GROUPED x, y)) AS wrap FROM turns),"
    " corners AS (SELECT GROUPED x, y FROM gaps GROUP BY ALL HAVING greatest(max(g), max(wrap)) > pi())"
)


def _hull_sql(grouped: bool) -> str:
    g, p, j = ("label,", "p.label,", "p.label = q.label AND") if grouped else ("", "", "")
    return _HULL.replace("GROUPED", g).replace("GROUPA", p).replace("JOINED", j)


_RING = (
    ", ring AS (SELECT GROUPED x, y, row_number() OVER (PARTITION BY PARTS ORDER BY atan2(y - cy, x - cx)) AS n,"
    " count(*) OVER (PARTITION BY PARTS) AS m FROM (SELECT *, avg(x) OVER (PARTITION BY PARTS) AS cx, avg(y) OVER (PARTITION BY PARTS) AS cy FROM corners))"
)


@query("convex_hull", f"WITH {_hull_sql(False)} SELECT x, y FROM corners")
def _(t):
    return geometry.convex_hull(v.pts(t))


@query("convex_hull_by_label", f"WITH {_hull_sql(True)} SELECT label, x, y FROM corners")
def _(t):
    return geometry.convex_hull(v.pts(t), ["label"])


@query(
    "hull_perimeter",
    f"WITH {_hull_sql(False)}{_RING.replace('GROUPED', '').replace('PARTS', '1')}"
    " SELECT round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS perimeter"
    " FROM ring a JOIN ring b ON b.n = a.n % a.m + 1",
)
def _(t):
    return geometry.hull_perimeter(v.pts(t)).select(rounded("perimeter", 6).alias("perimeter"))


@query(
    "hull_perimeter_by_label",
    f"WITH {_hull_sql(True)}{_RING.replace('GROUPED', 'label,').replace('PARTS', 'label')}"
    " SELECT a.label, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS perimeter"
    " FROM ring a JOIN ring b ON a.label = b.label AND b.n = a.n % a.m + 1 GROUP BY 1",
)
def _(t):
    return geometry.hull_perimeter(v.pts(t), ["label"]).select("label", rounded("perimeter", 6).alias("perimeter"))


@query(
    "smallest_triangle",
    f"WITH {v.PTS} SELECT a.label, round(min(0.5 * abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))), 9) AS area"
    " FROM pts a JOIN pts b ON a.label = b.label AND a.i < b.i JOIN pts c ON b.label = c.label AND b.i < c.i GROUP BY 1",
)
def _(t):
    return geometry.smallest_triangle(v.pts(t), ["label"]).select("label", rounded("area", 9).alias("area"))


@query(
    "closest_pair",
    f"WITH {v.OPTS} SELECT round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM opts a JOIN opts b ON a.i < b.i",
)
def _(t):
    return geometry.closest_pair(v.opts(t)).select(rounded("distance", 6).alias("distance"))


@query(
    "closest_pair_of_embeddings",
    f"WITH {v.PTS} SELECT round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 9) AS distance FROM pts a JOIN pts b ON a.i < b.i",
)
def _(t):
    return geometry.closest_pair(v.pts(t)).select(rounded("distance", 9).alias("distance"))


@query(
    "closest_pair_1d",
    f"WITH {v.PTS}, d AS (SELECT x - lag(x) OVER (ORDER BY x, i) AS d FROM pts) SELECT round(min(d), 9) AS distance FROM d",
)
def _(t):
    return geometry.closest_pair_1d(v.pts(t)).select(rounded("distance", 9).alias("distance"))


# ---------------------------------------------------------------- graphs


@query("edge_count", f"WITH {v.TRADE} SELECT count(*) FILTER (WHERE a = 1) AS result FROM trade")
def _(t):
    return graph.edge_count(v.trade(t))


@query(
    "max_degree",
    f"WITH {v.TRADE}, d AS (SELECT src, sum(a) AS d FROM trade GROUP BY 1) SELECT CAST(greatest(coalesce(max(d), 0), 0) AS BIGINT) AS result FROM d",
)
def _(t):
    return graph.max_degree(v.trade(t))


def _labels_sql(edges: str, vertices: str, ctes: str) -> str:
    return (
        f"WITH RECURSIVE {ctes}, both_ways AS (SELECT DISTINCT src, dst FROM {edges} UNION SELECT DISTINCT dst, src FROM {edges}),"
        f" reach(id, label) AS (SELECT id, id FROM {vertices} UNION"
        " SELECT e.dst, r.label FROM reach r JOIN both_ways e ON e.src = r.id WHERE r.label < e.dst),"
        " labels AS (SELECT id, min(label) AS component FROM reach GROUP BY 1)"
    )


_FOREST = _labels_sql("purchases", "buyers", f"{v.PURCHASES}, {v.BUYERS}")
_TRADE = _labels_sql("trade", "traders", f"{v.TRADE}, {v.TRADERS}")


@query("component_labels", f"{_FOREST} SELECT id, component FROM labels")
def _(t):
    return graph.component_labels(v.purchases(t), v.buyers(t))


@query("largest_component", f"{_TRADE}, sizes AS (SELECT count(*) AS n FROM labels GROUP BY component) SELECT max(n) AS result FROM sizes")
def _(t):
    return graph.largest_component(v.trade(t), v.traders(t))


@query("component_count", f"{_FOREST} SELECT count(DISTINCT component) AS result FROM labels")
def _(t):
    return graph.component_count(v.purchases(t), v.buyers(t))


_WAVES = ", ".join(
    f"w{d + 1} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM w{d} JOIN both_ways ON src = id)" for d in range(6)
)
_HITS = " ".join(f"WHEN EXISTS (SELECT 1 FROM w{d} WHERE id = -1) THEN {d}" for d in range(7))


@query(
    "hop_distance",
    f"WITH {v.TRADE}, both_ways AS MATERIALIZED (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade), w0 AS (SELECT CAST(0 AS BIGINT) AS id), {_WAVES}"
    f" SELECT CAST(CASE {_HITS} ELSE 2147483647 END AS BIGINT) AS result",
)
def _(t):
    trade = v.trade(t)
    both = trade.select("src", "dst").union(trade.select("dst", "src"))
    return graph.hop_distance(both, 0, -1)


# ---------------------------------------------------------------- spectra

_SIZED = v.SERIES + ", sized AS (SELECT user_id, max(n) + 1 AS len, CAST(SIZE AS BIGINT) AS size FROM series GROUP BY 1)"
_PLAIN_SIZE = _SIZED.replace("CAST(SIZE AS BIGINT)", "CAST(max(n) + 1 AS BIGINT)")
_POW2_SIZE = _SIZED.replace("CAST(SIZE AS BIGINT)", "CAST(2 ** ceil(log2(max(n) + 1)) AS BIGINT)")


def _dft_sql(ctes: str, re: str, im: str, sign: str, scale: str = "1", names: tuple[str, str] = ("re", "im"), conj: str = "") -> str:
    """Direct transform: every sample meets every frequency of its own series."""
    return (
        f"WITH {ctes}, f AS (SELECT user_id, size, unnest(range(size)) AS k FROM sized),"
        f" w AS (SELECT f.user_id, f.k, {re} AS a, {im} AS b, {sign} 2 * pi() * ((s.n * f.k) % f.size) / f.size AS t, f.size"
        " FROM f JOIN series s ON f.user_id = s.user_id)"
        f" SELECT user_id, k, round(sum(a * cos(t) - b * sin(t)) / {scale}, 3) + 0.0 AS {names[0]},"
        f" round({conj} sum(a * sin(t) + b * cos(t)) / {scale}, 3) + 0.0 AS {names[1]} FROM w GROUP BY user_id, k, size"
    )


def _spectrum(df, re: str = "re", im: str = "im"):
    return df.select("user_id", "k", rounded(re, 3).alias(re), rounded(im, 3).alias(im))


@query("dft", _dft_sql(_PLAIN_SIZE, "s.re", "0.0", "-"))
def _(t):
    return _spectrum(spectral.dft(v.series(t), ["user_id"]))


@query("fft", _dft_sql(_POW2_SIZE, "s.re", "s.im", "-"))
def _(t):
    return _spectrum(spectral.fft(v.series(t), ["user_id"], pad=True))


@query("fft_four_step", _dft_sql(_POW2_SIZE, "s.re", "s.im", "-"))
def _(t):
    return _spectrum(spectral.fft(v.series(t), ["user_id"], pad=True, whole_series=1))


@query("dft_chirp", _dft_sql(_PLAIN_SIZE, "s.re", "0.0", "-"))
def _(t):
    return _spectrum(spectral.dft(v.series(t), ["user_id"], whole_series=1))


@query("fft_conjugate", _dft_sql(_POW2_SIZE, "s.re", "s.im", "-", conj="-"))
def _(t):
    return _spectrum(spectral.fft_conjugate(v.series(t), ["user_id"], pad=True))


@query("fft_split", _dft_sql(_POW2_SIZE, "s.re", "s.im", "-", names=("r", "i")))
def _(t):
    return _spectrum(spectral.fft_split(v.series(t), ["user_id"], pad=True), "r", "i")


@query("inverse_fft", _dft_sql(_POW2_SIZE, "s.re", "s.im", "+", names=("re_sum", "im_sum")))
def _(t):
    # shown before the division by the length: the quotients of two-digit values would sit on rounding ties
    back = spectral.inverse_fft(v.series(t), ["user_id"], pad=True)
    return back.select(
        "user_id", "k", rounded(F.col("re") * F.col("size"), 3).alias("re_sum"), rounded(F.col("im") * F.col("size"), 3).alias("im_sum")
    )


@query("fft_of_all_events")
def _(t):
    """One series over the whole table, split over many tasks."""
    one = v.vec(t).select(F.lit(0).alias("s"), F.col("i").alias("n"), F.col("x").alias("re"))
    return spectral.fft(one, ["s"], pad=True, whole_series=1).select("k", rounded("re", 2).alias("re"), rounded("im", 2).alias("im"))


# ---------------------------------------------------------------- comparisons


@query(
    "vectors_close",
    f"WITH {v.VEC} SELECT count(*) FILTER (WHERE abs(x - round(x, 1)) > 0.051) = 0 AS equal FROM vec",
)
def _(t):
    x = v.vec(t)
    return compare.close_to(x, x.withColumn("x", F.round("x", 1)), ["i"], "x", 0.051)


@query(
    "matrices_equal",
    f"WITH {v.SUPPLIER_PARTS}, a AS (SELECT \"row\" AS r, col, sum(value) AS x, count(*) AS n FROM supplier_parts GROUP BY 1, 2)"
    " SELECT count(*) FILTER (WHERE 0.001 * n > 0.0015) = 0 AS equal FROM a",
)
def _(t):
    """Quantities against quantities that are 0.001 larger per order line: repeated coordinates exceed the tolerance."""
    a = v.supplier_parts(t)
    larger = a.withColumn("value", F.col("value") + F.lit(0.001).cast("decimal(4,3)"))
    return compare.coo_equal(matrix.add_duplicates(a), matrix.add_duplicates(larger), 0.0015)


@query(
    "point_sets_equal",
    f"WITH {v.PTS}, a AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS n FROM pts),"
    " b AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS n FROM (SELECT round(x, 4) AS x, y FROM pts))"
    " SELECT count(*) FILTER (WHERE abs(a.x - b.x) > 0.0001 OR abs(a.y - b.y) > 0.0001) = 0 AS equal FROM a JOIN b USING (n)",
)
def _(t):
    """Points against rounded points: rounding changes the sorted pairing where two points nearly share x."""
    pts = v.pts(t)
    return compare.point_sets_equal(pts, pts.withColumn("x", F.round("x", 4)), 1e-4)


@query(
    "vectors_with_nan",
    f"WITH {v.VEC}, n AS (SELECT i, x, CASE WHEN i % 97 = 5 THEN 'nan'::DOUBLE ELSE x END AS y FROM vec)"
    " SELECT 'nan' AS kind, count(*) FILTER (WHERE isnan(y) OR abs(x - y) > 0.001) = 0 AS equal FROM n"
    " UNION ALL SELECT 'none', count(*) FILTER (WHERE isnan(y) OR abs(x - y) > 0.001) = 0 FROM n WHERE i % 97 <> 5"
    " UNION ALL SELECT 'both', count(*) FILTER (WHERE isnan(y) OR abs(x - y) > 0.001) = 0 FROM n WHERE i % 97 = 5",
)
def _(t):
    """A NaN is close to nothing, not even to a NaN at the same place."""
    x = v.vec(t)
    y = x.withColumn("x", F.when(F.col("i") % 97 == 5, float("nan")).otherwise(F.col("x")))
    cases = {"nan": (x, y), "none": (x.where("i % 97 <> 5"), y.where("i % 97 <> 5")), "both": (y.where("i % 97 = 5"), y.where("i % 97 = 5"))}
    rows = [compare.close_to(a, b, ["i"], "x", 0.001).select(F.lit(kind).alias("kind"), "equal") for kind, (a, b) in cases.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    "repeated_points_equal",
    "WITH a AS (SELECT user_id % 3 AS x, 0.5 AS y FROM events) SELECT 'same' AS kind, true AS equal FROM (SELECT 1)"
    " UNION ALL SELECT 'one less', (SELECT count(*) FROM events WHERE event_id > (SELECT min(event_id) FROM events)) = (SELECT count(*) FROM a)",
)
def _(t):
    """Three points that repeat as often as there are events."""
    points = lambda df: df.select((F.col("user_id") % 3).cast("double").alias("x"), F.lit(0.5).alias("y"))
    first = t.events.agg(F.min("event_id")).scalar()
    less = compare.point_sets_equal(points(t.events), points(t.events.where(F.col("event_id") > first)))
    same = compare.point_sets_equal(points(t.events), points(t.events.repartition(3)))
    return same.select(F.lit("same").alias("kind"), "equal").union(less.select(F.lit("one less"), "equal"))


# ---------------------------------------------------------------- folds and scans with a function of the user's own

_PRIME = 1_000_003


def _maps(t):
    """An affine map per event: x -> a x + b modulo a prime."""
    return t.events.select(
        "event_type", F.col("event_id").alias("i"), (F.col("value").cast("bigint") % 1009 + 2).alias("a"), (F.col("user_id") % 1013).cast("bigint").alias("b")
    )


_MAPS = "maps AS (SELECT event_type, event_id AS i, CAST(trunc(value) AS BIGINT) % 1009 + 2 AS a, CAST(user_id % 1013 AS BIGINT) AS b FROM events)"


def _compose(first, second):
    """One map after the other; the order matters."""
    return {"a": first["a"] * second["a"] % _PRIME, "b": (second["a"] * first["b"] + second["b"]) % _PRIME}


@query(
    "composed_maps",
    f"WITH {_MAPS} SELECT event_type, m.a AS a, m.b AS b FROM (SELECT event_type, list_reduce(list({{'a': a, 'b': b}} ORDER BY i),"
    f" lambda p, q: {{'a': p.a * q.a % {_PRIME}, 'b': (q.a * p.b + q.b) % {_PRIME}}}) AS m FROM maps GROUP BY 1)",
)
def _(t):
    return monoid.fold(_maps(t), "i", ["a", "b"], _compose, {"a": 1, "b": 0}, ["event_type"], bits=6)


@query(
    "running_composed_maps",
    f"WITH RECURSIVE {_MAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i) AS n FROM maps),"
    " s AS (SELECT event_type, i, n, a, b FROM n WHERE n = 1"
    f" UNION ALL SELECT n.event_type, n.i, n.n, s.a * n.a % {_PRIME}, (n.a * s.b + n.b) % {_PRIME} FROM s JOIN n ON n.event_type = s.event_type AND n.n = s.n + 1)"
    " SELECT event_type, i, a, b FROM s",
)
def _(t):
    return monoid.scan(_maps(t), "i", ["a", "b"], _compose, ["event_type"], bits=6)


@query("map_column", f"WITH {v.VEC} SELECT i, CAST(floor((x - trunc(x)) * 4) AS INTEGER) AS quarter FROM vec")
def _(t):
    return transform.map_column(v.vec(t), "x", numeric.fraction_quarter, "quarter").select("i", "quarter")
