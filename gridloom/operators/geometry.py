"""Plane geometry on point tables: closest pairs, smallest triangle, convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import group_id, shuffle_width, stage

#: most points of a grid cell that is joined
CELL_LIMIT = 32
FLUSH_ROWS = 100_000
#: points among which all triples are tried
CHUNK = 256
#: directions that a triangle task looks at, at least
SWEEP_WORK = 1 << 22
#: most partitions that the triangle tasks of one size are dealt to
TRIANGLE_PARTITIONS = 4096
#: most points of a hull side that one task sweeps
SIDE_ROWS = 1 << 18


def finite(*columns: str) -> Column:
    """All columns hold numbers: no null, NaN or infinity."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return test


# ---------------------------------------------------------------- closest pair


def _crowding(width: float, rows: int, dims: int) -> float | None:
    """Distance that some two of ``rows`` points in a square (or an interval) of ``width`` cannot exceed: cut into fewer
    parts than points, one part holds two."""
    parts = rows - 1 if dims == 1 else math.isqrt(rows - 1)
    return width * math.sqrt(dims) / max(parts, 1) * (1 + 1e-9)


def _spread(extents: list[float], rows: int) -> float:
    """The same for points in a box: the smallest squares of which fewer than ``rows`` cover it, to a tenth."""
    width = max(extents) * (1 + 1e-9)
    while width > 0 and math.prod(math.ceil(e / width * 1.1) or 1 for e in extents) < rows:
        width /= 1.1
    return width * math.sqrt(len(extents)) * (1 + 1e-9)


def closest_pair(
    df: DataFrame,
    coords: tuple[str, ...] = ("x", "y"),
    index: str = "i",
    out: str = "distance",
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """Distance of the closest pair (0 for fewer than two points); one or two coordinates. Points with a null, NaN or
    infinite coordinate are no points.

    The points' number and extent bound the distance, as more points than cells cannot all lie apart. In a grid of that
    width the fullest cell gives a smaller bound in the same way, and so on until no cell holds more than ``cell_limit``
    points: each round only counts cells, and a cell of m points shrinks the width by the root of m. Then points
    meet inside cells and their neighbours, which hold the closest pair for certain.
    """
    names = list(coords)
    dims = len(names)
    points = df.select(F.col(index).alias("_i"), *[F.col(c).cast("double").alias(c) for c in names]).where(finite(*names))
    spark = df.sparkSession

    def answer(value: float) -> DataFrame:
        return spark.range(1).select(F.lit(float(value)).alias(out))

    rows, *ends = points.agg(F.count(F.lit(1)), *[f(c) for c in names for f in (F.min, F.max)]).first()
    if rows < 2:
        return answer(0.0)
    lows, extents = ends[::2], [hi - lo for lo, hi in zip(ends[::2], ends[1::2])]
    extent = max(extents)
    bound = _spread(extents, rows)
    cells = [f"_g{k}" for k in range(dims)]
    known_apart = False
    while True:
        if bound == 0.0:
            return answer(0.0)
        width = max(bound, extent * 2.0**-50)  # keeps cell numbers exact; wider cells are still right
        placed = points.select("*", *[F.floor((F.col(c) - F.lit(lo)) / F.lit(width)).alias(g) for c, lo, g in zip(names, lows, cells)])
        crowd = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if crowd <= cell_limit or width > bound:
            break
        if not known_apart:  # equal points would stay together in any cell
            known_apart = True
            if points.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                return answer(0.0)
        tighter = _crowding(width, crowd, dims)
        if not tighter < bound:
            break
        bound = tighter

    if dims == 1:
        steps = [(0,), (1,)]
    else:
        steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # half of the 3x3 cells: each pair meets once
    targets = F.array(
        *[
            F.struct(*[(F.col(g) + d).alias(g) for g, d in zip(cells, step)], F.lit(not any(step)).alias("_same"))
            for step in steps
        ]
    )
    reach = placed.select(
        F.col("_i").alias("_j"), *[F.col(c).alias(f"_{c}") for c in names], F.inline(targets)
    )
    pairs = placed.join(reach, cells).where(~F.col("_same") | (F.col("_i") < F.col("_j")))
    square = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in names)
    return pairs.agg(F.sqrt(F.min(square)).alias(out))


def closest_pair_1d(df: DataFrame, x: str = "x", index: str = "i", out: str = "distance") -> DataFrame:
    """Smallest gap between values (0 for fewer than two). NaN and null are no values.

    One range exchange on (value, position); each partition reports its first and last value and its
    smallest gap, and only those few rows meet in a final window.
    """
    ordered = df.select(F.col(x).cast("double").alias("x"), F.col(index).alias("i"))
    ordered = ordered.where(F.col("x").isNotNull() & ~F.isnan("x"))
    ordered = ordered.repartitionByRange("x", "i").sortWithinPartitions("x", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = high = None
        gap, rows = np.inf, 0
        for batch in batches:
            xs = batch["x"].to_numpy()
            if not len(xs):
                continue
            chain = xs if high is None else np.concatenate([[high], xs])
            if len(chain) > 1:
                gap = min(gap, float(np.diff(chain).min()))
            low = xs[0] if low is None else low
            high, rows = xs[-1], rows + len(xs)
        if rows:
            yield pd.DataFrame({"low": [low], "high": [high], "gap": [gap], "rows": [rows]})

    parts = ordered.mapInPandas(run, "low double, high double, gap double, rows bigint")
    by_value = Window.orderBy("low", "high")  # one row per partition
    seams = parts.withColumn("seam", F.col("low") - F.lag("high").over(by_value))
    closest = F.least(F.min("gap"), F.min("seam"))
    return seams.agg(F.when(F.coalesce(F.sum("rows"), F.lit(0)) < 2, 0.0).otherwise(closest).alias(out))


# ---------------------------------------------------------------- smallest triangle


def _area(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Areas of triangles; the last axis holds x and y."""
    u, v = q - p, r - p
    return 0.5 * np.abs(u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0])


def _smallest_of_all(xy: np.ndarray) -> float:
    """Every triple of a few points."""
    best = np.inf
    for i in range(len(xy) - 2):
        u = xy[i + 1 :] - xy[i]
        products = np.outer(u[:, 0], u[:, 1])
        area = np.abs(products - products.T)
        np.fill_diagonal(area, np.inf)
        best = min(best, 0.5 * float(area.min()))
    return best


def _smallest_at(xy: np.ndarray, corners: np.ndarray, low: float, best: float) -> float:
    """Smallest triangle among those whose longest side is at least ``low`` and starts at one of ``corners`` (positions in
    ``xy``), if it is smaller than ``best``.

    One end of the longest side is at least half that side away from the third corner. Seen from there, the two other
    corners lie in nearly one direction, the closer the smaller the triangle is. So directions are sorted around each
    corner, and only those that close to each other are tried. Before, the points are stretched to equal spread on all
    sides, which scales all areas alike: else points near a line would all lie in nearly one direction.
    """
    away = xy - xy.mean(axis=0)
    _, spread, axes = np.linalg.svd(away, full_matrices=False)
    spread = np.maximum(spread, spread[0] * 2.0**-27)  # flatter points have a triangle at rounding level
    x, y = np.ascontiguousarray((away @ axes.T / spread).T)
    least = low / spread[0] * (1 - 1e-9)
    noise = 20 * 1e-15 * float(np.abs(away).max()) / spread[1] / least + 1e-14
    # a direction as a whole number from 0 to 2 * unit for half a turn, followed by the position of its point
    bits = len(xy).bit_length()
    unit = 1 << (61 - bits)

    def reach() -> int:
        sine = 4 * best / (spread[0] * spread[1]) / least**2
        return int(min(math.asin(min(sine, 1.0)) * (1 + 1e-9) + noise, 2.0) * unit) + 2

    number, mask = np.arange(len(xy)), (1 << bits) - 1
    dx, dy, size, keys = np.empty(len(xy)), np.empty(len(xy)), np.empty(len(xy)), np.empty(len(xy), np.int64)
    for p in corners:
        np.subtract(x, x[p], out=dx)
        np.subtract(y, y[p], out=dy)
        dx[p] = 1.0  # the corner itself is taken out below
        # dx / (|dx| + |dy|), from 1 to -1 on the upper half of a turn; the lower half is turned round
        np.add(np.abs(dx), np.abs(dy, out=size), out=size)
        np.divide(dx, size, out=dx)
        np.multiply(dx, np.copysign(unit, dy, out=dy), out=dx)
        np.subtract(unit, dx, out=dx)
        keys[:] = dx
        keys <<= bits
        keys |= number
        keys[p] = -1
        around = np.sort(keys)[1:]
        turn, near = around >> bits, reach()
        again = np.searchsorted(turn, turn[-1] - 2 * unit + near, "right")  # half a turn on, directions start again
        if again:
            around, turn = np.concatenate([around, around[:again]]), np.concatenate([turn, turn[:again] + 2 * unit])
        for far in range(1, len(xy) - 1):
            first = np.flatnonzero(turn[far:] - turn[:-far] <= near)
            if not len(first):
                break
            q, r = around[first] & mask, around[first + far] & mask
            area = _area(xy[p], xy[q], xy[r])
            if again:
                area = area[q != r]
            found = float(area.min(initial=np.inf))
            if found < best:
                best = found
                near = reach()
    return best


def smallest_triangle(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y", index: str = "i", out: str = "area", chunk: int = CHUNK
) -> DataFrame:
    """Smallest triangle area per group, of which null is one (0 for fewer than three points or if two are equal).
    Points with a null, NaN or infinite coordinate are no points.

    Nearly collinear points may lie far apart, so cells alone cannot prune. Runs of points in the order of x give a first
    small triangle. Then triangles are sought by size, the longest sides first: at first among all points of a group, then in
    overlapping blocks of two cells a side, and so on. All triples of a block of up to ``chunk`` points are tried. In a
    larger block directions are sorted around each point (see ``_smallest_at``), down to the side for which a triangle no
    larger than the smallest known still tells few directions apart: the next cells are that wide, and points that are
    evenly spread need no third size. The work is about quadratic in the points of a block, and its points are dealt to
    many tasks; a task holds the coordinates of its block.
    """
    chunk = max(chunk, 3)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], group_id(keys).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    groups = rows.select(*[F.col(f"`{k}`") for k in keys], "_g").distinct()
    points = stage(rows.where(finite("_x", "_y")).groupBy("_g", "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "points")

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All triples of short runs in the order of x: some small triangles."""
        run = max(3, chunk // 2)
        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                xy = part[["_x", "_y"]].to_numpy()
                areas = [_smallest_of_all(xy[k : k + run]) for k in range(0, len(xy) - 2, run)]
                if areas:
                    yield pd.DataFrame({"_g": [g], "_area": [min(areas)]})

    extent = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"))
    info = points.groupBy("_g").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), extent.alias("_width"),
        F.var_pop("_x").alias("_xx"), F.var_pop("_y").alias("_yy"), F.covar_pop("_x", "_y").alias("_xy"),
    ).where("_rows >= 3")
    start = F.when(F.col("_m") < F.col("_rows"), 0.0).otherwise(F.col("_width") * F.col("_width") / 2)
    # variances along and across the points
    wide = (F.col("_xx") + F.col("_yy")) / 2 + F.hypot((F.col("_xx") - F.col("_yy")) / 2, F.col("_xy"))
    flat = F.greatest(F.try_divide(F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy"), wide), wide * 2.0**-54)
    stretch = (F.log2(wide) - F.log2(flat)) / 2
    info = info.select("_g", "_m", "_x0", "_y0", "_width", stretch.alias("_stretch"), start.alias("_best"), F.lit(0).alias("_depth"))
    info = stage(info, "groups")
    large = info.where((F.col("_best") > 0) & (F.col("_m") > chunk)).select("_g")
    if not large.isEmpty():
        ordered = points.join(large, "_g", "left_semi").select("_g", "_x", "_y")
        ordered = ordered.repartitionByRange("_g", "_x", "_y").sortWithinPartitions("_g", "_x", "_y")
        some = ordered.mapInPandas(neighbours, "_g string, _area double").groupBy("_g").agg(F.min("_area").alias("_area"))
        info = stage(info.join(some, "_g", "left").withColumn("_best", F.least("_best", "_area")).drop("_area"), "groups")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            areas = []
            for xs, ys, part, parts, low, best in zip(*[batch[c] for c in ("_x", "_y", "_part", "_parts", "_low", "_best")]):
                xy = np.column_stack([xs, ys])
                if len(xy) <= chunk:
                    areas.append(_smallest_of_all(xy))
                    continue
                xy = xy[np.lexsort((xy[:, 1], xy[:, 0]))]  # all tasks of a block cut it alike
                corners = np.random.default_rng(5).permutation(len(xy))[part::parts]
                areas.append(_smallest_at(xy, corners, low, best))
            yield pd.DataFrame({"_g": batch["_g"], "_area": np.array(areas, float)})

    live, found = points.select("_g", "_x", "_y"), None
    while True:
        # areas at rounding level are not told apart any further
        unsettled = F.col("_best") > F.lit(2.0**-50) * F.col("_width") * F.col("_width")
        size = F.col("_width") / F.pow(F.lit(2.0), "_depth")
        # at a side of sqrt(2 * best * points * stretch) a corner tells directions apart as finely as it sees points
        least = (1 + F.log2("_best") + F.log2("_m") + F.col("_stretch")) / 2
        step = F.greatest(F.lit(1), F.least(F.floor(F.log2(size) - least), 26 - F.col("_depth"))).cast("int")
        info = info.withColumn("_step", F.when(unsettled, step).otherwise(1))
        low = size / F.pow(F.lit(2.0), "_step")
        # points of two cells may be told apart wrongly by the rounding of their distance from the edge
        low = F.greatest(low * (1 - 1e-9) - F.col("_width") * 2.0**-50, low / 2)
        todo = info.where(unsettled).withColumns({"_size": size, "_low": low})
        many = F.col("_m").cast("double")
        parts = F.when(F.col("_m") <= chunk, 1).otherwise(F.ceil(many * many / F.greatest(F.lit(SWEEP_WORK), 2048 * many))).cast("int")
        if found is None:
            sizes = todo
            placed = live.join(todo, "_g").withColumns({"_bx": F.lit(0).cast("bigint"), "_by": F.lit(0).cast("bigint")})
        else:
            cell = lambda c, lo: F.least(F.floor((F.col(c) - F.col(lo)) / F.col("_size")), F.pow(F.lit(2.0), "_depth").cast("bigint") - 1)
            cx, cy = cell("_x", "_x0"), cell("_y", "_y0")
            blocks = F.array(*[F.struct((cx - a).alias("_bx"), (cy - b).alias("_by")) for a in (0, 1) for b in (0, 1)])
            placed = live.join(todo.drop("_m"), "_g").select("*", F.inline(blocks))
            sizes = stage(placed.groupBy("_g", "_bx", "_by").agg(F.count(F.lit(1)).alias("_m")).where("_m >= 3"), "blocks")
            placed = placed.join(sizes, ["_g", "_bx", "_by"])
        crowd, tasks = sizes.agg(F.max("_m"), F.sum(F.when(F.col("_m") > chunk, parts))).first()
        if crowd is None:
            break
        # a block travels as one row for each of its tasks
        packed = placed.groupBy("_g", "_bx", "_by", "_low", "_best", "_m").agg(F.collect_list("_x").alias("_x"), F.collect_list("_y").alias("_y"))
        dealt = packed.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        if tasks:
            dealt = dealt.repartition(min(max(2 * tasks, shuffle_width(df.sparkSession)), TRIANGLE_PARTITIONS), "_g", "_bx", "_by", "_part")
        deeper = crowd > chunk
        last, found = found, dealt.mapInPandas(search, "_g string, _area double").groupBy("_g").agg(F.min("_area").alias("_found"))
        if deeper or last is not None:
            found = stage(found, "triangles")
        if deeper:
            crowded = live.join(todo.where(F.col("_m") > chunk).select("_g"), "_g", "left_semi") if last is None else placed.where(F.col("_m") > chunk)
            live = stage(crowded.select("_g", "_x", "_y").distinct(), "live")
        info = info.join(found, "_g", "left").withColumns({"_best": F.least("_best", "_found"), "_depth": F.col("_depth") + F.col("_step")})
        info = info.drop("_found", "_step")
        if not deeper:
            break
        info = stage(info, "groups")
    area = info.select("_g", F.col("_best").alias(out))
    return groups.join(area, "_g", "left").select(*[F.col(f"`{k}`") for k in keys], F.coalesce(out, F.lit(0.0)).alias(out))


# ---------------------------------------------------------------- convex hull


def _chain(xy: np.ndarray) -> np.ndarray:
    """Left-turning chain through points in sweep order; collinear points are dropped."""
    kept: list[np.ndarray] = []
    for p in xy:
        while len(kept) > 1:
            u, v = kept[-1] - kept[-2], p - kept[-2]
            if u[0] * v[1] - u[1] * v[0] > 0:
                break
            kept.pop()
        kept.append(p)
    return np.array(kept)


def _corners(xy: np.ndarray) -> np.ndarray:
    """Hull vertices of one batch."""
    xy = np.unique(xy, axis=0)  # sorted by x, then y
    if len(xy) < 3:
        return xy
    return np.unique(np.vstack([_chain(xy), _chain(xy[::-1])]), axis=0)


def _batch_hulls(points: DataFrame) -> DataFrame:
    """Drop points inside the hull of what their own task has seen; memory per task is bounded."""

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [
            pd.DataFrame(_corners(part[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(_g=g)
            for g, part in pdf.groupby("_g", sort=False)
        ]
        return pd.concat(parts)[["_g", "x", "y"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = hulls(batch if held is None else pd.concat([held, batch]))
            if len(held) > FLUSH_ROWS:
                yield held
                held = None
        if held is not None:
            yield held

    return points.mapInPandas(run, points.schema)


# sides of the hull, counter-clockwise: start corner, end corner, sweep direction along x
_SIDES = [("wl", "sl", 1), ("sr", "el", 1), ("eh", "nr", -1), ("nl", "wh", -1)]
_FLATS = [("sl", "sr"), ("el", "eh"), ("nr", "nl"), ("wh", "wl")]


def hull_edges(df: DataFrame, keys: list[str] | None = None, x: str = "x", y: str = "y", side_rows: int = SIDE_ROWS) -> DataFrame:
    """Edges ``(keys, x, y, next_x, next_y)`` of the strict hull, counter-clockwise, per group, of which null is one.
    Points with a null, NaN or infinite coordinate are no points.

    Tasks first discard everything inside their local hulls. The eight extreme corners of a group
    then split the survivors into four independent sides; points inside the corner polygon go. A side of more than
    ``side_rows`` points is split at the point farthest from its chord, which is a corner of the hull, and so on:
    points inside the triangle go, the others belong to one of the two new sides. Each side is swept on its own, so no
    task sees a whole group, even if all its points lie on the hull.
    """
    keys = keys or []
    by = ["_g"]
    points = df.select(group_id(keys).alias("_g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    survivors = stage(_batch_hulls(points.where(finite("x", "y"))), "survivors")
    px, py = F.col("x"), F.col("y")
    corners = survivors.groupBy(*by).agg(
        F.min(F.struct(px, py)).alias("wl"),
        F.min(F.struct(px, -py)).alias("wh"),
        F.max(F.struct(px, -py)).alias("el"),
        F.max(F.struct(px, py)).alias("eh"),
        F.min(F.struct(py, px)).alias("sl"),
        F.min(F.struct(py, -px)).alias("sr"),
        F.max(F.struct(py, -px)).alias("nl"),
        F.max(F.struct(py, px)).alias("nr"),
    )

    def at(first: str, second: str, name: str, sign: int = 1):
        """Corner struct as (x, y): the struct holds the leading axis first, the other maybe negated."""
        c = F.col(name)
        lead, other = c.getField(first), c.getField(second) * sign
        return F.struct(lead.alias("x"), other.alias("y")) if first == "x" else F.struct(other.alias("x"), lead.alias("y"))

    corners = corners.select(
        *by,
        at("x", "y", "wl").alias("wl"),
        at("x", "col2", "wh", -1).alias("wh"),
        at("x", "col2", "el", -1).alias("el"),
        at("x", "y", "eh").alias("eh"),
        at("y", "x", "sl").alias("sl"),
        at("y", "col2", "sr", -1).alias("sr"),
        at("y", "col2", "nl", -1).alias("nl"),
        at("y", "x", "nr").alias("nr"),
    )

    def beyond(a: str, b: str) -> Column:
        """Twice the signed area of (a, b, point): negative outside the side from a to b."""
        ax, ay, bx, by_ = F.col(a)["x"], F.col(a)["y"], F.col(b)["x"], F.col(b)["y"]
        return (bx - ax) * (py - ay) - (by_ - ay) * (px - ax)

    def first_beyond(sides: list[tuple[str, str, Column]]) -> Column:
        side = F.lit(None).cast("bigint")
        for a, b, number in reversed(sides):
            side = F.when(beyond(a, b) < 0, number).otherwise(side)
        return side

    # sides are numbered 4 to 7, the halves of side s are 2s and 2s + 1
    numbered = first_beyond([(a, b, F.lit(4 + n).cast("bigint")) for n, (a, b, _) in enumerate(_SIDES)])
    held = survivors.join(corners, by).withColumn("_side", numbered).where(F.col("_side").isNotNull()).select(*by, "_side", "x", "y")
    ends = corners.select(*by, F.inline(F.array(*[F.struct(F.lit(4 + n).cast("bigint").alias("_side"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (a, b, _) in enumerate(_SIDES)])))
    if survivors.count() > side_rows:  # else no side can be large
        held, ends = stage(held, "held"), stage(ends, "sides")
        while True:
            crowded = held.groupBy(*by, "_side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > side_rows).select(*by, "_side")
            if crowded.isEmpty():
                break
            open_sides = stage(ends.join(crowded, [*by, "_side"]), "open")
            reach = held.join(open_sides, [*by, "_side"])
            # of equally far points the lowest is an end of an edge
            apex = reach.groupBy(*by, "_side").agg(F.min_by(F.struct("x", "y"), F.struct(beyond("a", "b").alias("d"), "x", "y")).alias("c"))
            split = stage(open_sides.join(apex, [*by, "_side"]), "split")
            halves = first_beyond([("a", "c", F.col("_side") * 2), ("c", "b", F.col("_side") * 2 + 1)])
            moved = held.join(split, [*by, "_side"]).withColumn("_half", halves).where("_half IS NOT NULL")
            rest = held.join(split, [*by, "_side"], "left_anti").select(*by, "_side", "x", "y")
            held = stage(rest.unionByName(moved.select(*by, F.col("_half").alias("_side"), "x", "y")), "held")
            new = split.select(*by, F.inline(F.array(
                F.struct((F.col("_side") * 2).alias("_side"), F.col("a").alias("a"), F.col("c").alias("b")),
                F.struct((F.col("_side") * 2 + 1).alias("_side"), F.col("c").alias("a"), F.col("b").alias("b")),
            )))
            ends = stage(ends.join(split, [*by, "_side"], "left_anti").unionByName(new), "sides")
    ends = ends.select(*by, "_side", F.inline(F.array("a", "b")))

    def sweep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = int(key[1])
        side >>= side.bit_length() - 3
        xy = np.unique(pdf[["x", "y"]].to_numpy(), axis=0)[:: _SIDES[side - 4][2]]
        chain = _chain(xy)
        edges = pd.DataFrame(np.hstack([chain[:-1], chain[1:]]), columns=["x", "y", "next_x", "next_y"])
        edges["_g"] = key[0]
        return edges[["_g", "x", "y", "next_x", "next_y"]]

    sides = held.unionByName(ends).groupBy(*by, "_side").applyInPandas(sweep, "_g string, x double, y double, next_x double, next_y double")
    flats = corners.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(a)["x"].alias("x"),
                        F.col(a)["y"].alias("y"),
                        F.col(b)["x"].alias("next_x"),
                        F.col(b)["y"].alias("next_y"),
                    )
                    for a, b in _FLATS
                ]
            )
        ),
    ).where((F.col("x") != F.col("next_x")) | (F.col("y") != F.col("next_y")))
    edges = sides.unionByName(flats)
    if not keys:
        return edges.drop("_g")
    names = df.select(*[F.col(f"`{k}`") for k in keys], group_id(keys).alias("_g")).distinct()
    return edges.join(names, "_g").select(*[F.col(f"`{k}`") for k in keys], "x", "y", "next_x", "next_y")


def convex_hull(df: DataFrame, keys: list[str] | None = None, x: str = "x", y: str = "y", side_rows: int = SIDE_ROWS) -> DataFrame:
    """Hull vertices per group as a set; a group of fewer than three distinct points comes back as it is."""
    edges = hull_edges(df, keys, x, y, side_rows)
    by = [F.col(f"`{k}`") for k in keys or []]
    points = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite("x", "y"))
    lowest = points.groupBy(*by).agg(F.min(F.struct("x", "y")).alias("_p")).where("_p IS NOT NULL").select(*by, "_p.*")  # always a vertex
    return edges.select(*by, "x", "y").unionByName(lowest).distinct()


def hull_perimeter(
    df: DataFrame, keys: list[str] | None = None, x: str = "x", y: str = "y", out: str = "perimeter", side_rows: int = SIDE_ROWS
) -> DataFrame:
    """Perimeter of the hull per group; 0 for fewer than three points."""
    by = [F.col(f"`{k}`") for k in keys or []]
    edges = hull_edges(df, keys, x, y, side_rows).select(
        *by, F.hypot(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")).alias("_len"), F.lit(0).alias("_n")
    )
    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sizes = points.groupBy(*by).agg(F.count_if(finite("_x", "_y")).alias("_n")).select(*by, F.lit(0.0).alias("_len"), "_n")
    return (
        edges.unionByName(sizes)
        .groupBy(*by)
        .agg(F.when(F.sum("_n") >= 3, F.sum("_len")).otherwise(0.0).alias(out))
    )
