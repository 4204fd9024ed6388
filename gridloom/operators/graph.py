"""Graph measures over ``edges(src, dst[, a])`` and ``vertices(id)``."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import INT32_MAX
from gridloom.runtime import hot_keys, repeat_rows, salted_join, spread_rows, stage, unstage

#: pairs that a task of a round writes at least, if there are so many: a round of few pairs is one small file, not one for each shuffle partition
PAIRS_A_TASK = 100_000


def edge_count(adjacency: DataFrame, a: str = "a", out: str = "result") -> DataFrame:
    """Directed edges: entries equal to 1."""
    return adjacency.agg(F.count_if(F.col(a) == 1).alias(out))


def max_degree(adjacency: DataFrame, src: str = "src", a: str = "a", out: str = "result") -> DataFrame:
    """Largest row sum, so weights add up; 0 without edges."""
    degrees = adjacency.groupBy(src).agg(F.sum(a).alias("_d"))
    return degrees.agg(F.greatest(F.coalesce(F.max("_d"), F.lit(0)), F.lit(0)).cast("bigint").alias(out))


def component_labels(
    edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int | None = None, **salting
) -> DataFrame:
    """``(id, component)``: the smallest vertex id reachable from each vertex.

    Alternating star contraction: every pair (larger, smaller) is first hung from the smallest
    neighbour of its smaller end, then from the smallest neighbour of its larger end. The pair table
    never grows, so its count bounds the tasks that write a round; rounds are logarithmic in practice, and each round is staged, which cuts the lineage
    and survives lost executors. Hub vertices are split by the salted join.
    """
    pairs = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    pairs = stage(pairs, "pairs")

    def fingerprint(df: DataFrame):
        return tuple(
            df.agg(
                F.count(F.lit(1)),
                F.bit_xor(F.xxhash64("hi", "lo")),
                F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")),
            ).first()
        )

    def meet(left: DataFrame, right: DataFrame, on: str, spread: str, how: str, rows: int) -> DataFrame:
        # the pair table never grows, so a small one cannot hold a hot key
        if rows <= salting.get("hot_rows", 1_000_000):
            return left.join(right, on, how)
        return salted_join(left, right, [on], [spread], how, **salting)

    state = fingerprint(pairs)
    tasks = max(1, -(-state[0] // PAIRS_A_TASK))
    rounds = itertools.count() if max_rounds is None else range(max_rounds)
    for _ in rounds:
        lowest = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = (
            meet(pairs, lowest.select(F.col("hi").alias("lo"), "m"), "lo", "hi", "left", state[0])
            .select("hi", F.coalesce("m", "lo").alias("lo"))
            .distinct()
        )
        # both uses below read the same contracted pairs, so they are written once
        hung = stage(hung.coalesce(tasks), "hung")
        lowest = hung.groupBy("hi").agg(F.min("lo").alias("m"))
        contracted = (
            meet(hung, lowest, "hi", "lo", "inner", state[0])
            .where(F.col("lo") > F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        last, pairs = pairs, stage(contracted.coalesce(tasks), "pairs")
        unstage(last, hung)  # a round needs the table of the round before only
        before, state = state, fingerprint(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")

    roots = pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    if vertices is None:
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        vertices = ends.distinct()
    return vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(edges: DataFrame, vertices: DataFrame, out: str = "result") -> DataFrame:
    sizes = component_labels(edges, vertices).groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.max("_n"), F.lit(0)).alias(out))


def component_count(edges: DataFrame, vertices: DataFrame, out: str = "result") -> DataFrame:
    """Components including isolated vertices: each has exactly one vertex that is its own label."""
    labels = component_labels(edges, vertices)
    return labels.agg(F.count_if(F.col("id") == F.col("component")).alias(out))


def _merged(segments: list[DataFrame], rows: list[int]) -> None:
    """Join the last segments while they are of like size: a few remain however many waves there were."""
    while len(rows) > 1 and rows[-2] <= 2 * rows[-1]:
        one = stage(segments[-2].union(segments[-1]), "visited")
        unstage(*segments[-2:])
        segments[-2:], rows[-2:] = [one], [sum(rows[-2:])]


def hop_distance(
    edges: DataFrame, source, dest, unreachable: int = INT32_MAX, max_hops: int | None = None, out: str = "result", **salting
) -> DataFrame:
    """Breadth-first hop distance over directed ``edges``; ``unreachable`` if there is no path.

    Waves start from both ends and the smaller one goes on, so each covers about half of the way. The links are written
    once in either direction, with hub vertices dealt out. A wave is staged and compared with the vertices its
    side has seen, which lie in a few segments that grow like a logarithm, and with the other side's last wave; only
    the two counts come to the driver.
    """
    spark = edges.sparkSession

    def answer(value: int) -> DataFrame:
        return spark.range(1).select(F.lit(value).cast("bigint").alias(out))

    if source == dest:
        return answer(0)
    kind = edges.schema["src"].dataType
    sides = []
    for start, near, far in ((source, "src", "dst"), (dest, "dst", "src")):
        links = edges.select(F.col(near).alias("id"), F.col(far).alias("_to")).where(F.col("id") != F.col("_to"))
        links = stage(links, "links")
        hot = stage(hot_keys(links, ["id"], **salting), "hubs")
        wave = stage(spark.range(1).select(F.lit(start).cast(kind).alias("id")), "wave")
        sides.append({"links": spread_rows(links, hot, ["id"], ["_to"]), "hot": hot, "wave": wave, "rows": 1, "seen": [wave], "sizes": [1], "hops": 0})

    try:
        while max_hops is None or sides[0]["hops"] + sides[1]["hops"] < max_hops:
            side, other = sorted(sides, key=lambda s: s["rows"])
            reached = side["links"].join(repeat_rows(side["wave"], side["hot"], ["id"]), ["id", "_slice"]).select(F.col("_to").alias("id")).distinct()
            for segment in side["seen"]:
                reached = reached.join(segment, "id", "left_anti")
            wave = stage(reached, "wave")
            met = other["wave"].select("id", F.lit(1).alias("_met"))
            rows, hits = wave.join(met, "id", "left").agg(F.count(F.lit(1)), F.count("_met")).first()
            side["hops"] += 1
            side["seen"].append(wave)
            side["sizes"].append(rows)
            # before this wave the two sides had no vertex in common, so a first meeting is a shortest path
            if hits:
                return answer(sides[0]["hops"] + sides[1]["hops"])
            if rows == 0:
                return answer(unreachable)
            side["rows"], side["wave"] = rows, wave.select("id")
            if len(side["seen"]) > 2:  # the newest segment stays as it is, the wave is read from it
                newest, size = side["seen"].pop(), side["sizes"].pop()
                _merged(side["seen"], side["sizes"])
                side["seen"].append(newest)
                side["sizes"].append(size)
        return answer(unreachable)
    finally:
        for side in sides:
            unstage(side["hot"], *side["seen"])
