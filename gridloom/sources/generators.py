"""Random inputs made on the executors, for trials at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.index import rank_rows
from gridloom.operators.matrix import gemv
from gridloom.runtime import stage


def uniform(low: float, high: float, seed: int, integer: bool = False) -> Column:
    """Integers in [low, high), doubles in [low, high]."""
    value = F.rand(seed) * (high - low) + low
    return F.floor(value).cast("bigint") if integer else value


def random_vector(spark: SparkSession, n: int, low: float, high: float, seed: int = 1, integer: bool = False) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), uniform(low, high, seed, integer).alias("x"))


def random_strings(spark: SparkSession, n: int, low: int, high: int, seed: int = 1) -> DataFrame:
    """Lowercase words with a length in [low, high)."""
    length = uniform(low, high, seed, integer=True).cast("int")
    # a hash per letter: a lambda must not hold a random expression
    letter = lambda p: F.char(97 + F.pmod(F.xxhash64(F.col("_salt"), p), F.lit(26)))
    return (
        spark.range(n)
        .select(F.col("id").alias("i"), F.rand(seed + 1).alias("_salt"), length.alias("_len"))
        .select("i", F.array_join(F.transform(F.sequence(F.lit(1), F.col("_len")), letter), "").alias("s"))
    )


def random_digraph(spark: SparkSession, n: int, p: float = 0.5, seed: int = 1) -> DataFrame:
    """Directed edges, self loops allowed: every ordered pair is an edge with chance ``p``."""
    cells = spark.range(n * n).select(
        F.call_function("div", F.col("id"), F.lit(n)).alias("src"), (F.col("id") % n).alias("dst"), F.rand(seed).alias("_u")
    )
    return cells.where(F.col("_u") < p).select("src", "dst", F.lit(1).alias("a"))


def random_graph(spark: SparkSession, n: int, p: float = 0.5, seed: int = 1) -> DataFrame:
    """Undirected edges without loops, stored in both directions."""
    half = random_digraph(spark, n, p, seed).where(F.col("src") < F.col("dst"))
    return half.select(F.inline(F.array(
        F.struct("src", "dst", "a"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "a")
    )))


def random_connected_graph(spark: SparkSession, n: int, p: float = 0.5, seed: int = 1) -> DataFrame:
    """A random path through all vertices plus random undirected edges."""
    shuffled = stage(spark.range(n).select(F.col("id").alias("v"), F.rand(seed + 7).alias("u")), "path")
    order = rank_rows(shuffled, ["u", "v"], "pos")
    steps = order.select(F.col("v").alias("src"), "pos").join(
        order.select(F.col("v").alias("dst"), (F.col("pos") - 1).alias("pos")), "pos"
    )
    path = steps.select(F.inline(F.array(
        F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )))
    return path.unionByName(random_graph(spark, n, p, seed).select("src", "dst")).distinct().withColumn("a", F.lit(1))


def random_coo(spark: SparkSession, rows: int, cols: int, density: float, low: float, high: float, seed: int = 1) -> DataFrame:
    """About ``density`` * rows * cols entries at random coordinates; duplicates occur."""
    return spark.range(int(rows * cols * density)).select(
        uniform(0, rows, seed, True).alias("row"), uniform(0, cols, seed + 1, True).alias("col"), uniform(low, high, seed + 2).alias("value")
    )


def random_linear_system(
    spark: SparkSession, n: int, density: float = 0.1, low: float = -10.0, high: float = 10.0, seed: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A, b, x) with b = A x for a known x; the diagonal is filled. Staged, so all three agree."""
    off = random_coo(spark, n, n, density, low, high, seed).where(F.col("row") != F.col("col")).dropDuplicates(["row", "col"])
    diagonal = spark.range(n).select(
        F.col("id").alias("row"), F.col("id").alias("col"), (uniform(low, high, seed + 5) + n * high).alias("value")
    )
    a = stage(off.unionByName(diagonal), "system")
    x = stage(random_vector(spark, n, low, high, seed + 9), "solution")
    b = gemv(a, x).select(F.col("i").alias("row"), F.col("y").alias("value"))
    return a, b, x
