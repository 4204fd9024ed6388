"""Session set-up, staged tables and skew-safe joins shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE_CONF = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of a DataFrame's job as soon as the job has ended
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: whether a job marks its folder with a file when it has ended
MARK_CONF = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def build_session(app: str = "gridloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's checkpoint folder.

    A folder of our own is made only in local mode, where driver and executors are one process.
    """
    root = spark.conf.get(STAGE_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {STAGE_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="gridloom-stage-")
    spark.conf.set(STAGE_CONF, root)
    return root


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and lets later steps read single columns. The shuffle files of the
    job go when it ends; else they would stay until the driver happens to collect its garbage. Nobody looks for a marker
    file here: on a local folder each file that is made starts two processes, from a JVM that then counts twice.
    """
    path = f"{stage_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.options(**{MARK_CONF: "false"}, **options).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP_CONF)
        else:
            conf.set(CLEANUP_CONF, before)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; only frames that ``stage`` returned are taken."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def group_id(keys: list[str]) -> Column:
    """One text for the values of ``keys``, never null, so that groups with null keys pass joins and Python functions."""
    # each value with its length, so that no two lists of values read alike
    values = [F.col(f"`{k}`").cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.md5(F.concat(*parts).cast("binary")) if parts else F.lit("")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; ``right`` adds its other columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[f"`{k}`"].eqNullSafe(renamed[f"`_right_{k}`"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = 1_000_000, share: int = 100_000) -> DataFrame:
    """Keys with more rows than one task should get, with a slice count.

    A task gets ``hot_rows`` rows, or 1/``share`` of all rows if that is more: at most ``share`` keys qualify, which bounds
    the table for broadcasting. Exact counts (not samples) decide, so that every reader of the table agrees on it.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    budget = F.greatest(F.lit(hot_rows), total / share)
    return counts.where(F.col("_n") > budget).withColumn("_slices", F.ceil(F.col("_n") / budget).cast("int")).drop("_n")


def spread_rows(df: DataFrame, hot: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Add ``_slice``: rows of a hot key are dealt out by hashing ``spread``, all others stay in slice 0."""
    slices = F.coalesce("_slices", F.lit(1))
    dealt = df.join(F.broadcast(hot), on, "left")
    return dealt.withColumn("_slice", F.pmod(F.xxhash64(*spread), slices).cast("int")).drop("_slices")


def repeat_rows(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_slice``: rows of a hot key once per slice, all others once."""
    slices = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), on, "left").withColumn("_slice", F.explode(slices)).drop("_slices")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    hot_rows: int = 1_000_000,
    share: int = 100_000,
) -> DataFrame:
    """Equi-join that splits the hot keys of ``left`` over many tasks (see ``hot_keys``).

    ``how`` may be inner, left, left_semi or left_anti: each left row is in exactly one slice, and
    every slice sees all right rows of its key. The counts are written once, for both sides to read.
    """
    hot = stage(hot_keys(left, on, hot_rows, share), "hot")
    return (
        spread_rows(left, hot, on, spread).join(repeat_rows(right, hot, on), [*on, "_slice"], how).drop("_slice")
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_spread: list[str],
    right_spread: list[str],
    hot_rows: int = 1_000_000,
    share: int = 100_000,
) -> DataFrame:
    """Inner equi-join in which a key may be hot on either side or both: its rows form a grid of slices, and each pair of
    rows meets in one cell of it."""
    sides = [hot_keys(df, on, hot_rows, share).withColumnRenamed("_slices", f"_{name}") for df, name in ((left, "down"), (right, "across"))]
    hot = sides[0].join(sides[1], on, "full").fillna(1, ["_down", "_across"])
    hot = stage(hot, "hot")
    down, across = F.coalesce("_down", F.lit(1)), F.coalesce("_across", F.lit(1))

    def dealt(df: DataFrame, spread: list[str], own: str, slices: Column, other: str, copies: Column) -> DataFrame:
        placed = df.join(F.broadcast(hot), on, "left").withColumn(own, F.pmod(F.xxhash64(*spread), slices).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1))).drop("_down", "_across")

    rows = dealt(left, left_spread, "_i", down, "_j", across)
    return rows.join(dealt(right, right_spread, "_j", across, "_i", down), [*on, "_i", "_j"]).drop("_i", "_j")
