"""Evaluation records: run matrix, run logs, source checks, roll-up flags and nested assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.rules import SMALL_BASELINE, launch_rows
from gridloom.functions.text import fill_slots, strip


# ---- what to run

def default_launch_params(spark: SparkSession) -> DataFrame:
    """The default launch table; its size is fixed."""
    rows = spark.createDataFrame(
        launch_rows(), "parallelism_model string, format string, num_procs int, num_threads int"
    )
    return rows.coalesce(1)


def run_matrix(outputs: DataFrame, launches: DataFrame, exec_path: str = "a.out", args: str = "") -> DataFrame:
    """Outputs x launch settings of their model, with the filled-in command."""
    command = fill_slots(
        F.col("format"),
        {
            "exec_path": F.lit(exec_path),
            "args": F.lit(args),
            "num_procs": F.coalesce(F.col("num_procs").cast("string"), F.lit("")),
            "num_threads": F.coalesce(F.col("num_threads").cast("string"), F.lit("")),
        },
    )
    return outputs.join(launches, "parallelism_model").withColumn("command", strip(command)).drop("format")


def valid_source(source: Column, model: Column) -> Column:
    """Does the source use its programming model? Models without a rule always pass."""
    omp = F.contains(source, F.lit("#pragma omp"))
    mpi = F.contains(source, F.lit("MPI_")) | F.contains(source, F.lit("MPI."))
    return F.when(model == "omp", omp).when(model == "mpi", mpi).when(model == "mpi+omp", mpi & omp).otherwise(True)


# ---- what came back

def parse_run_log(stdout: Column) -> Column:
    """struct(is_valid, runtime, best_sequential_runtime) from the printed lines; later lines win."""
    lines = F.split(stdout, "\n")

    def last(mark: str) -> Column:
        found = F.filter(lines, lambda line: F.startswith(line, F.lit(mark)))
        # up to the next colon, as further fields may follow
        return strip(F.get(F.split(F.try_element_at(found, F.lit(-1)), ":"), F.lit(1)))

    return F.struct(
        (last("Validation:") == "PASS").alias("is_valid"),
        last("Time:").try_cast("double").alias("runtime"),
        last("BestSequential:").try_cast("double").alias("best_sequential_runtime"),
    )


def log_warnings(is_valid: Column, runtime: Column, baseline: Column) -> Column:
    """Array of warnings about times that are too small to trust."""
    return F.array_compact(
        F.array(
            F.when(is_valid & (runtime == 0), "runtime is 0"),
            F.when(is_valid & (baseline == 0), "baseline is 0"),
            F.when(is_valid & (baseline != 0) & (baseline < SMALL_BASELINE), "baseline is very small"),
        )
    )


def roll_up(runs: Column) -> dict[str, Column]:
    """Flags of one output from its array of runs (exit_code, is_valid, best_sequential_runtime); null = not built."""
    truth = lambda c: F.coalesce(c, F.lit(False))
    ran = lambda r: truth(r["exit_code"] == 0)
    any_run = truth(F.exists(runs, ran))
    all_run = truth(F.forall(runs, ran))
    return {
        "did_build": runs.isNotNull(),
        "did_any_run": any_run,
        "did_all_run": all_run,
        "are_any_valid": any_run & truth(F.exists(runs, lambda r: truth(r["is_valid"]))),
        "are_all_valid": all_run & truth(F.forall(runs, lambda r: truth(r["is_valid"]))),
        "best_sequential_runtime": F.when(any_run, F.array_min(F.transform(runs, lambda r: r["best_sequential_runtime"]))),
    }


def roll_up_rows(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The same flags from run rows (did_run, is_valid, best_sequential_runtime), by aggregation."""
    any_run = F.coalesce(F.bool_or("did_run"), F.lit(False))
    all_run = F.coalesce(F.bool_and("did_run"), F.lit(False))
    return runs.groupBy(*keys).agg(
        any_run.alias("did_any_run"),
        all_run.alias("did_all_run"),
        (any_run & F.coalesce(F.bool_or("is_valid"), F.lit(False))).alias("are_any_valid"),
        (all_run & F.bool_and(F.coalesce("is_valid", F.lit(False)))).alias("are_all_valid"),
        F.when(any_run, F.min("best_sequential_runtime")).alias("best_sequential_runtime"),
    )


# ---- summaries

def _flag(name: str) -> Column:
    return F.count_if(F.coalesce(F.col(name), F.lit(False)))


def prompt_summary(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs, writes, builds, complete runs, and outputs valid in results and source, per prompt."""
    good = F.coalesce(F.col("are_all_valid") & F.col("is_source_valid"), F.lit(False))
    return outputs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outputs"),
        _flag("source_write_success").alias("writes"),
        _flag("did_build").alias("builds"),
        _flag("did_all_run").alias("runs"),
        F.count_if(good).alias("valid"),
    )


def stage_counts(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """How many outputs reach each stage."""
    return outputs.groupBy(*keys).agg(
        _flag("source_write_success").alias("write"),
        _flag("is_source_valid").alias("source_valid"),
        _flag("did_build").alias("build"),
        _flag("did_all_run").alias("run"),
        _flag("are_all_valid").alias("correct"),
    )


def check_counts(outputs: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Mismatches between stage counts and an expectations table with the same columns."""
    stages = ["write", "source_valid", "build", "run", "correct"]
    long = lambda df, out: df.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias(out)) for s in stages]))
    )
    both = long(stage_counts(outputs, keys), "actual").join(long(expected, "expected"), [*keys, "stage"], "full_outer")
    return both.where(~F.coalesce("actual", F.lit(0)).eqNullSafe(F.coalesce("expected", F.lit(0))))


def assemble(rows: DataFrame, keys: list[str], order: str, fields: list[str], out: str = "outputs") -> DataFrame:
    """Back to one row per key with an ordered array of structs. The array is the result row itself."""
    gathered = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return rows.groupBy(*keys).agg(
        F.transform(gathered, lambda o: F.struct(*[o[f].alias(f) for f in fields])).alias(out)
    )
