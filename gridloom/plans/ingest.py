"""Nested results -> flat runs -> clean runs, and the states of a result record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import parse_shift_size
from gridloom.functions.rules import DEFAULT_PROBLEM_SIZE
from gridloom.sources.results import RUN, parse_outputs


def is_evaluated(output: Column) -> Column:
    return F.startswith(output, F.lit("{"))


def has_results(outputs: Column) -> Column:
    """Non-empty and every output evaluated."""
    return F.coalesce((F.size(outputs) > 0) & F.forall(outputs, is_evaluated), F.lit(False))


def result_state(outputs: Column) -> Column:
    """'none' (no outputs yet or only text), 'all' (all evaluated), 'mixed', or 'missing' (no list)."""
    return (
        F.when(outputs.isNull(), "missing")
        .when(~F.exists(outputs, is_evaluated), "none")
        .when(F.forall(outputs, is_evaluated), "all")
        .otherwise("mixed")
    )


def require_state(outputs: Column) -> Column:
    """True when evaluated, false when not; missing or mixed outputs stop the job."""
    state = result_state(outputs)
    problem = F.raise_error(F.concat(F.lit("outputs are "), state)).cast("boolean")
    return F.when(state == "all", True).when(state == "none", False).otherwise(problem)


def pending(prompts: DataFrame, overwrite: bool = False) -> DataFrame:
    """Prompts that still need evaluation; with ``overwrite`` all, evaluated outputs turned back into text."""
    if not overwrite:
        return prompts.where(~require_state(F.col("outputs")))
    texts = F.transform("outputs", lambda o: F.when(is_evaluated(o), F.get_json_object(o, "$.generated_output")).otherwise(o))
    return prompts.withColumn("outputs", texts)


def select_prompts(
    prompts: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    problem: str | None = None,
    problem_type: str | None = None,
) -> DataFrame:
    """Restrict by execution models, one problem, or one problem type."""
    if include:
        prompts = prompts.where(F.col("parallelism_model").isin(include))
    if exclude:
        prompts = prompts.where(~F.col("parallelism_model").isin(exclude))
    if problem:
        prompts = prompts.where(F.col("name") == problem)
    if problem_type:
        prompts = prompts.where(F.col("problem_type") == problem_type)
    return prompts


def flatten_runs(results: DataFrame) -> DataFrame:
    """One row per run; an output that never built keeps one row without run columns.

    An output with an empty list of runs has no row, and prompts without evaluated outputs drop out.
    No shuffle: both expansions work inside a row.
    """
    head = ["prompt", "name", "problem_type", "language", "parallelism_model", "temperature", "top_p", "do_sample", "max_new_tokens"]
    outputs = (
        results.where(has_results(F.col("outputs")))
        .withColumn("prompted", F.coalesce("prompted", F.lit(False)))
        .select(*head, "prompted", F.posexplode(parse_outputs(F.col("outputs"))).alias("output_idx", "o"))
    )
    runs = outputs.where(F.col("o.runs").isNull() | (F.size("o.runs") > 0)).select(
        *head, "prompted", "o.generated_output", "o.did_build", "o.is_source_valid", "o.best_sequential_runtime",
        "output_idx", F.posexplode_outer("o.runs").alias("run_idx", "r"),
    )
    return runs.select(*[c for c in runs.columns if c != "r"], *[F.col("r")[f].alias(f) for f in RUN.names])


def never_built(runs: DataFrame) -> DataFrame:
    """(name, model) pairs without a single successful build."""
    builds = runs.groupBy("name", "parallelism_model").agg(F.coalesce(F.count_if("did_build"), F.lit(0)).alias("did_build"))
    return builds.where(F.col("did_build") == 0)


def with_problem_size(runs: DataFrame, sizes: DataFrame, default: str | None = None) -> DataFrame:
    """Look the problem size up by (name, model); Spark broadcasts the lookup while it is small."""
    size = F.coalesce(F.col("problem_size"), F.lit(default)) if default else F.col("problem_size")
    joined = runs.join(sizes.select("name", "parallelism_model", "problem_size"), ["name", "parallelism_model"], "left")
    return joined.withColumn("problem_size", parse_shift_size(size))


def with_default_size(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    return with_problem_size(runs, sizes, DEFAULT_PROBLEM_SIZE)


def clean_runs(runs: DataFrame, drop_kokkos_64: bool = True) -> DataFrame:
    """Fill the flags of outputs that never ran; drop the kokkos runs with 64 threads."""
    if drop_kokkos_64:
        # null-safe: a kokkos row without a thread count stays
        runs = runs.where(~(F.col("parallelism_model").eqNullSafe("kokkos") & F.col("num_threads").eqNullSafe(64)))
    return runs.fillna(False, subset=["did_run", "is_valid"])
