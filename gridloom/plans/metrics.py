"""build@k, pass@k, speedup@k, efficiency@k and their scaling curves over flat runs.

Runs are first reduced by (name, model, type[, output]) with map-side aggregation. Order statistics
come from one range-partitioned ranking of all samples, so a (name, model) group that holds a large
share of the runs is still spread over many tasks. All k (and all n) are computed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.estimators import choose, success_at_k
from gridloom.functions.numeric import resource_count
from gridloom.functions.rules import FIXED_RESOURCES, FIXED_SLICE, METRIC_KS, RUNTIME_FLOOR, SCALING_NS
from gridloom.operators.index import ordinal, rank_rows
from gridloom.runtime import join_null_safe, stage

OUTPUT_KEY = ["name", "parallelism_model", "output_idx"]
GROUP = ["name", "parallelism_model", "problem_type"]
RESULT = ["parallelism_model", "problem_type"]


def correctness(runs: DataFrame) -> DataFrame:
    """One row per output: valid only if all of its runs are. The type is looked up by name."""
    outputs = runs.groupBy(*OUTPUT_KEY).agg(F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("is_valid"))
    types = runs.select("name", "problem_type").dropDuplicates()
    return outputs.join(types, "name", "left")


def _success_table(rows: DataFrame, flag: str, metric: str, ks: list[int]) -> DataFrame:
    counts = rows.groupBy(*GROUP).agg(F.count(flag).alias("_n"), F.count_if(flag).alias("_c"))
    shares = counts.select(*RESULT, *[success_at_k(F.col("_n"), F.col("_c"), k).alias(f"{metric}@{k}") for k in ks])
    return shares.groupBy(*RESULT).agg(*[F.avg(f"{metric}@{k}").alias(f"{metric}@{k}") for k in ks])


def build_at_k(runs: DataFrame, ks: list[int], per_output: bool = False) -> DataFrame:
    """build@k. Every run row counts as an attempt; ``per_output`` counts each output once."""
    if per_output:
        runs = runs.groupBy(*GROUP, "output_idx").agg(F.bool_or("did_build").alias("did_build"))
    return _success_table(runs, "did_build", "build", ks)


def pass_at_k(correct: DataFrame, ks: list[int]) -> DataFrame:
    """pass@k over one row per output (see ``correctness``)."""
    return _success_table(correct, "is_valid", "pass", ks)


def fixed_slice(runs: DataFrame) -> DataFrame:
    """Runs at the fixed resource count of their execution model."""
    keep = F.lit(False)
    for model, procs, threads in FIXED_SLICE:
        match = F.col("parallelism_model") == model
        if procs is not None:
            match &= F.col("num_procs") == procs
        if threads is not None:
            match &= F.col("num_threads") == threads
        keep |= match
    return runs.where(keep)


def fixed_resources(overrides: dict[str, int] | None = None) -> Column:
    """Resources charged to a run of the fixed slice."""
    model = F.col("parallelism_model")
    charged = F.when(model.isin("cuda", "hip"), F.col("problem_size").cast("double"))
    for name, n in {**FIXED_RESOURCES, **(overrides or {})}.items():
        charged = charged.when(model == name, F.lit(float(n)))
    return charged.otherwise(1.0)


def used_resources() -> Column:
    """Resources a run really used."""
    model = F.col("parallelism_model")
    return (
        F.when(model.isin("cuda", "hip"), F.col("problem_size").cast("double"))
        .when(model.isin("kokkos", "omp", "mpi", "mpi+omp"), resource_count(model, F.col("num_procs"), F.col("num_threads")).cast("double"))
        .otherwise(1.0)
    )


def _outputs(runs: DataFrame) -> DataFrame:
    """Everything the metrics need per output, from one aggregation of the runs."""
    valid = lambda c: F.when(F.col("is_valid"), c)
    cost = F.col("runtime") * used_resources()
    order = F.when(F.col("is_valid") & cost.isNotNull(), F.struct(cost, "run_idx"))
    return runs.groupBy(*GROUP, "output_idx").agg(
        F.count("did_build").alias("attempts"),
        F.count_if("did_build").alias("builds"),
        F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("all_valid"),
        F.min(valid(F.col("runtime"))).alias("best"),
        F.min(valid(F.col("best_sequential_runtime"))).alias("best_sequential_runtime"),
        F.coalesce(F.bool_or(valid(F.coalesce("run_idx", F.lit(0)) == 0)), F.lit(False)).alias("has_first"),
        F.min_by(F.struct("runtime", used_resources().alias("resources")), order).alias("cheapest"),
    )


def _shares(outputs: DataFrame, ks: list[int], per_output_builds: bool) -> DataFrame:
    """build@k and pass@k from the per-output table, in one aggregation."""
    attempts, builds = (F.count(F.lit(1)), F.count_if(F.col("builds") > 0)) if per_output_builds else (F.sum("attempts"), F.sum("builds"))
    counts = outputs.groupBy(*GROUP).agg(
        attempts.alias("attempts"), builds.alias("builds"), F.count(F.lit(1)).alias("outputs"), F.count_if("all_valid").alias("valid")
    )
    shares = counts.select(
        *RESULT,
        *[success_at_k(F.col("attempts"), F.col("builds"), k).alias(f"build@{k}") for k in ks],
        *[success_at_k(F.col("outputs"), F.col("valid"), k).alias(f"pass@{k}") for k in ks],
    )
    return shares.groupBy(*RESULT).agg(*[F.avg(f"{m}@{k}").alias(f"{m}@{k}") for m in ("build", "pass") for k in ks])


def _samples(runs: DataFrame, outputs: DataFrame, overrides: dict[str, int] | None) -> DataFrame:
    """All samples of all runtime metrics: (kind, group, runtime, baseline, resources, order columns)."""
    row = [*GROUP, "output_idx", F.coalesce("run_idx", F.lit(0)).alias("run_idx"), "runtime", "best_sequential_runtime"]
    sliced = fixed_slice(runs.where("is_valid")).select(
        F.lit("fixed").alias("kind"), *row, fixed_resources(overrides).alias("resources")
    )
    case = lambda kind, runtime, resources: F.struct(
        F.lit(kind).alias("kind"), runtime.alias("runtime"), resources.alias("resources")
    )
    cases = F.array(
        F.when(F.col("has_first"), case("speedup_max", F.col("best"), F.lit(1.0))),
        F.when(
            F.col("cheapest").isNotNull(), case("efficiency_max", F.col("cheapest.runtime"), F.col("cheapest.resources"))
        ),
    )
    per_output = outputs.select("*", F.explode(F.array_compact(cases)).alias("case")).select(
        "case.kind", *GROUP, "output_idx", F.lit(0).alias("run_idx"), "case.runtime", "best_sequential_runtime", "case.resources"
    )
    return sliced.unionByName(per_output)


def _ranked(samples: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank``, 1-based by runtime."""
    return rank_rows(samples, ["runtime", "output_idx", "run_idx"], "rank", by).withColumn("rank", F.col("rank") + 1)


def _group_sums(ranked: DataFrame, by: list[str], ks: list[int], strict: bool, resources: Column) -> DataFrame:
    """``by, s<k>, e<k>``: the sums of all speedup and efficiency terms of a group, in one aggregation.

    The group's size and baseline are the same in every term, so they are gathered beside the sums and applied to them,
    instead of being joined to the samples first.
    """
    cost = F.greatest("runtime", F.lit(RUNTIME_FLOOR))
    ways = {k: choose(F.col("rank") - 1, k - 1, strict) for k in ks}
    sums = [F.sum(w / c).alias(f"{name}{k}") for k, w in ways.items() for name, c in (("s", cost), ("e", cost * resources))]
    gathered = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.min("best_sequential_runtime").alias("_baseline"), *sums)
    # null where strict counting leaves no way to draw k samples
    of = lambda c, k: (F.try_divide(F.col(c), choose(F.col("_size"), k, strict)) * F.col("_baseline")).alias(c)
    return gathered.select(*by, *[of(f"{name}{k}", k) for k in ks for name in ("s", "e")])


def _runtime_table(samples: DataFrame, ks: list[int], strict: bool) -> DataFrame:
    by = ["kind", *GROUP]
    ranked = _ranked(samples, by)
    # efficiency_max pairs the j-th smallest runtime with the resources of the j-th output; the other kinds join nothing
    paired_kind = F.col("kind") == "efficiency_max"
    cheapest = ranked.where(paired_kind)
    listed = ordinal(cheapest.select(*by, "output_idx", "resources"), "output_idx", "rank", by).select(
        *by, (F.col("rank") + 1).alias("rank"), "resources"
    )
    paired = join_null_safe(cheapest.drop("resources"), listed, [*by, "rank"])
    ranked = ranked.where(~paired_kind).unionByName(paired)
    per_group = _group_sums(ranked, by, ks, strict, F.col("resources"))
    picks = []
    for k in ks:
        picks += [
            (f"speedup@{k}", "fixed", f"s{k}"),
            (f"speedup_max@{k}", "speedup_max", f"s{k}"),
            (f"efficiency@{k}", "fixed", f"e{k}"),
            (f"efficiency_max@{k}", "efficiency_max", f"e{k}"),
        ]
    return per_group.groupBy(*RESULT).agg(
        *[F.avg(F.when(F.col("kind") == kind, F.col(value))).alias(name) for name, kind, value in picks]
    )


def metric_table(
    runs: DataFrame,
    ks: list[int] | None = None,
    strict: bool = False,
    per_output_builds: bool = False,
    resources: dict[str, int] | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """All metrics per (execution model, problem type).

    ``runs`` are clean runs with a ``problem_size``. A problem name belongs to one type. Runtime metrics
    without any valid run are 0; build@k and pass@k are never filled. ``strict`` uses C(n, k) = 0 for
    n < k; ``resources`` overrides the charged resources by model.
    """
    ks = ks or METRIC_KS
    # one row per output, read three times below
    outputs = stage(_outputs(runs), "outputs")
    times = _runtime_table(_samples(runs, outputs, resources), ks, strict)
    table = _shares(outputs, ks, per_output_builds).join(times, RESULT, "full_outer")
    ordered = [f"{m}@{k}" for k in ks for m in ("build", "pass", "speedup", "speedup_max", "efficiency", "efficiency_max")]
    filled = [c for c in ordered if not c.startswith(("build", "pass"))]
    return _label(table.fillna(0.0, subset=filled).select(*RESULT, *ordered), model_name)


def scaling_table(
    runs: DataFrame,
    execution_model: str,
    k: int = 1,
    ns: list[int] | None = None,
    strict: bool = False,
    model_name: str | None = None,
) -> DataFrame:
    """speedup_{n}@k and efficiency_{n}@k for every resource count n, in one job."""
    ns = ns or SCALING_NS
    n = resource_count(F.col("parallelism_model"), F.col("num_procs"), F.col("num_threads")).alias("n")
    samples = (
        runs.where((F.col("parallelism_model") == execution_model) & F.col("is_valid"))
        .select(*GROUP, "output_idx", F.coalesce("run_idx", F.lit(0)).alias("run_idx"), "runtime", "best_sequential_runtime", n)
        .where(F.col("n").isin(ns))
    )
    by = [*GROUP, "n"]
    # with k = 1 every sample weighs the same, whatever its rank
    ranked = _ranked(samples, by) if k > 1 else samples.withColumn("rank", F.lit(1))
    per_group = _group_sums(ranked, by, [k], strict, F.col("n"))
    picks = [(f"{m}_{c}@{k}", c, v) for c in ns for m, v in (("speedup", f"s{k}"), ("efficiency", f"e{k}"))]
    table = per_group.groupBy(*RESULT).agg(*[F.avg(F.when(F.col("n") == c, F.col(v))).alias(name) for name, c, v in picks])
    return _label(table.fillna(0.0), model_name)


def _label(table: DataFrame, model_name: str | None) -> DataFrame:
    if model_name is None:
        return table
    return table.select(F.lit(model_name).alias("model_name"), *table.columns)


def report_names(table: DataFrame) -> DataFrame:
    """Column names of the written report."""
    names = {"model_name": "model", "parallelism_model": "execution model", "problem_type": "problem type"}
    return table.withColumnsRenamed({k: v for k, v in names.items() if k in table.columns})
