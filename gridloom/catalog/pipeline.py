"""Queries for the results pipeline: ingest, metrics, prompts, text, restore, corpus and streams."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridloom.catalog import views as v
from gridloom.catalog.registry import QUERIES, SQL, query, rounded
from gridloom.functions import numeric, text
from gridloom.functions.rules import CORPUS_MARKS, MODELS, SCALING_NS
from gridloom.operators import reduce
from gridloom.plans import corpus, evaluation, ingest, metrics, prompts, restore
from gridloom.runtime import stage_root
from gridloom.sources import prompt_tree, results
from gridloom.sources.results import RESULTS
from gridloom.streaming import flows, incremental

# ---------------------------------------------------------------- metrics

_KS = [1, 5, 10, 20]


def _chance_sql(n: str, c: str, k: int) -> str:
    """Draws without replacement: all k draws wrong, one after another."""
    wrong = " * ".join(f"(({n} - {c} - {t}) / CAST({n} - {t} AS DOUBLE))" for t in range(k))
    return f"CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE 1.0 - {wrong} END"


def _choose_sql(n: str, r: int) -> str:
    product = " * ".join([f"(({n}) - {r - t}) / {float(t)}" for t in range(1, r + 1)] or ["1.0"])
    return f"(CASE WHEN ({n}) < {r} THEN 1.0 ELSE {product} END)"


_GROUPS = "name, parallelism_model, problem_type"
_FIXED = (
    "(parallelism_model IN ('serial', 'cuda', 'hip') OR (parallelism_model IN ('kokkos', 'omp') AND num_threads = 32)"
    " OR (parallelism_model = 'mpi' AND num_procs = 512) OR (parallelism_model = 'mpi+omp' AND num_procs = 4 AND num_threads = 64))"
)
_USED = (
    "CASE parallelism_model WHEN 'cuda' THEN problem_size WHEN 'mpi' THEN num_procs WHEN 'mpi+omp' THEN num_procs * num_threads"
    " WHEN 'omp' THEN num_threads WHEN 'kokkos' THEN num_threads ELSE 1 END"
)
_CHARGED = (
    "CASE parallelism_model WHEN 'cuda' THEN problem_size WHEN 'mpi' THEN 512 WHEN 'mpi+omp' THEN 256 WHEN 'omp' THEN 8 WHEN 'kokkos' THEN 32 ELSE 1 END"
)
_SAMPLES = f"""
samples AS (
  SELECT 'fixed' AS kind, {_GROUPS}, output_idx, run_idx, runtime, best_sequential_runtime AS base, CAST({_CHARGED} AS DOUBLE) AS res
  FROM clean WHERE is_valid AND {_FIXED}
  UNION ALL
  SELECT 'speedup_max', {_GROUPS}, output_idx, 0, min(runtime), min(best_sequential_runtime), 1.0
  FROM clean WHERE is_valid GROUP BY {_GROUPS}, output_idx HAVING min(run_idx) = 0
  UNION ALL
  SELECT 'efficiency_max', {_GROUPS}, output_idx, 0, runtime, low, res FROM (
    SELECT *, CAST({_USED} AS DOUBLE) AS res, min(best_sequential_runtime) OVER (PARTITION BY {_GROUPS}, output_idx) AS low,
           row_number() OVER (PARTITION BY {_GROUPS}, output_idx ORDER BY runtime * ({_USED}), run_idx) AS rn
    FROM clean WHERE is_valid AND ({_USED}) IS NOT NULL) WHERE rn = 1),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY kind, {_GROUPS} ORDER BY runtime, output_idx, run_idx) AS j,
         row_number() OVER (PARTITION BY kind, {_GROUPS} ORDER BY output_idx, run_idx) AS listed,
         count(*) OVER (PARTITION BY kind, {_GROUPS}) AS n, min(base) OVER (PARTITION BY kind, {_GROUPS}) AS low FROM samples),
paired AS (
  SELECT a.*, CASE WHEN a.kind = 'efficiency_max' THEN b.res ELSE a.res END AS charge FROM ordered a
  JOIN ordered b ON a.kind = b.kind AND a.name = b.name AND a.parallelism_model = b.parallelism_model
       AND a.problem_type = b.problem_type AND a.j = b.listed)"""


def _metric_sql(ks: list[int]) -> str:
    builds = ", ".join(f"avg({_chance_sql('n', 'c', k)}) AS build_{k}" for k in ks)
    passes = ", ".join(f"avg({_chance_sql('n', 'c', k)}) AS pass_{k}" for k in ks)
    sums, picks = [], []
    for k in ks:
        share = f"{_choose_sql('j - 1', k - 1)} / {_choose_sql('n', k)} * low / greatest(runtime, 1e-8)"
        sums += [f"sum({share}) AS s_{k}", f"sum({share} / charge) AS e_{k}"]
        picks += [
            f"avg(s_{k}) FILTER (WHERE kind = 'fixed') AS speedup_{k}", f"avg(s_{k}) FILTER (WHERE kind = 'speedup_max') AS speedup_max_{k}",
            f"avg(e_{k}) FILTER (WHERE kind = 'fixed') AS efficiency_{k}", f"avg(e_{k}) FILTER (WHERE kind = 'efficiency_max') AS efficiency_max_{k}",
        ]
    columns = []
    for k in ks:
        columns += [f'round({m}_{k}, 6) + 0.0 AS "{m}@{k}"' for m in ("build", "pass")]
        columns += [f'round(coalesce({m}_{k}, 0.0), 6) + 0.0 AS "{m}@{k}"' for m in ("speedup", "speedup_max", "efficiency", "efficiency_max")]
    return f"""WITH {v.CLEAN_RUNS}, {_SAMPLES},
scored AS (SELECT kind, {_GROUPS}, {', '.join(sums)} FROM paired GROUP BY kind, {_GROUPS}),
times AS (SELECT parallelism_model, problem_type, {', '.join(picks)} FROM scored GROUP BY 1, 2),
built AS (SELECT {_GROUPS}, count(*) AS n, count(*) FILTER (WHERE did_build) AS c FROM clean GROUP BY {_GROUPS}),
builds AS (SELECT parallelism_model, problem_type, {builds} FROM built GROUP BY 1, 2),
verdicts AS (SELECT {_GROUPS}, output_idx, bool_and(is_valid) AS ok FROM clean GROUP BY {_GROUPS}, output_idx),
passed AS (SELECT {_GROUPS}, count(*) AS n, count(*) FILTER (WHERE ok) AS c FROM verdicts GROUP BY {_GROUPS}),
passes AS (SELECT parallelism_model, problem_type, {passes} FROM passed GROUP BY 1, 2)
SELECT parallelism_model, problem_type, {', '.join(columns)} FROM builds JOIN passes USING (parallelism_model, problem_type)
LEFT JOIN times USING (parallelism_model, problem_type)"""


def _round_all(table, keys: list[str], digits: int = 6):
    return table.select(*keys, *[rounded(F.col(f"`{c}`"), digits).alias(c) for c in table.columns if c not in keys])


@query("metric_table", _metric_sql(_KS))
def _(t):
    return _round_all(metrics.metric_table(v.clean_runs(t), _KS), metrics.RESULT)


@query(
    "metric_report",
    f"WITH m AS ({_metric_sql([1])}) SELECT 'first' AS model, parallelism_model AS \"execution model\", problem_type AS \"problem type\","
    ' "build@1", "pass@1", "speedup@1", "speedup_max@1", "efficiency@1", "efficiency_max@1" FROM m',
)
def _(t):
    table = metrics.metric_table(v.clean_runs(t), [1], model_name="first")
    return _round_all(metrics.report_names(table), ["model", "execution model", "problem type"])


@query(
    "pass_at_k",
    f"WITH {v.CLEAN_RUNS}, o AS (SELECT {_GROUPS}, output_idx, bool_and(is_valid) AS ok FROM clean GROUP BY ALL),"
    f" g AS (SELECT {_GROUPS}, count(*) AS n, count(*) FILTER (WHERE ok) AS c FROM o GROUP BY ALL)"
    " SELECT parallelism_model, problem_type, "
    + ", ".join(f"round(avg({_chance_sql('n', 'c', k)}), 6) AS \"pass@{k}\"" for k in (1, 5, 10, 20))
    + " FROM g GROUP BY 1, 2",
)
def _(t):
    return _round_all(metrics.pass_at_k(metrics.correctness(v.clean_runs(t)), [1, 5, 10, 20]), metrics.RESULT)


@query(
    "build_at_k",
    f"WITH {v.CLEAN_RUNS}, g AS (SELECT {_GROUPS}, count(*) AS n, count(*) FILTER (WHERE did_build) AS c FROM clean GROUP BY ALL)"
    " SELECT parallelism_model, problem_type, "
    + ", ".join(f"round(avg({_chance_sql('n', 'c', k)}), 6) AS \"build@{k}\"" for k in (1, 5, 10, 20))
    + " FROM g GROUP BY 1, 2",
)
def _(t):
    return _round_all(metrics.build_at_k(v.clean_runs(t), [1, 5, 10, 20]), metrics.RESULT)


@query(
    "build_at_k_per_output",
    f"WITH {v.CLEAN_RUNS}, o AS (SELECT {_GROUPS}, output_idx, bool_or(did_build) AS ok FROM clean GROUP BY ALL),"
    f" g AS (SELECT {_GROUPS}, count(*) AS n, count(*) FILTER (WHERE ok) AS c FROM o GROUP BY ALL)"
    f" SELECT parallelism_model, problem_type, round(avg({_chance_sql('n', 'c', 1)}), 6) AS \"build@1\" FROM g GROUP BY 1, 2",
)
def _(t):
    return _round_all(metrics.build_at_k(v.clean_runs(t), [1], per_output=True), metrics.RESULT)


@query(
    "correctness",
    f"WITH {v.CLEAN_RUNS} SELECT name, parallelism_model, output_idx, problem_type, bool_and(is_valid) AS is_valid FROM clean GROUP BY ALL",
)
def _(t):
    return metrics.correctness(v.clean_runs(t)).select("name", "parallelism_model", "output_idx", "problem_type", "is_valid")


_NS = SCALING_NS


def _scaling_sql(model: str, n: str, k: int) -> str:
    share = f"{_choose_sql('j - 1', k - 1)} / {_choose_sql('size', k)} * low / greatest(runtime, 1e-8)"
    picks = ", ".join(
        f'round(coalesce(avg({c}) FILTER (WHERE n = {x}), 0.0), 6) + 0.0 AS "{m}_{x}@{k}"' for x in _NS for m, c in (("speedup", "s"), ("efficiency", "s / n"))
    )
    return f"""WITH {v.RUNS}, valid AS (SELECT *, {n} AS n FROM runs WHERE parallelism_model = '{model}' AND is_valid AND {n} IN ({', '.join(map(str, _NS))})),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {_GROUPS}, n ORDER BY runtime, output_idx) AS j, count(*) OVER (PARTITION BY {_GROUPS}, n) AS size,
                   min(best_sequential_runtime) OVER (PARTITION BY {_GROUPS}, n) AS low FROM valid),
scored AS (SELECT {_GROUPS}, n, sum({share}) AS s FROM ordered GROUP BY ALL)
SELECT parallelism_model, problem_type, {picks} FROM scored GROUP BY 1, 2"""


def _scaling(t, model: str, k: int):
    raw = ingest.clean_runs(v.runs(t), drop_kokkos_64=False)
    return _round_all(metrics.scaling_table(raw, model, k, _NS), metrics.RESULT)


@query("scaling_mpi", _scaling_sql("mpi", "num_procs", 1))
def _(t):
    return _scaling(t, "mpi", 1)


@query("scaling_omp_k5", _scaling_sql("omp", "num_threads", 5))
def _(t):
    return _scaling(t, "omp", 5)


@query("scaling_mixed", _scaling_sql("mpi+omp", "num_procs * num_threads", 1))
def _(t):
    return _scaling(t, "mpi+omp", 1)


@query(
    "resource_counts",
    f"WITH {v.RUNS} SELECT parallelism_model, n, count(*) AS runs FROM (SELECT parallelism_model, CASE parallelism_model WHEN 'mpi' THEN num_procs"
    " WHEN 'mpi+omp' THEN num_procs * num_threads WHEN 'omp' THEN num_threads WHEN 'kokkos' THEN num_threads END AS n FROM runs) GROUP BY 1, 2",
)
def _(t):
    n = numeric.resource_count(F.col("parallelism_model"), F.col("num_procs"), F.col("num_threads")).cast("bigint")
    return v.runs(t).groupBy("parallelism_model", n.alias("n")).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "problem_sizes",
    f"WITH {v.RUNS} SELECT output_idx, parallelism_model, coalesce(CASE WHEN parallelism_model IN ('serial', 'omp', 'cuda', 'kokkos')"
    " THEN 1 << (CAST(substr(name, 4) AS BIGINT) % 10 + 5) END, 262144) AS problem_size FROM outs",
)
def _(t):
    outputs = v.runs(t).select("name", "output_idx", "parallelism_model", "run_idx")
    sized = ingest.with_default_size(outputs.where(F.coalesce("run_idx", F.lit(0)) == 0), v.problem_sizes(t))
    return sized.select("output_idx", "parallelism_model", "problem_size")


@query(
    "fixed_slice",
    f"WITH {v.CLEAN_RUNS} SELECT output_idx, run_idx, CAST({_CHARGED} AS DOUBLE) AS resources FROM clean WHERE is_valid AND {_FIXED}",
)
def _(t):
    sliced = metrics.fixed_slice(v.clean_runs(t).where("is_valid"))
    return sliced.select("output_idx", "run_idx", metrics.fixed_resources().alias("resources"))


@query(
    "never_built",
    f"WITH {v.RUNS} SELECT name, parallelism_model, count(*) FILTER (WHERE did_build) AS did_build FROM runs GROUP BY 1, 2 HAVING count(*) FILTER (WHERE did_build) = 0",
)
def _(t):
    return ingest.never_built(v.runs(t))


# ---------------------------------------------------------------- ingest


def _nested(t, launches=None):
    """One prompt per document. Labelled documents hold two evaluated outputs, others one line of text per output."""
    launches = launches or [[F.lit(4).alias("num_threads")]] * 2
    run = lambda valid, shift: F.struct(
        F.lit(True).alias("did_run"), valid.alias("is_valid"), (F.col("n_chars") + shift).cast("double").alias("runtime"), *launches[shift]
    )
    first = F.struct(
        F.col("text").alias("generated_output"), F.lit(True).alias("did_build"), F.lit(True).alias("is_source_valid"),
        F.col("n_chars").cast("double").alias("best_sequential_runtime"),
        F.array(run(F.col("quality") == 1, 0), run(F.col("toxic") == 1, 1)).alias("runs"),
    )
    second = F.struct(F.lit("failed").alias("generated_output"), F.lit(False).alias("did_build"), F.lit(False).alias("is_source_valid"))
    labelled = F.array(F.to_json(first), F.to_json(second, {"ignoreNullFields": "false"}))
    outputs = F.when(F.col("quality").isNotNull(), labelled).otherwise(F.split("text", "\n"))
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select(
        "doc_id", F.col("source").alias("problem_type"), F.lit("cpp").alias("language"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"),
        F.col("lang").alias("parallelism_model"), F.col("source").alias("prompt"), F.lit(0.2).alias("temperature"), F.lit(0.95).alias("top_p"),
        F.lit(True).alias("do_sample"), F.lit(64).alias("max_new_tokens"), F.lit(None).cast("boolean").alias("prompted"), outputs.alias("outputs"),
    )


@query(
    "flatten_runs",
    "WITH l AS (SELECT d.*, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
    " SELECT 'd' || doc_id AS name, 0 AS output_idx, 0 AS run_idx, quality = 1 AS is_valid, CAST(n_chars AS DOUBLE) AS runtime, md5(text) AS generated, false AS prompted FROM l"
    " UNION ALL SELECT 'd' || doc_id, 0, 1, toxic = 1, CAST(n_chars + 1 AS DOUBLE), md5(text), false FROM l"
    " UNION ALL SELECT 'd' || doc_id, 1, NULL, NULL, NULL, md5('failed'), false FROM l",
)
def _(t):
    flat = ingest.flatten_runs(_nested(t).select(*RESULTS.names))
    return flat.select("name", "output_idx", "run_idx", "is_valid", "runtime", F.md5("generated_output").alias("generated"), "prompted")


_FLAT_HEAD = (
    "SELECT source AS prompt, 'd' || doc_id AS name, source AS problem_type, 'cpp' AS \"language\", lang AS parallelism_model, 0.2::DOUBLE AS temperature,"
    " 0.95::DOUBLE AS top_p, true AS do_sample, 64 AS max_new_tokens, false AS prompted,"
)


@query(
    "flatten_runs_whole_rows",
    "WITH l AS (SELECT d.*, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
    f" {_FLAT_HEAD} md5(text) AS generated_output, true AS did_build, true AS is_source_valid, n_chars::DOUBLE AS best_sequential_runtime, 0 AS output_idx,"
    " 0 AS run_idx, true AS did_run, quality = 1 AS is_valid, n_chars::DOUBLE AS runtime, (doc_id % 64 + 1)::INTEGER AS num_threads, NULL::INTEGER AS num_procs FROM l"
    f" UNION ALL {_FLAT_HEAD} md5(text), true, true, n_chars::DOUBLE, 0, 1, true, toxic = 1, (n_chars + 1)::DOUBLE, NULL, (doc_id % 7 + 1)::INTEGER FROM l"
    f" UNION ALL {_FLAT_HEAD} md5('failed'), false, false, NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL FROM l",
)
def _(t):
    """All 21 columns, with settings that only some runs have."""
    threads, procs, none = (F.col("doc_id") % 64 + 1).cast("int"), (F.col("doc_id") % 7 + 1).cast("int"), F.lit(None).cast("int")
    nested = _nested(t, [[a.alias("num_threads"), b.alias("num_procs")] for a, b in ((threads, none), (none, procs))])
    flat = ingest.flatten_runs(nested.select(*RESULTS.names))
    return flat.withColumn("generated_output", F.md5("generated_output"))


def _run_folder(t, label: str) -> str:
    return f"{stage_root(t.spark)}/{label}-{uuid.uuid4().hex}"


_RUN_COLUMNS = ["name", "output_idx", "run_idx", "is_valid", "runtime", "prompted"]


def _flat_sql(generated: str) -> str:
    return (
        f"WITH l AS (SELECT d.*, quality, toxic, {generated} AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
        " SELECT 'd' || doc_id AS name, 0 AS output_idx, 0 AS run_idx, quality = 1 AS is_valid, CAST(n_chars AS DOUBLE) AS runtime, false AS prompted, md5(g) AS generated FROM l"
        " UNION ALL SELECT 'd' || doc_id, 0, 1, toxic = 1, CAST(n_chars + 1 AS DOUBLE), false, md5(g) FROM l"
        " UNION ALL SELECT 'd' || doc_id, 1, NULL, NULL, NULL, false, md5('failed') FROM l"
    )


@query("results_json_round_trip", _flat_sql("text"))
def _(t):
    """Nested results written as JSON lines, read back with the explicit schema and flattened."""
    path = _run_folder(t, "results")
    results.append_cache(_nested(t).select(*RESULTS.names), path)
    flat = ingest.flatten_runs(results.read_results(t.spark, path, lines=True))
    return flat.select(*_RUN_COLUMNS, F.md5("generated_output").alias("generated"))


@query("runs_csv_round_trip", _flat_sql("replace(text, chr(10), '\\n')"))
def _(t):
    """Flat runs as CSV with escaped line breaks, and back."""
    path = _run_folder(t, "csv")
    results.write_flat_csv(ingest.flatten_runs(_nested(t).select(*RESULTS.names)), path)
    return results.read_flat_csv(t.spark, path).select(*_RUN_COLUMNS, F.md5("generated_output").alias("generated"))


@query(
    "runs_by_model_table",
    f"WITH {v.RUNS} SELECT name, count(*) AS runs, count(*) FILTER (WHERE is_valid) AS valid FROM runs WHERE parallelism_model = 'omp' GROUP BY 1",
)
def _(t):
    """Runs at rest by execution model; the filter reads one folder."""
    path = _run_folder(t, "runs")
    results.write_runs(v.runs(t), path)
    stored = t.spark.read.parquet(path).where(F.col("parallelism_model") == "omp")
    return stored.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.count_if("is_valid").alias("valid"))


@query(
    "response_cache",
    "SELECT conv_id, len(texts) AS samples, md5(array_to_string(texts, '|')) AS digest FROM (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1)",
)
def _(t):
    """Two appends to a JSON Lines cache, read back as one table."""
    path = _run_folder(t, "responses")
    gathered = evaluation.assemble(t.conversations, ["conv_id"], "turn", ["text"])
    rows = gathered.select(F.col("conv_id").cast("string").alias("name"), F.col("outputs.text").alias("outputs"))
    even = F.col("name").cast("bigint") % 2 == 0
    results.append_cache(rows.where(even), path)
    results.append_cache(rows.where(~even), path)
    cached = results.read_cache(t.spark, path)
    return cached.select(
        F.col("name").cast("bigint").alias("conv_id"), F.size("outputs").cast("bigint").alias("samples"), F.md5(F.array_join("outputs", "|")).alias("digest")
    )


@query(
    "result_states",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'none' ELSE 'all' END AS state, l.doc_id IS NOT NULL AS usable FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    outputs = F.col("outputs")
    return _nested(t).select("doc_id", ingest.result_state(outputs).alias("state"), ingest.has_results(outputs).alias("usable"))


@query("pending_prompts", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(t):
    return ingest.pending(_nested(t)).select("doc_id")


@query(
    "unwrapped_outputs",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN len(string_split(text, chr(10))) ELSE 2 END AS n,"
    " md5(CASE WHEN l.doc_id IS NULL THEN string_split(text, chr(10))[1] ELSE text END) AS first FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    opened = ingest.pending(_nested(t), overwrite=True)
    return opened.select("doc_id", F.size("outputs").cast("bigint").alias("n"), F.md5(F.get("outputs", F.lit(0))).alias("first"))


@query("selected_prompts", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND lang <> 'fr' AND source = 'src3'")
def _(t):
    return ingest.select_prompts(_nested(t), ["en", "fr"], ["fr"], problem_type="src3").select("doc_id")


# ---------------------------------------------------------------- evaluation records

_LAUNCH_COUNTS = "CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 10 WHEN 'de' THEN 6 ELSE 9 END"
_AS_MODEL = "CASE lang WHEN 'en' THEN 'omp' WHEN 'fr' THEN 'mpi' WHEN 'de' THEN 'kokkos' ELSE 'mpi+omp' END"


@query("run_matrix", f"SELECT {_AS_MODEL} AS parallelism_model, sum({_LAUNCH_COUNTS})::BIGINT AS runs, count(DISTINCT doc_id) AS outputs FROM documents GROUP BY 1")
def _(t):
    outputs = t.documents.select("doc_id", F.expr(_AS_MODEL).alias("parallelism_model"))
    matrix = evaluation.run_matrix(outputs, evaluation.default_launch_params(t.spark))
    first = F.count_if(F.coalesce("num_threads", F.lit(1)) * F.coalesce("num_procs", F.lit(1)) == 1)
    return matrix.groupBy("parallelism_model").agg(F.count("command").alias("runs"), first.alias("outputs"))


@query(
    "source_checks",
    f"WITH {v.SOURCES_IN_LANGUAGES}, m AS (SELECT content, CASE lang WHEN 'C' THEN 'mpi' WHEN 'C++' THEN 'omp' WHEN 'FORTRAN' THEN 'cuda' ELSE 'mpi+omp' END AS model FROM files)"
    " SELECT model, count(*) FILTER (WHERE CASE model WHEN 'mpi' THEN contains(content, 'MPI_') OR contains(content, 'MPI.')"
    " WHEN 'omp' THEN contains(content, '#pragma omp') WHEN 'mpi+omp' THEN (contains(content, 'MPI_') OR contains(content, 'MPI.')) AND contains(content, '#pragma omp') ELSE true END) AS valid,"
    " count(*) AS files FROM m GROUP BY 1",
)
def _(t):
    model = F.expr("CASE lang WHEN 'C' THEN 'mpi' WHEN 'C++' THEN 'omp' WHEN 'FORTRAN' THEN 'cuda' ELSE 'mpi+omp' END")
    files = v.sources_in_languages(t).withColumn("model", model)
    return files.groupBy("model").agg(
        F.count_if(evaluation.valid_source(F.col("content"), F.col("model"))).alias("valid"), F.count(F.lit(1)).alias("files")
    )


@query(
    "run_logs",
    "SELECT event_id, event_type <> 'error' AS is_valid, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS runtime, value / 100000 AS baseline,"
    " CASE WHEN event_type = 'error' THEN 0 ELSE CASE WHEN event_type = 'view' THEN 1 ELSE 0 END + CASE WHEN value / 100000 < 0.001 THEN 1 ELSE 0 END END AS warnings FROM events",
)
def _(t):
    line = lambda mark, c: F.concat(F.lit(mark), c.cast("string"), F.lit("\n"))
    shown = F.when(F.col("event_type") == "view", F.lit(0.0)).otherwise(F.col("value"))
    verdict = F.when(F.col("event_type") == "error", F.lit("Validation: FAIL\n")).otherwise(F.lit("Validation: PASS\n"))
    log = F.concat(F.lit("starting\nTime: 1\n"), line("Time: ", shown), line("BestSequential: ", F.col("value") / 100000), verdict, F.lit("done"))
    parsed = t.events.select("event_id", evaluation.parse_run_log(log).alias("r")).select("event_id", "r.*")
    warnings = evaluation.log_warnings(F.col("is_valid"), F.col("runtime"), F.col("best_sequential_runtime"))
    return parsed.select("event_id", "is_valid", "runtime", F.col("best_sequential_runtime").alias("baseline"), F.size(warnings).alias("warnings"))


@query(
    "roll_up_flags",
    f"WITH {v.RUNS} SELECT output_idx, coalesce(bool_or(did_run), false) AS did_any_run, coalesce(bool_and(did_run), false) AS did_all_run,"
    " coalesce(bool_or(is_valid), false) AS are_any_valid, coalesce(bool_and(coalesce(is_valid, false)) AND bool_and(did_run), false) AS are_all_valid,"
    " min(best_sequential_runtime) AS best_sequential_runtime FROM runs GROUP BY 1",
)
def _(t):
    return evaluation.roll_up_rows(v.runs(t), ["output_idx"])


@query(
    "roll_up_arrays",
    f"WITH {v.RUNS}, f AS (SELECT output_idx, count(run_idx) > 0 AS built, coalesce(bool_or(did_run), false) AS any_run,"
    " count(run_idx) > 0 AND bool_and(coalesce(did_run, false)) AS all_run, coalesce(bool_or(is_valid), false) AS any_valid,"
    " bool_and(coalesce(is_valid, false)) AS all_valid, min(best_sequential_runtime) AS best FROM runs GROUP BY 1)"
    " SELECT output_idx, built AS did_build, any_run AS did_any_run, all_run AS did_all_run, any_run AND any_valid AS are_any_valid,"
    " all_run AND all_valid AS are_all_valid, CASE WHEN any_run THEN best END AS best_sequential_runtime FROM f",
)
def _(t):
    """The flags from the nested array of runs, which is null where an output was never built."""
    run = F.struct("run_idx", F.when(F.col("did_run"), 0).otherwise(1).alias("exit_code"), "is_valid", "best_sequential_runtime")
    runs = F.collect_list(F.when(F.col("run_idx").isNotNull(), run))
    nested = v.runs(t).groupBy("output_idx").agg(F.when(F.size(runs) > 0, runs).alias("runs"))
    return nested.select("output_idx", *[flag.alias(name) for name, flag in evaluation.roll_up(F.col("runs")).items()])


def _judged(t):
    flags = evaluation.roll_up_rows(v.runs(t), ["name", "parallelism_model", "output_idx"])
    return flags.select(
        "name", "parallelism_model", F.lit(True).alias("source_write_success"), (F.col("output_idx") % 5 != 0).alias("is_source_valid"),
        F.col("did_any_run").alias("did_build"), "did_all_run", "are_all_valid",
    )


_JUDGED = (
    f"{v.RUNS}, judged AS (SELECT name, parallelism_model, output_idx, output_idx % 5 <> 0 AS source_ok, coalesce(bool_and(did_run), false) AS ran,"
    " coalesce(bool_and(coalesce(is_valid, false)) AND bool_and(did_run), false) AS ok FROM runs GROUP BY 1, 2, 3)"
)


@query(
    "prompt_summary",
    f"WITH {_JUDGED} SELECT name, parallelism_model, count(*) AS outputs, count(*) AS writes, count(*) FILTER (WHERE ran) AS builds,"
    " count(*) FILTER (WHERE ran) AS runs, count(*) FILTER (WHERE ok AND source_ok) AS valid FROM judged GROUP BY 1, 2",
)
def _(t):
    return evaluation.prompt_summary(_judged(t), ["name", "parallelism_model"])


@query(
    "stage_count_mismatches",
    f"WITH {_JUDGED} SELECT name, 'correct' AS stage, count(*) FILTER (WHERE ok) AS actual, count(*) FILTER (WHERE ran) AS expected FROM judged GROUP BY 1"
    " HAVING count(*) FILTER (WHERE ok) <> count(*) FILTER (WHERE ran)",
)
def _(t):
    judged = _judged(t)
    expected = evaluation.stage_counts(judged.withColumn("are_all_valid", F.col("did_all_run")), ["name"])
    return evaluation.check_counts(judged, expected, ["name"])


@query(
    "assembled_conversations",
    "SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
)
def _(t):
    rows = evaluation.assemble(t.conversations, ["conv_id"], "turn", ["role", "text"], "turns")
    joined = F.array_join(F.transform("turns", lambda o: F.concat(o["role"], F.lit(":"), o["text"])), "|")
    return rows.select("conv_id", F.size("turns").cast("bigint").alias("turns"), F.md5(joined).alias("digest"))


# ---------------------------------------------------------------- prompts and text


def _drafts(t):
    model = F.expr("CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END")
    body = F.expr("replace(replace(replace(text, 'the', 'MPI'), 'and', 'Example input: output:'), 'ou', 'thread OpenMP')")
    return t.documents.select(
        "doc_id", F.col("source").alias("problem_type"), F.concat(F.lit("d"), F.expr("doc_id div 7")).alias("name"),
        model.alias("parallelism_model"), F.concat(body, F.expr("CASE WHEN n_chars % 2 = 0 THEN '{' ELSE '' END")).alias("prompt"),
    )


_DRAFTS = (
    "drafts AS (SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END AS model,"
    " replace(replace(replace(text, 'the', 'MPI'), 'and', 'Example input: output:'), 'ou', 'thread OpenMP') || CASE WHEN n_chars % 2 = 0 THEN '{' ELSE '' END AS p FROM documents)"
)


def _lint_sql() -> str:
    from gridloom.functions.rules import FORBIDDEN, REQUIRED, REQUIRED_EVERYWHERE

    checks = ["CASE WHEN p = '' THEN 1 ELSE 0 END", "CASE WHEN p NOT LIKE '%{' THEN 1 ELSE 0 END"]
    checks += [f"CASE WHEN NOT contains(p, '{w}') THEN 1 ELSE 0 END" for w in REQUIRED_EVERYWHERE]
    for model in MODELS:
        checks += [f"CASE WHEN model = '{model}' AND NOT contains(p, '{w}') THEN 1 ELSE 0 END" for w in REQUIRED[model]]
        checks += [f"CASE WHEN model = '{model}' AND contains(p, '{w}') THEN 1 ELSE 0 END" for w in FORBIDDEN[model]]
    total = " + ".join(checks)
    return f"WITH {_DRAFTS} SELECT doc_id, {total} AS violations FROM drafts WHERE {total} > 0"


@query("prompt_lint", _lint_sql())
def _(t):
    return prompts.lint(_drafts(t)).select("doc_id", F.size("violations").alias("violations"))


@query(
    "incomplete_problems",
    "SELECT source AS problem_type, 'd' || (doc_id // 7) AS name, 7 - count(*) AS missing FROM documents GROUP BY 1, 2 HAVING count(*) < 7",
)
def _(t):
    return prompts.incomplete_problems(_drafts(t)).select("problem_type", "name", F.size("missing").cast("bigint").alias("missing"))


@query(
    "prepared_prompts",
    f"WITH {v.COMPLETIONS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '#include <omp.h>' || chr(10) || chr(10) WHEN 1 THEN '#include <mpi.h>' || chr(10) || chr(10) ELSE '' END"
    " || '/* ' || source || ' */' || chr(10) || 'void f' || doc_id || CASE doc_id % 3 WHEN 0 THEN 'OpenMP' WHEN 1 THEN 'MPI' ELSE 'CUDA' END || '(int x) {' AS prompt FROM completions",
)
def _(t):
    model = F.expr("CASE doc_id % 3 WHEN 0 THEN 'omp' WHEN 1 THEN 'mpi' ELSE 'cuda' END")
    return prompts.prepare(v.completions(t).withColumn("parallelism_model", model), "model", includes=True).select("doc_id", "prompt")


@query(
    "function_headers",
    f"WITH {v.COMPLETIONS} SELECT doc_id, 'f' || doc_id AS name, '/* ' || source || ' */' || chr(10) || 'void NO_INLINE f' || doc_id || '(int x) {{' AS patched FROM completions",
)
def _(t):
    prompt = F.col("prompt")
    return v.completions(t).select("doc_id", text.function_name(prompt, F.lit("serial")).alias("name"), text.insert_keyword(prompt).alias("patched"))


_WS = "' ' || chr(10) || chr(9) || chr(13) || chr(160)"
# text up to the first point where closing braces outnumber opening ones by one
_CUT = (
    "marks AS (SELECT doc_id, unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS pos FROM bodies),"
    " depth AS (SELECT doc_id, pos, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM marks WHERE ch IN ('{', '}')),"
    " cuts AS (SELECT doc_id, min(pos) FILTER (WHERE d = -1) AS cut, min(d) AS low FROM depth GROUP BY 1),"
    " ends AS (SELECT doc_id, arg_max(d, pos) AS last FROM depth GROUP BY 1)"
)


@query(
    "clean_completions",
    f"WITH {v.COMPLETIONS}, bodies AS (SELECT doc_id, trim(code, {_WS}) AS body FROM completions), {_CUT}"
    " SELECT b.doc_id, length(CASE WHEN cut IS NULL THEN body ELSE substr(body, 1, cut) END) AS n, md5(CASE WHEN cut IS NULL THEN body ELSE substr(body, 1, cut) END) AS digest"
    " FROM bodies b LEFT JOIN cuts c ON b.doc_id = c.doc_id",
)
def _(t):
    cleaned = text.clean_completions(v.completions(t), "output", "prompt", "cleaned")
    return cleaned.select("doc_id", F.length("cleaned").cast("bigint").alias("n"), F.md5("cleaned").alias("digest"))


@query(
    "balanced_braces",
    f"WITH {v.COMPLETIONS}, bodies AS (SELECT doc_id, code AS body FROM completions), {_CUT}"
    " SELECT b.doc_id, coalesce(low >= 0 AND last = 0, true) AS balanced FROM bodies b LEFT JOIN cuts c ON b.doc_id = c.doc_id LEFT JOIN ends e ON b.doc_id = e.doc_id",
)
def _(t):
    return v.completions(t).select("doc_id", text.balanced(F.col("code")).alias("balanced"))


@query(
    "clean_chat_answers",
    f"WITH {v.COMPLETIONS}, bodies AS (SELECT doc_id, ' x;' || code AS body FROM completions), {_CUT}"
    " SELECT b.doc_id, md5(CASE WHEN b.doc_id % 2 = 0 THEN CASE WHEN cut IS NULL THEN body ELSE substr(body, 1, cut - 1) END || '}' ELSE body END) AS digest"
    " FROM bodies b LEFT JOIN cuts c ON b.doc_id = c.doc_id",
)
def _(t):
    code = F.concat(F.lit(" x;"), F.col("code"))
    # even documents repeat the header inside the second block, odd ones hold only a body
    blocks = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```\nint other;\n```\nand\n```\n"), F.col("prompt"), code)).otherwise(F.concat(F.lit("```\n"), code))
    asked = F.concat(F.lit("Complete this.\n```"), F.col("prompt"), F.lit("```\n### Response"))
    answer = F.concat(asked, F.lit("\n"), blocks, F.lit("\n```\n"))
    chats = v.completions(t).select("doc_id", asked.alias("asked"), answer.alias("answer"))
    return text.clean_chat_answers(chats, "answer", "asked", "### Response").select("doc_id", F.md5("code").alias("digest"))


@query(
    "clean_offline",
    f"WITH {v.COMPLETIONS}, bodies AS (SELECT doc_id, code AS body FROM completions), {_CUT}"
    " SELECT b.doc_id, md5(body || CASE WHEN coalesce(low >= -1 AND last = 0, true) THEN '}' ELSE '' END) AS digest"
    " FROM bodies b LEFT JOIN cuts c ON b.doc_id = c.doc_id LEFT JOIN ends e ON b.doc_id = e.doc_id",
)
def _(t):
    header = F.concat(F.lit("void f"), F.col("doc_id"), F.lit("(int x) {"))
    cleaned = text.clean_offline(F.col("prompt"), F.concat(header, F.col("code")))
    return v.completions(t).select("doc_id", F.md5(cleaned).alias("digest"))


@query("strip_fences", f"WITH {v.COMPLETIONS} SELECT doc_id, md5(code) AS affix, md5(code) AS chars FROM completions")
def _(t):
    answer = F.concat(F.lit(" ```cpp"), F.col("prompt"), F.col("code"), F.lit("```\n"))
    echoed = F.concat(F.lit("```"), F.col("prompt"), F.col("code"), F.lit("```"))
    return v.completions(t).select(
        "doc_id",
        F.md5(text.strip_fences(answer, F.col("prompt"), "affix")).alias("affix"),
        F.md5(text.strip_fences(echoed, F.col("prompt"), "chars")).alias("chars"),
    )


@query(
    "formatted_prompts",
    f"WITH {v.COMPLETIONS} SELECT doc_id, md5('Complete the C++ function f' || doc_id || '. Only write the body of the function f' || doc_id || '.' || chr(10) || chr(10)"
    " || '```cpp' || chr(10) || prompt || chr(10) || '```' || chr(10)) AS body, md5('<filename>solutions/solution_1.cpp' || chr(10)"
    " || '// here is the correct implementation of the coding exercise' || chr(10) || chr(10) || prompt) AS tagged FROM completions",
)
def _(t):
    return v.completions(t).select(
        "doc_id", F.md5(text.format_prompt(F.col("prompt"), "body")).alias("body"), F.md5(text.format_prompt(F.col("prompt"), "file_tag")).alias("tagged")
    )


@query(
    "commented_lines",
    "WITH d AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS body FROM documents)"
    " SELECT doc_id, md5('// ' || replace(body, chr(10), chr(10) || '// ')) AS digest FROM d",
)
def _(t):
    return t.documents.select("doc_id", F.md5(text.prefix_lines(F.col("text"), "// ")).alias("digest"))


@query(
    "token_statistics",
    "WITH n AS (SELECT len(string_split_regex(trim(text, ' ' || chr(10) || chr(9)), '\\s+')) AS n FROM documents)"
    " SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max, median(n) AS median, CAST(sum(n) AS BIGINT) AS total FROM n",
)
def _(t):
    stats = reduce.describe(t.documents.select(text.word_count(F.col("text")).cast("bigint").alias("n")), "n")
    return stats.select(rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"), "min", "max", "median", "total")


def _correct_code(t):
    return t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("name"), F.lit("serial").alias("parallelism_model"), F.col("lang").alias("source_file"),
        F.col("doc_id").alias("output_idx"), F.col("text").alias("generated_output"), (F.col("quality") == 1).alias("are_all_valid"),
    )


@query(
    "first_correct",
    "SELECT source AS name, md5(arg_min(text, lang || lpad(d.doc_id::VARCHAR, 20, '0'))) AS digest FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 GROUP BY 1",
)
def _(t):
    return prompts.first_correct(_correct_code(t)).select("name", F.md5("code").alias("digest"))


@query(
    "translation_prompts",
    "WITH good AS (SELECT source, arg_min(text, lang || lpad(d.doc_id::VARCHAR, 20, '0')) AS code FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 GROUP BY 1),"
    " ex AS (SELECT source, '/* ' || source || ' */' || chr(10) || 'void f(int x) {' || chr(10) || regexp_replace(code, '\\n$', '') AS e FROM good)"
    " SELECT source AS name, m AS target, md5('// Serial implementation of f' || chr(10) || '// ' || replace(e, chr(10), chr(10) || '// ') || chr(10) || chr(10)"
    " || '// ' || CASE m WHEN 'omp' THEN 'OpenMP' ELSE 'MPI' END || ' implementation of f' || chr(10) || '/* ' || source || ' */' || chr(10) || 'void f(int x) {' || chr(10)) AS digest"
    " FROM ex, (VALUES ('omp'), ('mpi')) AS x(m)",
)
def _(t):
    models = F.explode(F.array(*[F.lit(m) for m in ("serial", "omp", "mpi")]))
    table = t.documents.select("source").distinct().select(
        F.lit("scan").alias("problem_type"), F.lit("cpp").alias("language"), F.col("source").alias("name"), models.alias("parallelism_model"),
        F.concat(F.lit("/* "), F.col("source"), F.lit(" */\nvoid f(int x) {")).alias("prompt"),
    )
    made = prompts.translation_prompts(table, _correct_code(t))
    return made.select("name", F.col("translation_dst_model").alias("target"), F.md5("translation_prompt").alias("digest"))


# ---------------------------------------------------------------- reuse of responses


def _asked(t):
    return t.documents.select(F.col("source").alias("name"), F.col("lang").alias("parallelism_model"), F.md5("text").alias("prompt"), "doc_id")


def _answered(t):
    """Responses for labelled documents; toxic ones hold too few samples."""
    joined = t.documents.join(t.labels, "doc_id")
    outputs = F.when(F.col("toxic") == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return joined.select(
        F.col("source").alias("name"), F.col("lang").alias("parallelism_model"), F.md5("text").alias("prompt"),
        F.when(F.col("quality") == 1, 0.2).otherwise(0.7).alias("temperature"), F.lit(0.95).alias("top_p"), F.lit(True).alias("do_sample"),
        F.lit(64).alias("max_new_tokens"), F.lit(False).alias("prompted"), outputs.alias("outputs"), F.col("doc_id").alias("line"),
    )


_ANSWERS = (
    "asked AS (SELECT doc_id, source AS name, lang AS model, md5(text) AS prompt FROM documents),"
    " ready AS (SELECT source AS name, lang AS model, md5(text) AS prompt, d.doc_id AS line FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0 AND quality = 1)"
)


@query("without_response", f"WITH {_ANSWERS} SELECT doc_id FROM asked ANTI JOIN ready USING (name, model, prompt)")
def _(t):
    return restore.without_response(_asked(t), restore.usable(_answered(t), 2, 0.2, False)).select("doc_id")


@query("with_response", f"WITH {_ANSWERS} SELECT line FROM ready SEMI JOIN asked USING (name, model, prompt)")
def _(t):
    return restore.with_response(restore.usable(_answered(t), 2, 0.2, False), _asked(t)).select("line")


@query("first_responses", f"WITH {_ANSWERS} SELECT name, model AS parallelism_model, prompt, min(line) AS line FROM ready GROUP BY 1, 2, 3")
def _(t):
    kept, _left = restore.split_by_response(_asked(t), restore.usable(_answered(t), 2, 0.2, False), "line")
    return kept.select("name", "parallelism_model", "prompt", "line")


@query(
    "copied_outputs",
    f"WITH {_ANSWERS}, f AS (SELECT DISTINCT name, model, prompt FROM ready) SELECT doc_id, f.name IS NOT NULL AS copied FROM asked a LEFT JOIN f ON a.name = f.name AND a.model = f.model AND a.prompt = f.prompt",
)
def _(t):
    copied = restore.copy_outputs(_asked(t), restore.usable(_answered(t), 2, 0.2, top_p=0.95), "line")
    return copied.select("doc_id", F.col("outputs").isNotNull().alias("copied"))


@query("repeated_samples", "SELECT doc_id, CAST(s AS INTEGER) AS sample FROM documents, range(4) AS r(s)")
def _(t):
    return restore.repeat_samples(_asked(t), 4).select("doc_id", "sample")


@query("first_work", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(t):
    longest = t.documents.select("doc_id", "n_chars", (-F.col("n_chars")).alias("order"))
    return restore.first_work(longest, ["order", "doc_id"], 25).select("doc_id", "n_chars")


@query("all_responses", f"WITH {_ANSWERS} SELECT line, NULL AS doc_id FROM ready UNION ALL SELECT NULL, doc_id FROM asked")
def _(t):
    return restore.all_responses(restore.usable(_answered(t), 2, 0.2).select("line"), _asked(t).select("doc_id"))


@query(
    "token_rates",
    "SELECT role, count(*) AS responses, sum(length(text))::BIGINT AS total_tokens, round(sum(length(text)) / sum(turn + 1.0), 6) AS tokens_per_second FROM conversations GROUP BY 1",
)
def _(t):
    log = t.conversations.select("role", F.length("text").cast("bigint").alias("tokens"), (F.col("turn") + 1.0).alias("seconds"))
    return restore.token_rates(log, ["role"]).withColumn("tokens_per_second", rounded("tokens_per_second", 6))


# ---------------------------------------------------------------- corpus and streams


def _usage_sql() -> str:
    columns = []
    for model, marks in CORPUS_MARKS.items():
        cases = []
        for lang, needles in marks.items():
            test = " OR ".join("contains(content, '" + n.replace("'", "''") + "')" for n in needles)
            cases.append(f"(lang = '{lang}' AND ({test}))")
        columns.append(f"count(*) FILTER (WHERE {' OR '.join(cases)}) AS {model}")
    return f"WITH {v.SOURCES_IN_LANGUAGES} SELECT lang, count(*) AS files, {', '.join(columns)} FROM files GROUP BY 1"


@query("model_usage", _usage_sql())
def _(t):
    return corpus.usage_by_language(v.sources_in_languages(t))


@query(
    "model_usage_totals",
    f"SELECT sum(files)::BIGINT AS total, {', '.join(f'sum({m})::BIGINT AS {m}' for m in CORPUS_MARKS)} FROM ({_usage_sql()})",
)
def _(t):
    return corpus.usage_totals(corpus.usage_by_language(v.sources_in_languages(t)))


_MARKS_BY_LANGUAGE = {"article": {"en": ["the ", "and "], "fr": ["le ", "la "], "de": ["der ", "und "]}, "list": {"es": [", "], "en": ["; "]}}
_MARKED_SQL = (
    "SELECT lang, count(*) AS files, count(*) FILTER (WHERE (lang = 'en' AND (contains(text, 'the ') OR contains(text, 'and '))) OR (lang = 'fr' AND (contains(text, 'le ') OR contains(text, 'la ')))"
    " OR (lang = 'de' AND (contains(text, 'der ') OR contains(text, 'und ')))) AS article,"
    " count(*) FILTER (WHERE (lang = 'es' AND contains(text, ', ')) OR (lang = 'en' AND contains(text, '; '))) AS list FROM documents GROUP BY 1"
)


@query("marks_by_language", _MARKED_SQL)
def _(t):
    return corpus.usage_by_language(t.documents, "text", "lang", _MARKS_BY_LANGUAGE)


def _table_stream(t, name: str):
    """The files of a table, which may be one file or a folder of them; Spark streams a single file by a pattern only."""
    return flows.file_stream(t.spark, f"{t.folder}/{name}.parque[t]", getattr(t, name).schema)


@query("streamed_marks", _MARKED_SQL)
def _(t):
    """The same counters from a file stream with checkpoint and snapshots."""
    folder = _run_folder(t, "stream")
    files = _table_stream(t, "documents")
    flows.count_corpus(files, f"{folder}/snapshots", f"{folder}/checkpoint", "text", "lang", _MARKS_BY_LANGUAGE).awaitTermination()
    return flows.latest_snapshot(t.spark, f"{folder}/snapshots")


@query("incremental_results", "SELECT doc_id, min(md5(text)) AS digest FROM documents GROUP BY 1")
def _(t):
    """Two passes over the same files, each from the start: the second finds everything done."""
    folder = _run_folder(t, "incremental")
    for attempt in range(2):
        items = _table_stream(t, "documents")
        work = lambda df: df.select("doc_id", F.md5("text").alias("digest"))
        incremental.append_new(items, f"{folder}/results", f"{folder}/checkpoint{attempt}", ["doc_id"], work, F.md5("text")).awaitTermination()
    return incremental.read_new(t.spark, f"{folder}/results").drop("run", "batch")


@query("cached_responses", "SELECT DISTINCT conv_id, turn, md5(text) AS digest FROM conversations")
def _(t):
    folder = _run_folder(t, "cache")
    turns = _table_stream(t, "conversations")
    responses = turns.select("conv_id", "turn", F.md5("text").alias("digest"))
    incremental.cache_responses(responses, f"{folder}/cache", f"{folder}/checkpoint", ["conv_id", "turn", "digest"]).awaitTermination()
    return incremental.read_cache(t.spark, f"{folder}/cache").select("conv_id", "turn", "digest")


@query("resumed_marks", _MARKED_SQL)
def _(t):
    """Four batches of as many files, a few more in a larger table. The third batch fails between its counts and the totals;
    the run that goes on uses another number of shuffle partitions."""
    folder = _run_folder(t, "resumed")
    files_per_batch = -(-t.documents.rdd.getNumPartitions() // 4)  # a file is no larger than what a task reads of the table
    t.documents.repartition(4 * files_per_batch).write.parquet(f"{folder}/files")

    def run(before_snapshot=lambda batch: None):
        files = flows.file_stream(t.spark, f"{folder}/files", t.documents.schema, files_per_batch=files_per_batch)
        return incremental.resumable_counts(
            files, f"{folder}/store", f"{folder}/checkpoint", "text", "lang", _MARKS_BY_LANGUAGE, before_snapshot=before_snapshot
        )

    def fail(batch):
        if batch == 2:
            raise InterruptedError("stopped on purpose")

    try:
        run(fail).awaitTermination()
    except StreamingQueryException as stopped:
        if "stopped on purpose" not in str(stopped) or incremental.last_commit(t.spark, f"{folder}/store") != 1:
            raise
    width = t.spark.conf.get("spark.sql.shuffle.partitions")
    t.spark.conf.set("spark.sql.shuffle.partitions", int(width) + 3)
    try:
        run().awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.shuffle.partitions", width)
    return incremental.read_counts(t.spark, f"{folder}/store")


@query(
    "results_of_two_sittings",
    "SELECT doc_id, min(md5(text)) AS digest, 1 AS sitting FROM documents GROUP BY 1"
    " UNION ALL SELECT -1 - doc_id, min(md5(lang)), 2 FROM documents WHERE doc_id % 5 = 0 GROUP BY 1",
)
def _(t):
    """Files come in three loads, the later ones repeat keys with other contents. The second sitting starts with a fresh
    checkpoint, so it goes through all files again and has to find the few new keys in the index."""
    folder = _run_folder(t, "sittings")
    items = t.documents.select("doc_id", F.md5("text").alias("digest"))
    other = t.documents.select("doc_id", F.md5("lang").alias("digest"))

    def load(rows, files):
        rows.repartition(files).write.mode("append").parquet(f"{folder}/files")

    def sit(name):
        stream = flows.file_stream(t.spark, f"{folder}/files", items.schema, files_per_batch=1)
        work = lambda df: df.withColumn("sitting", F.lit(name))
        incremental.append_new(stream, f"{folder}/results", f"{folder}/checkpoint{name}", ["doc_id"], work, "digest", buckets=32).awaitTermination()

    load(items, 1)
    load(other.where("doc_id % 3 = 0"), 2)
    sit(1)
    load(other.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "digest").unionByName(other), 2)
    sit(2)
    return incremental.read_new(t.spark, f"{folder}/results").drop("run", "batch")


@query(
    "reused_responses",
    "WITH asked AS (SELECT conv_id, turn, md5(text) AS digest FROM conversations UNION ALL SELECT conv_id, turn, md5(text) FROM conversations WHERE turn % 2 = 0)"
    " SELECT conv_id, turn, min(digest) AS digest, count(*) AS requests, count(*) - 1 AS reused FROM asked GROUP BY 1, 2",
)
def _(t):
    """Two overlapping loads; what the first brought is taken from the keyed state when the second asks for it."""
    folder = _run_folder(t, "reused")
    keys = ["conv_id", "turn"]
    turns = t.conversations.select(*keys, F.md5("text").alias("digest"))
    turns.coalesce(1).write.parquet(f"{folder}/turns")
    turns.where("turn % 2 = 0").coalesce(1).write.mode("append").parquet(f"{folder}/turns")
    stream = flows.file_stream(t.spark, f"{folder}/turns", turns.schema, files_per_batch=1)
    incremental.cache_responses(stream, f"{folder}/cache", f"{folder}/checkpoint", keys, "digest").awaitTermination()
    counts = incremental.reuse_counts(t.spark, f"{folder}/cache", keys)
    return incremental.read_cache(t.spark, f"{folder}/cache").select(*keys, "digest").join(counts, keys)


# ---------------------------------------------------------------- files

_TREE_MODELS = ["serial", "omp", "mpi", "mpi+omp", "kokkos", "cuda", "hip"]


@query(
    "prompt_tree_source",
    "SELECT lang AS problem_type, 'cpp' AS \"language\", source || '/' || doc_id AS name, 'mpi+omp' AS parallelism_model, md5(text) AS digest"
    " FROM documents WHERE doc_id % 7 = 3 AND lang IN ('en', 'de')",
)
def _(t):
    """Documents as a tree of prompt files, of which one model and two types are read back."""
    folder = _run_folder(t, "tree")
    model = F.element_at(F.array(*map(F.lit, _TREE_MODELS)), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    prompt_tree.write_prompt_tree(
        t.documents.select(F.col("lang").alias("problem_type"), name.alias("name"), model.alias("parallelism_model"), F.col("text").alias("prompt")), folder
    )
    rows = prompt_tree.read_prompt_tree(t.spark, folder, parallelism_model=["mpi+omp"], problem_type=["en", "de"])
    return rows.withColumn("digest", F.md5("prompt")).drop("prompt")


@query(
    "ranked_result_files",
    f"WITH {_ANSWERS}, files AS (SELECT name, model, prompt, line, CASE WHEN line % 3 = 0 THEN 2 ELSE line % 3 - 1 END AS source_rank FROM ready)"
    " SELECT name, model AS parallelism_model, arg_min(prompt, source_rank * 1000000000 + line) AS prompt, min(source_rank) AS source_rank FROM files GROUP BY 1, 2",
)
def _(t):
    """Results in one folder per run, read by a glob; the first file by name that has a response wins."""
    folder = _run_folder(t, "ranked")
    made = restore.usable(_answered(t), 2, 0.2, False).withColumn("problem_type", F.lit("scan")).withColumn("language", F.lit("cpp"))
    for rest, label in ((1, "a run"), (2, "b%run"), (0, "c")):
        part = made.where(F.col("line") % 3 == rest).withColumn("max_new_tokens", F.col("line").cast("int"))
        results.append_cache(part.select(*RESULTS.names), f"{folder}/{label}/results.json")
    ranked = results.read_ranked_results(t.spark, f"{folder}/*/results.json", lines=True)
    order = F.struct("source_rank", "max_new_tokens")
    return restore.first_responses(ranked.select("name", "parallelism_model", "prompt", "source_rank", "max_new_tokens"), order, ["name", "parallelism_model"]).drop("max_new_tokens")


@query(
    "problem_size_file",
    "SELECT source AS name, lang AS parallelism_model, '(1<<' || count(*) || ')' AS problem_size, (2 ** (count(*) % 60))::BIGINT AS items FROM documents GROUP BY 1, 2",
)
def _(t):
    """Sizes as a nested map in one JSON file, read back as rows."""
    path = _run_folder(t, "sizes")
    counts = t.documents.groupBy(F.col("source").alias("name"), F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("model", F.concat(F.lit("(1<<"), F.col("n").cast("string"), F.lit(")")))
    by_name = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(entry)).alias("sizes"))  # a few models a name
    nested = by_name.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "sizes")))).alias("value"))
    nested.coalesce(1).write.text(path)
    sizes = results.read_problem_sizes(t.spark, path)
    exponent = F.regexp_extract("problem_size", r"(\d+)\)$", 1).cast("int")
    return sizes.withColumn("items", F.pow(F.lit(2.0), exponent % 60).cast("bigint"))


@query("metric_csv_round_trip", SQL["pass_at_k"])
def _(t):
    """A metric table as CSV, and back."""
    path = _run_folder(t, "metrics")
    table = QUERIES["pass_at_k"](t.spark, t.folder)
    results.write_table(table, path)
    return t.spark.read.option("header", True).schema(table.schema).csv(path)
