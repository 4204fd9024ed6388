"""Results pipeline: ingest, metrics, prompts, text, restore, run logs, corpus counts and streams."""

import json
from math import comb

import numpy as np
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from gridloom.functions import estimators, text
from gridloom.functions.rules import MODELS, launch_rows
from gridloom.plans import corpus, evaluation, ingest, metrics, prompts, restore
from gridloom.sources import generators, results
from gridloom.streaming import flows, incremental


def evaluated(code="x; }", built=True, runs=(), baseline=1.0):
    return {
        "generated_output": code, "source_write_success": True, "did_build": built, "is_source_valid": True,
        "did_any_run": built, "did_all_run": built, "are_any_valid": built,
        "are_all_valid": built and all(r["is_valid"] for r in runs),
        "best_sequential_runtime": baseline if built else None, "runs": list(runs) if built else None,
    }


def run(valid=True, runtime=1.0, **config):
    return {"did_run": True, "is_valid": valid, "runtime": runtime, **config}


def record(name, model, outputs, kind="sort", **extra):
    return {
        "problem_type": kind, "language": "cpp", "name": name, "parallelism_model": model, "prompt": f"/* {name} */\nvoid f(int x) {{",
        "temperature": 0.2, "top_p": 0.95, "do_sample": True, "max_new_tokens": 1024, "outputs": outputs, **extra,
    }


@pytest.fixture(scope="module")
def nested():
    """Every awkward case: never built, null and 64 threads, one invalid of several, few samples, runtime 0."""
    rng = np.random.default_rng(5)
    omp = [1, 2, 4, 8, 16, 32, 64]
    data = []
    for n, kind in (("p0", "sort"), ("p1", "scan"), ("p2", "sort")):
        data.append(record(n, "omp", [
            evaluated(runs=[run(rng.random() < 0.9, float(rng.uniform(0, 2)), num_threads=t) for t in omp], baseline=float(rng.uniform(1, 5)))
            for _ in range(7)
        ] + [evaluated(built=False)], kind, prompted=True))
        data.append(record(n, "serial", [evaluated(runs=[run(True, float(r))]) for r in rng.uniform(0, 3, 25)], kind))
        data.append(record(n, "mpi+omp", [
            evaluated(runs=[run(True, float(rng.uniform(0, 2)), num_procs=p, num_threads=t) for p, t in ((1, 8), (4, 64), (2, 64))])
            for _ in range(3)
        ], kind))
        data.append(record(n, "cuda", [evaluated(runs=[run(True, 0.0)]), evaluated(runs=[run(False, 1.0)])], kind))
    data.append(record("p0", "kokkos", [evaluated(runs=[run(True, 1.0), run(True, 0.5, num_threads=64), run(True, 0.7, num_threads=32)])]))
    data.append(record("p3", "mpi", [evaluated(built=False), evaluated(built=False)]))
    data.append(record("p4", "omp", ["only text"]))
    data.append(record("p5", "omp", []))
    return data


@pytest.fixture(scope="module")
def flat(spark, nested, tmp_path_factory):
    path = tmp_path_factory.mktemp("nested") / "results.json"
    path.write_text(json.dumps(nested))
    return ingest.flatten_runs(results.read_results(spark, str(path))).cache()


SIZES = {"p0": {"cuda": "(1<<10)"}, "p1": {"cuda": "(1<<3)", "omp": "(1<<4)"}, "p2": {"cuda": "(1<<5)"}}


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sizes") / "sizes.json"
    path.write_text(json.dumps(SIZES, indent=1))
    return results.read_problem_sizes(spark, str(path))


def plain_rows(nested):
    for p in nested:
        if not p["outputs"] or isinstance(p["outputs"][0], str):
            continue
        for oi, o in enumerate(p["outputs"]):
            for ri, r in enumerate(o["runs"] if o["runs"] is not None else [{}]):
                yield {
                    "name": p["name"], "model": p["parallelism_model"], "type": p["problem_type"], "oi": oi,
                    "ri": ri if o["runs"] is not None else None, "built": o["did_build"], "base": o["best_sequential_runtime"],
                    "valid": bool(r.get("is_valid")), "t": r.get("runtime"), "th": r.get("num_threads"), "pr": r.get("num_procs"),
                }


def test_flatten(nested, flat):
    got = sorted((r.name, r.parallelism_model, r.output_idx, -1 if r.run_idx is None else r.run_idx, r.runtime, r.prompted) for r in flat.collect())
    prompted = {(p["name"], p["parallelism_model"]): p.get("prompted", False) for p in nested}
    want = sorted((r["name"], r["model"], r["oi"], -1 if r["ri"] is None else r["ri"], r["t"], prompted[r["name"], r["model"]]) for r in plain_rows(nested))
    assert got == want
    assert [(r.name, r.parallelism_model) for r in ingest.never_built(flat).collect()] == [("p3", "mpi")]


def expected_metrics(nested, ks, strict=False):
    """Loops over plain dicts; nothing shared with the library."""
    rows = [r for r in plain_rows(nested) if not (r["model"] == "kokkos" and r["th"] == 64)]
    size = lambda r: 2 ** int(SIZES[r["name"]]["cuda"][4:-1])
    ncr = lambda n, r: (0 if strict else 1) if n < r else comb(n, r)

    def grouped(items):
        out = {}
        for r in items:
            out.setdefault((r["name"], r["model"], r["type"]), []).append(r)
        return out

    def outputs_of(items):
        out = {}
        for r in items:
            out.setdefault((r["name"], r["model"], r["oi"]), []).append(r)
        return out

    def chance(n, c, k):
        return 1.0 if n - c < k else 1 - comb(n - c, k) / comb(n, k)

    def mean_by(values):
        out = {}
        for (_, model, kind), v in values.items():
            out.setdefault((model, kind), []).append(v)
        return {key: float(np.mean(v)) for key, v in out.items()}

    table = {}
    for k in ks:
        table[f"build@{k}"] = mean_by({g: chance(len(rs), sum(r["built"] for r in rs), k) for g, rs in grouped(rows).items()})
        verdicts = [{**rs[0], "ok": all(r["valid"] for r in rs)} for rs in outputs_of(rows).values()]
        table[f"pass@{k}"] = mean_by({g: chance(len(rs), sum(r["ok"] for r in rs), k) for g, rs in grouped(verdicts).items()})

        def score(items, resources=None):
            out = {}
            for g, rs in grouped(items).items():
                times, base, n = sorted(r["t"] for r in rs), min(r["base"] for r in rs), len(rs)
                res = [resources(r) for r in rs] if resources else [1] * n
                if strict and n < k:
                    continue
                out[g] = sum(ncr(j - 1, k - 1) * base / (ncr(n, k) * max(times[j - 1], 1e-8) * res[j - 1]) for j in range(1, n + 1))
            return mean_by(out)

        valid = [r for r in rows if r["valid"]]
        at = {"kokkos": lambda r: r["th"] == 32, "omp": lambda r: r["th"] == 32, "mpi": lambda r: r["pr"] == 512,
              "mpi+omp": lambda r: (r["pr"], r["th"]) == (4, 64)}
        fixed = [r for r in valid if at.get(r["model"], lambda r: True)(r)]
        charge = {"kokkos": 32, "omp": 8, "mpi": 512, "mpi+omp": 256}
        table[f"speedup@{k}"] = score(fixed)
        table[f"efficiency@{k}"] = score(fixed, lambda r: size(r) if r["model"] == "cuda" else charge.get(r["model"], 1))
        best = [{**rs[0], "t": min(r["t"] for r in rs)} for rs in outputs_of(valid).values() if any(r["ri"] == 0 for r in rs)]
        table[f"speedup_max@{k}"] = score(best)

        def used(r):
            return {"cuda": lambda: size(r), "omp": lambda: r["th"], "kokkos": lambda: r["th"], "mpi+omp": lambda: r["pr"] * r["th"]}.get(r["model"], lambda: 1)()

        cheapest = [min((r for r in rs if used(r) is not None), key=lambda r: (r["t"] * used(r), r["ri"])) for rs in outputs_of(valid).values()]
        table[f"efficiency_max@{k}"] = score(sorted(cheapest, key=lambda r: r["oi"]), used)
    return table


@pytest.mark.parametrize("strict", [False, True])
def test_metric_table(nested, flat, sizes, strict):
    ks = [1, 5, 20]
    runs = ingest.clean_runs(ingest.with_problem_size(flat, sizes))
    table = metrics.metric_table(runs, ks, strict=strict, model_name="m")
    assert metrics.report_names(table).columns[:3] == ["model", "execution model", "problem type"]
    expected = expected_metrics(nested, ks, strict)
    rows = table.collect()
    assert len(rows) == len({(r["model"], r["type"]) for r in plain_rows(nested)})
    for row in rows:
        key = (row["parallelism_model"], row["problem_type"])
        for column, values in expected.items():
            assert row[column] == pytest.approx(values.get(key, 0.0), rel=1e-9), (key, column)


def test_per_output_builds(nested, flat, sizes):
    runs = ingest.clean_runs(flat)
    got = {(r[0], r[1]): r[2] for r in metrics.build_at_k(runs, [1], per_output=True).collect()}
    assert got["omp", "scan"] == pytest.approx(7 / 8)
    got = {(r[0], r[1]): r[2] for r in metrics.build_at_k(runs, [1]).collect()}
    assert got["omp", "scan"] == pytest.approx(49 / 50)


@pytest.mark.parametrize("k", [1, 3])
def test_scaling_table(nested, flat, k):
    ns = [1, 8, 64, 512]
    table = metrics.scaling_table(ingest.clean_runs(flat, drop_kokkos_64=False), "omp", k, ns)
    rows = [r for r in plain_rows(nested) if r["model"] == "omp" and r["valid"]]
    for row in table.collect():
        for n in ns:
            scores = []
            for name in sorted({r["name"] for r in rows if r["type"] == row["problem_type"]}):
                mine = [r for r in rows if r["name"] == name and r["th"] == n]
                if mine:
                    times, base = sorted(r["t"] for r in mine), min(r["base"] for r in mine)
                    pick = lambda a, b: 1 if a < b else comb(a, b)
                    scores.append(sum(pick(j - 1, k - 1) * base / (pick(len(mine), k) * max(times[j - 1], 1e-8)) for j in range(1, len(mine) + 1)))
            want = np.mean(scores) if scores else 0.0
            assert row[f"speedup_{n}@{k}"] == pytest.approx(want)
            assert row[f"efficiency_{n}@{k}"] == pytest.approx(want / n)


def test_estimators(spark):
    cases = [(n, c, k) for n in (1, 5, 20) for c in range(0, n + 1, 2) for k in (1, 3, 20)]
    df = spark.createDataFrame(cases, "n long, c long, k long")
    for k in (1, 3, 20):
        for r in df.where(F.col("k") == k).withColumn("p", estimators.success_at_k(F.col("n"), F.col("c"), k)).collect():
            assert r.p == pytest.approx(1.0 if r.n - r.c < k else 1 - comb(r.n - r.c, k) / comb(r.n, k))
        for r in df.select("n", estimators.choose(F.col("n"), k).alias("a"), estimators.choose(F.col("n"), k, True).alias("b")).collect():
            assert (r.a, r.b) == (pytest.approx(comb(r.n, k) if r.n >= k else 1), pytest.approx(comb(r.n, k)))


def test_states_and_selection(spark):
    rows = [("a", ["t"]), ("b", ['{"generated_output": "c"}']), ("c", ["t", "{}"]), ("d", []), ("e", None)]
    df = spark.createDataFrame(rows, "name string, outputs array<string>")
    states = {r.name: r.s for r in df.select("name", ingest.result_state(F.col("outputs")).alias("s")).collect()}
    assert states == {"a": "none", "b": "all", "c": "mixed", "d": "none", "e": "missing"}
    good = df.where("name in ('a', 'b', 'd')")
    assert sorted(r.name for r in ingest.pending(good).collect()) == ["a", "d"]
    assert {r.name: r.outputs for r in ingest.pending(good, overwrite=True).collect()}["b"] == ["c"]
    with pytest.raises(Exception, match="outputs are mixed"):
        ingest.pending(df.where("name = 'c'")).collect()
    table = spark.createDataFrame([("a", "omp", "x"), ("b", "mpi", "x"), ("c", "omp", "y")], "name string, parallelism_model string, problem_type string")
    pick = lambda **kw: sorted(r.name for r in ingest.select_prompts(table, **kw).collect())
    assert (pick(include=["omp"]), pick(exclude=["omp"]), pick(problem="c"), pick(problem_type="x")) == (["a", "c"], ["b"], ["c"], ["a", "b"])


def test_csv_cache_and_parquet_round_trips(spark, flat, tmp_path):
    results.write_flat_csv(flat, str(tmp_path / "csv"))
    back = results.read_flat_csv(spark, str(tmp_path / "csv"))
    want = results.escape_newlines(flat).select(back.columns)
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    results.write_runs(flat, str(tmp_path / "pq"))
    stored = spark.read.parquet(str(tmp_path / "pq")).where("parallelism_model = 'omp'")
    assert "PartitionFilters: [isnotnull(parallelism_model" in stored._jdf.queryExecution().toString()
    cache = spark.createDataFrame([record("a", "omp", ["x"], prompted=False)], results.RESULTS)
    for _ in range(2):
        results.append_cache(cache, str(tmp_path / "cache"))
    assert results.read_cache(spark, str(tmp_path / "cache")).count() == 2
    results.write_table(spark.range(3).toDF("id"), str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).count() == 3


HEADER = "/* Example\n   input: 1\n   output: 2\n*/\n"
PROMPTS = {
    "serial": HEADER + "void f(int x) {",
    "omp": HEADER.replace("Ex", "OpenMP Ex") + "void f(int x) {",
    "mpi": HEADER.replace("Ex", "MPI initialized Ex") + "void f(int x) {",
    "mpi+omp": HEADER.replace("Ex", "MPI OpenMP initialized Ex") + "void f(int x) {",
    "kokkos": HEADER.replace("Ex", "Kokkos initialized Ex") + "void f(int x) {",
    "cuda": HEADER.replace("Ex", "CUDA thread Ex") + "__global__ void f(int x) {",
    "hip": HEADER.replace("Ex", "AMD HIP thread Ex") + "__global__ void f(int x) {",
}


@pytest.fixture
def prompt_tree(spark, tmp_path):
    for name in ("30_scan_a", "31_scan_b"):
        folder = tmp_path / "raw" / "scan" / name
        folder.mkdir(parents=True)
        for model, body in PROMPTS.items():
            if (name, model) != ("31_scan_b", "hip"):
                (folder / model).write_text(body.replace("CUDA", "CUDA HIP") if name == "31_scan_b" and model == "cuda" else body)
    return results.read_prompt_tree(spark, str(tmp_path / "raw"))


def test_prompt_tree_lint_and_preparation(prompt_tree):
    rows = prompt_tree.collect()
    assert len(rows) == 13 and {r.parallelism_model for r in rows} == set(MODELS) and {r.problem_type for r in rows} == {"scan"}
    bad = prompts.lint(prompt_tree).collect()
    assert [(r.name, r.violations) for r in bad] == [("31_scan_b", ["contains HIP"])]
    assert [(r.name, r.missing) for r in prompts.incomplete_problems(prompt_tree).collect()] == [("31_scan_b", ["hip"])]
    good = prompt_tree.where("name = '30_scan_a'")
    assert prompts.require_valid(good).count() == 7
    with pytest.raises(Exception, match="invalid prompt 31_scan_b"):
        prompts.require_valid(prompt_tree).collect()
    renamed = {r.parallelism_model: r.prompt for r in prompts.prepare(good, "model", includes=True).collect()}
    assert renamed["mpi+omp"].startswith("#include <mpi.h>\n#include <omp.h>\n\n/*") and renamed["mpi+omp"].endswith("void fMPIOpenMP(int x) {")
    assert renamed["hip"].endswith("__global__ void fHIP(int x) {") and renamed["serial"] == PROMPTS["serial"]
    assert prompts.prepare(good, "parallel").first().prompt.endswith("fParallel(int x) {")


def text_of(spark, fn, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(fn(*[F.col(k) for k in values]).alias("v")).first().v


def test_function_names(spark):
    name = lambda p, m: text_of(spark, text.function_name, p=p, m=m)
    assert name(PROMPTS["serial"], "omp") == "f" and name(PROMPTS["cuda"], "hip") == "f"
    assert name("  double sum3(x) {\n", "serial") == "sum3"
    assert name("__global__ void k(int)", "serial") is None and name("std::vector<int> g(x) {", "serial") is None
    insert = lambda p: text_of(spark, text.insert_keyword, p=p)
    assert insert("a\nvoid f(int x) {") == "a\nvoid NO_INLINE f(int x) {" and insert("void") is None
    assert text_of(spark, lambda s: text.prefix_lines(s, "// "), s="a\nb\n") == "// a\n// b"
    assert text_of(spark, text.word_count, s=" a  b\n c ") == 3 and text_of(spark, text.word_count, s=" ") == 0


def test_clean_completion(spark):
    clean = lambda o, p: text_of(spark, text.clean_completion, o=o, p=p)
    assert clean("void f() {\n  if (x) { y; }\n  return; }\nint main() { }", "void f() {") == "if (x) { y; }\n  return; }"
    assert clean("pre void f() { a; { b;", "void f() {") == "a; { b;"
    assert clean("nothing", "void f() {") is None
    assert clean("p}", "p") == "}" and clean("p", "p") == ""


@pytest.mark.parametrize("value, expected", [("", True), ("{}", True), ("}{", False), ("{{a}b}", True), ("{", False), ("a}", False), ("{}}{", False)])
def test_balanced(spark, value, expected):
    assert text_of(spark, text.balanced, s=value) is expected


def test_clean_chat_answer(spark):
    ask = "### R\n```c++\nvoid f(int x) {```\n### Response"

    def clean(answer):
        df = spark.createDataFrame([(answer, ask)], "o string, p string")
        return text.clean_chat_answers(df, "o", "p", "### Response").first().code

    assert clean("x ### Response\n```\nvoid f(int x) { a; { b; } }\nint z;\n```\n") == " a; { b; } }"
    assert clean("### Response\n```\nint g;\n```\ntext\n```\nvoid f(int x) { a; }\n```") == " a; }"
    assert clean("### Response\n```\nreturn 1;\n```") == "return 1;"
    assert clean("### Response\n```c++\nvoid f(int x) { a;") == " a;}"
    assert clean("### Response\nplain") == "plain"
    assert clean("no tag") is None
    assert clean("### Response\n```\nf }\n```") == "f }"


def test_offline_and_fences(spark):
    offline = lambda p, o: text_of(spark, text.clean_offline, p=p, o=o)
    assert offline("a\nvoid f() {", "void f() { x;") == " x;}"
    assert offline("a\nvoid f() {", " x; }") == " x; }"
    assert offline("a\n", "x") == "x}"
    fences = lambda o, p, mode: text_of(spark, lambda a, b: text.strip_fences(a, b, mode), o=o, p=p)
    assert fences("```cpp\nbody }\n```", "P", "affix") == "\nbody }\n" and fences("```cpp\nx```", "P", "chars") == "\nx"
    assert fences("```printf();```", "P", "chars") == "rintf();" and fences("```printf();```", "P", "affix") == "printf();"
    assert fences("Pbody", "P", "affix") == "body"


def test_prompt_styles(spark):
    style = lambda p, s: text_of(spark, lambda a: text.format_prompt(a, s), p=p)
    assert style(" x {\n", "plain") == "x {"
    assert style("a {", "file_comment").endswith("exercise\n\na {")
    chat = style("/* {x} */\nvoid f(int x) {", "chat")
    assert "```c++/* {x} */\nvoid f(int x) {```\nWrite only the function f and no other code" in chat and chat.endswith("<|im_start|>assistant\n")
    assert style("void f(int x) {", "body") == "Complete the C++ function f. Only write the body of the function f.\n\n```cpp\nvoid f(int x) {\n```\n"


def test_translation_prompts(spark):
    table = spark.createDataFrame(
        [("scan", "cpp", "a", m, PROMPTS[m]) for m in MODELS] + [("scan", "cpp", "b", m, PROMPTS[m]) for m in ("serial", "omp")],
        results.PROMPT,
    )
    done = spark.createDataFrame(
        [("a", "serial", "2.json", 0, "late", True), ("a", "serial", "1.json", 3, "second", True), ("a", "serial", "1.json", 1, "code;\n}", True),
         ("a", "serial", "1.json", 0, "wrong", False), ("b", "serial", "1.json", 0, "wrong", False), ("a", "cuda", "1.json", 0, "gpu", True)],
        "name string, parallelism_model string, source_file string, output_idx int, generated_output string, are_all_valid boolean",
    )
    got = {(r.name, r.translation_src_model, r.translation_dst_model): r for r in prompts.translation_prompts(table, done).collect()}
    assert set(got) == {("a", "serial", "omp"), ("a", "serial", "mpi"), ("a", "cuda", "kokkos")}
    row = got["a", "serial", "omp"]
    assert row.translation_src_example == PROMPTS["serial"] + "\ncode;\n}"
    lines = "\n".join("// " + line for line in row.translation_src_example.splitlines())
    assert row.translation_prompt == f"// Serial implementation of f\n{lines}\n\n// OpenMP implementation of f\n{PROMPTS['omp']}\n"
    with pytest.raises(Exception, match="more than one source prompt"):
        prompts.translation_prompts(table.union(table.where("parallelism_model = 'serial'")), done).collect()


def test_restore(spark):
    ask = spark.createDataFrame([("a", "omp", "pa"), ("b", "omp", "pb"), ("c", "mpi", "pc")], "name string, parallelism_model string, prompt string")
    old = spark.createDataFrame(
        [("a", "omp", "pa", 0.2, 0.9, True, 10, False, ["x", "y"], 2), ("a", "omp", "pa", 0.2, 0.9, True, 11, False, ["z", "w"], 1),
         ("b", "omp", "pb", 0.2, 0.9, True, 10, False, ["x"], 3), ("c", "mpi", "pc", 0.7, 0.9, True, 10, False, ["x", "y"], 4),
         ("gone", "omp", "p", 0.2, 0.9, True, 10, False, ["x", "y"], 5)],
        "name string, parallelism_model string, prompt string, temperature double, top_p double, do_sample boolean,"
        " max_new_tokens int, prompted boolean, outputs array<string>, line int",
    )
    ready = restore.usable(old, 2, 0.2, False, 0.9)
    assert sorted(r.name for r in restore.without_response(ask, ready).collect()) == ["b", "c"]
    assert sorted(r.line for r in restore.with_response(ready, ask).collect()) == [1, 2]
    kept, left = restore.split_by_response(ask, ready, "line")
    assert [r.line for r in kept.collect()] == [1] and left.count() == 2
    copied = {r.name: r.outputs for r in restore.copy_outputs(ask, ready, "line").collect()}
    assert copied == {"a": ["z", "w"], "b": None, "c": None}
    assert restore.repeat_samples(ask, 4).count() == 12 and restore.repeat_samples(ask, 0).count() == 0
    assert [r.name for r in restore.first_work(ask, ["name"], 2).collect()] == ["a", "b"]
    assert restore.all_responses(ready, ask).count() == 6
    log = spark.createDataFrame([("a", 10, 2.0), ("a", 20, 4.0), ("b", 5, 0.0)], "k string, tokens int, seconds double")
    assert {r.k: (r.responses, r.total_tokens, r.tokens_per_second) for r in restore.token_rates(log, ["k"]).collect()} == {"a": (2, 30, 5.0), "b": (1, 5, None)}


def test_run_matrix_and_logs(spark, tmp_path):
    launches = evaluation.default_launch_params(spark)
    assert len(launch_rows()) == 35 == launches.count()
    outputs = spark.createDataFrame([("a", m) for m in MODELS], "name string, parallelism_model string")
    matrix = evaluation.run_matrix(outputs, launches)
    assert matrix.count() == 35
    assert "srun -N 4 --tasks-per-node 1 -n 4 -c 64 a.out  64" in {r.command for r in matrix.collect()}
    (tmp_path / "l.json").write_text(json.dumps({"omp": {"format": "run {num_threads}", "params": [{"num_threads": 1}, {"num_threads": 2}]}, "serial": {"format": "x", "params": [{}]}}, indent=1))
    assert results.read_launch_params(spark, str(tmp_path / "l.json")).count() == 3
    logs = ["Time: 1.5\nBestSequential: 0.0005\nValidation: PASS\n", "Validation: FAIL\nTime: 2\nTime: 3", "boom", " Time: 9\nTime: x"]
    parsed = spark.createDataFrame([(v,) for v in logs], "s string").select(evaluation.parse_run_log(F.col("s")).alias("r")).select("r.*")
    assert [tuple(r) for r in parsed.collect()] == [(True, 1.5, 0.0005), (False, 3.0, None), (None, None, None), (None, None, None)]
    warned = parsed.select(evaluation.log_warnings(F.col("is_valid"), F.col("runtime"), F.col("best_sequential_runtime")).alias("w"))
    assert [r.w for r in warned.collect()] == [["baseline is very small"], [], [], []]
    checks = spark.createDataFrame([("omp", "#pragma omp"), ("mpi", "MPI_Init"), ("mpi+omp", "MPI."), ("cuda", ""), ("omp", "")], "m string, s string")
    assert [r.v for r in checks.select(evaluation.valid_source(F.col("s"), F.col("m")).alias("v")).collect()] == [True, True, False, True, False]


def test_roll_ups(spark):
    shape = "id int, runs array<struct<exit_code:int,is_valid:boolean,best_sequential_runtime:double>>"
    data = [(1, [(0, True, 2.0), (0, True, None)]), (2, [(0, True, 3.0), (1, None, None)]), (3, None), (4, [(1, None, None)]), (5, [(0, False, None)])]
    got = {r.id: tuple(r)[1:] for r in spark.createDataFrame(data, shape).select("id", *[c.alias(n) for n, c in evaluation.roll_up(F.col("runs")).items()]).collect()}
    assert got == {
        1: (True, True, True, True, True, 2.0), 2: (True, True, False, True, False, 3.0), 3: (False, False, False, False, False, None),
        4: (True, False, False, False, False, None), 5: (True, True, True, False, False, None)}
    rows = spark.createDataFrame(data, shape).select("id", F.inline("runs")).withColumn("did_run", F.col("exit_code") == 0)
    again = {r.id: tuple(r)[1:] for r in evaluation.roll_up_rows(rows, ["id"]).collect()}
    assert again == {k: v[1:] for k, v in got.items() if k != 3}


def test_stage_counts(spark):
    three = spark.createDataFrame([("p", True, True, True, True, True), ("p", True, True, True, True, False), ("p", True, True, False, None, None)],
        "name string, source_write_success boolean, is_source_valid boolean, did_build boolean, did_all_run boolean, are_all_valid boolean")
    assert tuple(evaluation.stage_counts(three, ["name"]).first()) == ("p", 3, 3, 2, 2, 1)
    assert tuple(evaluation.prompt_summary(three, ["name"]).first()) == ("p", 3, 3, 2, 2, 1)
    expected = spark.createDataFrame([("p", 3, 3, 2, 2, 2)], "name string, write int, source_valid int, build int, run int, correct int")
    assert [(r.stage, r.actual, r.expected) for r in evaluation.check_counts(three, expected, ["name"]).collect()] == [("correct", 1, 2)]
    rows = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y")], "k string, i int, v string")
    assert [[o.v for o in r.outputs] for r in evaluation.assemble(rows, ["k"], "i", ["v"]).collect()] == [["y", "z"]]


FILES = [("#include <mpi.h>\nMPI_Init", "C"), ("#pragma omp for", "C++"), ("Kokkos::View", "C++"), ("Kokkos::", "C"), ("", "Cuda"),
         ("import mpi4py", "Python"), ("!$OMP PARALLEL ", "FORTRAN"), ("MPI_", "Java"), ("x", "Java")]


def test_corpus(spark):
    files = spark.createDataFrame(FILES, "content string, lang string")
    got = {r.lang: tuple(r)[1:] for r in corpus.usage_by_language(files).collect()}
    assert got == {"C": (2, 1, 0, 0, 0), "C++": (2, 0, 1, 1, 0), "Cuda": (1, 0, 0, 0, 1), "Python": (1, 1, 0, 0, 0), "FORTRAN": (1, 0, 1, 0, 0), "Java": (2, 0, 0, 0, 0)}
    assert tuple(corpus.usage_totals(corpus.usage_by_language(files)).first()) == (9, 2, 2, 1, 1)


def test_corpus_stream_resumes(spark, tmp_path):
    files = spark.createDataFrame(FILES, "content string, lang string")
    source, snap, check = (str(tmp_path / p) for p in ("in", "snap", "check"))
    files.limit(4).write.parquet(source)
    start = lambda: flows.count_corpus(flows.file_stream(spark, source, files.schema, files_per_batch=1), snap, check).awaitTermination(120)
    assert start()
    files.subtract(files.limit(4)).write.mode("append").parquet(source)
    assert start()
    got = {tuple(r) for r in flows.latest_snapshot(spark, snap).collect()}
    assert got == {tuple(r) for r in corpus.usage_by_language(files).collect()}


def test_incremental_results_and_cache(spark, tmp_path):
    source, target, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    schema = "name string, model string"
    spark.createDataFrame([("a", "omp"), ("b", "omp"), ("a", "omp")], schema).write.json(source)

    def start():
        stream = flows.file_stream(spark, source, spark.createDataFrame([], schema).schema, "json")
        query = incremental.append_new(stream, target, check, ["name", "model"], lambda df: df.withColumn("score", F.length("name")))
        assert query.awaitTermination(120)

    start()
    spark.createDataFrame([("b", "omp"), ("c", "mpi")], schema).write.mode("append").json(source)
    start()
    rows = sorted((r.name, r.model, r.score) for r in incremental.read_new(spark, target).collect())
    assert rows == [("a", "omp", 1), ("b", "omp", 1), ("c", "mpi", 1)]
    stream = flows.file_stream(spark, source, spark.createDataFrame([], schema).schema, "json")
    assert incremental.cache_responses(stream, str(tmp_path / "cache"), str(tmp_path / "check2"), ["name", "model"]).awaitTermination(120)
    assert incremental.read_cache(spark, str(tmp_path / "cache")).count() == 3
    assert incremental.read_new(spark, str(tmp_path / "none")) is None


def test_generators(spark):
    ints = generators.random_vector(spark, 500, -3, 4, integer=True).agg(F.min("x"), F.max("x"), F.count("*")).first()
    assert tuple(ints) == (-3, 3, 500)
    words = generators.random_strings(spark, 200, 2, 10).collect()
    assert {len(r.s) for r in words} == set(range(2, 10)) and all(r.s.islower() for r in words)
    assert 0 < generators.random_digraph(spark, 20).count() < 400
    both = generators.random_graph(spark, 20).select("src", "dst")
    assert both.exceptAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0
    from gridloom.operators import graph, matrix, systems

    linked = generators.random_connected_graph(spark, 30, 0.02)
    assert one(graph.component_count(linked, spark.range(30))) == 1
    a, b, x = generators.random_linear_system(spark, 12)
    solved = systems.solve(a.withColumn("system_id", F.lit(0)), b.withColumn("system_id", F.lit(0)), "partial")
    gap = solved.join(x.withColumnRenamed("x", "truth").withColumnRenamed("i", "row"), "row").agg(F.max(F.abs(F.col("x") - F.col("truth")))).first()[0]
    assert gap < 1e-6
    coo = generators.random_coo(spark, 10, 10, 0.5, -1, 1)
    assert coo.count() == 50 and matrix.add_duplicates(coo).count() <= 50
