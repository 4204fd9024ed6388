"""Prompt files as a data source: what is written, what is planned, what is read."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from gridloom.sources import prompt_tree, results

COLUMNS = ["problem_type", "language", "name", "parallelism_model", "prompt"]
ODD = ["a/b", "_hidden", ".dot", "50%", "é 汉", "x+y", "a%2Fb", "..", "q?*[1]{2}#"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "problem_type string, name string, parallelism_model string, prompt string")


def files_of(root, task_bytes=64 << 20, **select):
    """Files of each planned task."""
    reader = prompt_tree.TreeReader({"path": str(root), "taskBytes": str(task_bytes), "select": json.dumps(select)})
    return [[path.removeprefix(str(root) + "/") for _, path in p.files] for p in reader.partitions()]


@pytest.fixture
def tree(spark, tmp_path):
    root = tmp_path / "tree"
    rows = [(t, f"n{k}", m, f"{t} {k}\n{m}") for t in ("scan", "sort") for k in range(5) for m in ("omp", "mpi+omp", "serial")]
    prompt_tree.write_prompt_tree(frame(spark, rows).repartition(4), str(root))
    return root


def test_any_name_survives(spark, tmp_path):
    rows = [(t, n, "mpi+omp", f"{t}\r\n{n}") for t in ODD for n in ODD] + [("t", "n", "serial", ""), ("t", "n", "omp", None)]
    root = str(tmp_path / "odd")
    prompt_tree.write_prompt_tree(frame(spark, rows), f"file://{root}")
    got = prompt_tree.read_prompt_tree(spark, root)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, "cpp", n, m, p or "") for t, n, m, p in rows)
    assert not list(pathlib.Path(root).rglob("_*"))  # no hidden file is left behind
    for name in ODD:
        assert prompt_tree.read_prompt_tree(spark, root).where(F.col("name") == name).count() == len(ODD)


def test_only_matching_files_are_planned(tree):
    assert sum(map(len, files_of(tree))) == 30
    got = files_of(tree, parallelism_model=["mpi+omp"], name=["n1", "n3", "n9", "n1"])
    assert got == [[f"{t}/{n}/mpi+omp" for t in ("scan", "sort") for n in ("n1", "n3")]]
    assert files_of(tree, problem_type=[]) == [] and files_of(tree, problem_type=["none"]) == []


def test_other_files_are_not_opened(spark, tree):
    (tree / "scan" / "n0" / "serial").write_bytes(b"\xff\xfe")  # cannot be read as text
    rows = prompt_tree.read_prompt_tree(spark, str(tree), parallelism_model=["omp"]).where("prompt LIKE 'sc%'")
    assert {(r.problem_type, r.name) for r in rows.collect()} == {("scan", f"n{k}") for k in range(5)}
    with pytest.raises(Exception, match="decode"):
        prompt_tree.read_prompt_tree(spark, str(tree), parallelism_model=["serial"]).collect()
    assert prompt_tree.read_prompt_tree(spark, str(tree), name=["none"]).count() == 0
    with pytest.raises(ValueError, match="do not come from the path"):
        prompt_tree.read_prompt_tree(spark, str(tree), prompt=["x"])


def test_branches_of_a_query_do_not_share_a_filter(spark, tree):
    rows = prompt_tree.read_prompt_tree(spark, str(tree))
    few = rows.where("name = 'n1'")
    assert few.count() == 6 and rows.count() == 30 and few.union(rows.where("name = 'n2'")).union(rows).count() == 42
    assert rows.join(few.where("parallelism_model = 'omp'"), ["problem_type", "name", "parallelism_model"], "left_anti").count() == 28
    narrow = prompt_tree.read_prompt_tree(spark, str(tree), name=["n1"])
    assert narrow.union(rows).count() == 36


def test_tasks_follow_the_sizes(spark, tree):
    (tree / "sort" / "n4" / "omp").write_text("x" * 5_000_000)
    parts = files_of(tree, 2 << 20)
    assert ["sort/n4/omp"] in parts and max(map(len, parts)) == 7 and sum(map(len, parts)) == 30
    rows = prompt_tree.read_prompt_tree(spark, str(tree), 2 << 20)
    assert rows.rdd.getNumPartitions() == len(parts) and rows.agg(F.max(F.length("prompt"))).first()[0] == 5_000_000


def test_files_in_wrong_places(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "scan" / "n0" / "omp").mkdir(parents=True)
    with pytest.raises(Exception, match="omp to be a file"):
        prompt_tree.read_prompt_tree(spark, str(root)).collect()
    (root / "loose").write_text("x")
    with pytest.raises(ValueError, match="loose to be a directory"):
        files_of(root)
    (root / "_SUCCESS").write_text("")
    assert files_of(root, problem_type=["scan"], parallelism_model=["mpi"]) == []
    (tmp_path / "empty").mkdir()
    assert prompt_tree.read_prompt_tree(spark, str(tmp_path / "empty")).count() == 0


def test_what_the_writer_refuses(spark, tree):
    with pytest.raises(ValueError, match="2 prompts for t/n/omp"):
        prompt_tree.write_prompt_tree(frame(spark, [("t", "n", "omp", "a"), ("t", "n", "omp", "b")]), str(tree))
    with pytest.raises(Exception, match="needs a problem type"):
        prompt_tree.write_prompt_tree(frame(spark, [("t", None, "omp", "a")]), str(tree))
    with pytest.raises(Exception, match="only added to"):
        prompt_tree.read_prompt_tree(spark, str(tree)).write.format("prompt_tree").mode("overwrite").save(str(tree))
    again = frame(spark, [("scan", "n0", "omp", "new")])
    prompt_tree.write_prompt_tree(again, str(tree))
    prompt_tree.write_prompt_tree(again, str(tree))
    rows = prompt_tree.read_prompt_tree(spark, str(tree))
    assert rows.count() == 30 and rows.where("name = 'n0' AND parallelism_model = 'omp' AND problem_type = 'scan'").first().prompt == "new"


def test_ranked_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", "omp")], "name string, parallelism_model string")
    for k, label in enumerate(["b c", "a%b", "é"]):
        rows.withColumn("prompt", F.lit(label)).withColumn("outputs", F.array(F.lit("x"))).repartition(2).write.mode("append").json(f"{tmp_path}/{label}/results.json")
    got = results.read_ranked_results(spark, f"{tmp_path}/*/results.json", lines=True)
    assert sorted((r.source_rank, r.prompt) for r in got.collect()) == [(0, "a%b"), (1, "b c"), (2, "é")]
    assert {r.source_file for r in got.collect()} == {f"{tmp_path}/{label}/results.json" for label in ("b c", "a%b", "é")}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "r.json").write_text('[{"name": "q"}]')
    single = results.read_ranked_results(spark, f"file://{tmp_path}/one/r.json").first()
    assert (single.name, single.source_rank, single.source_file) == ("q", 0, f"{tmp_path}/one/r.json")
