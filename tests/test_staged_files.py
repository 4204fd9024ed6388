"""How many files staged tables are: each costs a process or two where folders are local, and a request where they are not."""

import pathlib

from gridloom.runtime import stage


def test_rounds_of_few_pairs_write_few_files(spark, monkeypatch):
    from gridloom.operators import graph

    files = []

    def counted(df, label, **options):
        made = stage(df, label, **options)
        files.append((label, sorted(p.name for p in pathlib.Path(made._staged_at.removeprefix("file://")).iterdir() if p.name[0] not in ".")))
        return made

    monkeypatch.setattr(graph, "stage", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400) if i % 40], "src long, dst long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = {r.id: r.component for r in graph.component_labels(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert labels == {i: (i - 1) // 40 * 40 + 1 for i in range(1, 401)}
    assert not any("_SUCCESS" in names for _, names in files)
    assert all(len(names) == 1 for _, names in files[1:]) and len(files) > 4  # the first, not counted yet, has a file of each partition
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 100)
    assert {r.id: r.component for r in graph.component_labels(edges).collect()} == labels
