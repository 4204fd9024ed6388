"""Stream queries over tables that are one file or a folder of files."""

import hashlib
from pathlib import Path

import pytest

from gridloom.catalog import QUERIES
from gridloom.runtime import stage_root


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(params=["folder", "file"])
def tables(spark, tmp_path, request):
    docs = [(k, None if k == 5 else f"the {k}; le la", [None, "en", "fr"][k % 3], "src0", 9) for k in range(40)]
    turns = [(k // 2, k % 2, "user", None if k == 7 else f"turn {k % 4}") for k in range(30)]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
    }
    for name, df in frames.items():
        if request.param == "folder":
            df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            df.toPandas().to_parquet(f"{tmp_path}/{name}.parquet", index=False)
    return str(tmp_path), docs, turns


def test_marks_of_a_whole_table(spark, tables):
    folder, docs, turns = tables
    marks = {(r.lang, r.files, r.article, r.list) for r in QUERIES["streamed_marks"](spark, folder).collect()}
    of = lambda lang: [text or "" for _, text, own, *_ in docs if own == lang]
    assert marks == {
        (None, len(of(None)), 0, 0),
        ("en", len(of("en")), sum("the " in x for x in of("en")), sum("; " in x for x in of("en"))),
        ("fr", len(of("fr")), sum("le " in x or "la " in x for x in of("fr")), 0),
    }


def test_increments_of_a_whole_table(spark, tables):
    folder, docs, turns = tables
    done = sorted((r.doc_id, r.digest) for r in QUERIES["incremental_results"](spark, folder).collect())
    assert done == [(k, md5(text)) for k, text, *_ in docs]


def test_cache_of_a_whole_table(spark, tables):
    folder, docs, turns = tables
    cached = sorted((r.conv_id, r.turn, r.digest) for r in QUERIES["cached_responses"](spark, folder).collect())
    assert cached == [(c, n, md5(text)) for c, n, _, text in turns]


def test_resumed_marks_deals_a_larger_table_to_more_files(spark, tmp_path):
    """Four batches, whose files are as many as the table's own."""
    rows = spark.range(900).selectExpr("id AS doc_id", "'the ' || id AS text", "IF(id % 9 = 0, NULL, 'en') AS lang", "'src0' AS source", "9L AS n_chars")
    rows.repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    for k in before:
        spark.conf.set(k, 8192)
    try:
        marks = {tuple(r) for r in QUERIES["resumed_marks"](spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert marks == {("en", 800, 800, 0), (None, 100, 0, 0)}
    newest = max(Path(stage_root(spark).removeprefix("file://")).glob("resumed-*"), key=lambda p: p.stat().st_mtime)
    assert len(list((newest / "files").glob("*.parquet"))) == 12
    assert sorted(p.name for p in (newest / "store" / "log").glob("batch=*")) == [f"batch={k}" for k in range(4)]
