"""A task of these stages needs one Python worker: a second function in it would start another, and workers stay."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from gridloom.llm import queries  # noqa: E402

PASSAGE = "ein längerer Satz über Öl, den mehrere Texte wörtlich enthalten " * 10
OTHER = "".join(f"{i * i} " for i in range(150))
ROWS = [(1, "a " + PASSAGE + " end é"), (2, "é\U0001f600" + PASSAGE), (3, "short é"), (4, None), (5, ""), (None, PASSAGE), (7, "x" + OTHER + "é tail"), (8, "y" + OTHER + "è tail")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "de", "web", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def evaluations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_passages_are_cut_by_one_function(spark, docs):
    cut = corpus_pipeline.remove_repeated_passages(spark, docs, "")
    assert evaluations(cut) == 1
    found = {r.doc_id: r for r in cut.collect()}
    assert [found[i].text for i in (3, 4, 5)] == ["short é", None, ""] and found[4].n_chars == 0
    # a cut inside a character leaves none of it
    assert found[1].text == "a end é" and found[2].text == "é\U0001f600" and found[None].text == ""
    assert found[7].text == "x tail" and found[8].text == "y tail"
    assert all(r.n_chars == len(r.text or "") for r in found.values()) and found[1].lang == "de"


def test_op2_cuts_by_one_function(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.QUERIES["op2_suffix_array_dedup"](spark, str(tmp_path))
    assert evaluations(made) == 1
    assert {r.doc_id: r.kept_text for r in made.collect()} == {1: "a end é", 2: "é\U0001f600", 3: "short é", 4: None, 5: "", None: "", 7: "x tail", 8: "y tail"}
