"""The cleaning pipeline on a small table with planted cases."""

import pathlib
import random
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone cloud paper green winter lamp road seven quiet north glass bread song field metal ship".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


def planted():
    rng = random.Random(21)
    clean = [(i, prose(rng, 60)) for i in range(20)]
    passage, item = prose(rng, 60), prose(rng, 35)
    rows = [*clean, (30, clean[0][1]), (31, clean[1][1] + " end"), (40, f"{prose(rng, 50)} {passage} {prose(rng, 40)}"), (41, f"{prose(rng, 70)} {passage} {prose(rng, 30)}")]
    rows += [(50, f"{prose(rng, 40)} {item}"), (60, None), (61, "12 34"), (62, "")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], passage, item, {i for i, _ in clean}


def test_stages(spark, tmp_path):
    rows, passage, item, clean = planted()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.dtypes == [tuple(c.split()) if "long" not in c else (c.split()[0], "bigint") for c in COLUMNS.split(", ")]
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        assert clean <= set(left[name])
    assert not {60, 61, 62} & set(left["language"]) and {30, 31} <= set(left["language"])
    assert not {30, 31} & set(left["near_duplicates"])
    cut = left["repeated_passages"]
    assert passage in left["near_duplicates"][40] and passage[5:-5] not in cut[40] + cut[41] and cut[40] and cut[41]
    assert 50 in cut and 50 not in left["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left["decontamination"])
