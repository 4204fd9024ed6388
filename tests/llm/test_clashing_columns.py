"""Tables whose own columns are called as helper columns are."""

import pathlib
import random
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from gridloom.llm import decontamination, language_id, near_duplicates  # noqa: E402
from gridloom.llm.common import free_name  # noqa: E402

OWN = ["_key", "_LANG", "_score", "_guess", "_text_key", "_score_"]


def test_free_names(spark):
    df = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in OWN))
    assert free_name(df, "_key") == "_key_" and free_name(df, "_lang") == "_lang_" and free_name(df, "_score") == "_score__" and free_name(df, "x") == "x"


def test_columns_of_the_table_survive(spark, tmp_path):
    rng = random.Random(3)
    words = "river stone cloud paper green winter lamp road seven quiet north glass bread song field metal ship".split()
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    item = " ".join(rng.choices(words, k=40))
    rows = [(k, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in OWN]) for k, t in enumerate([*texts, texts[0], f"{texts[1][:80]} {item}", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))

    def kept(df):
        assert df.columns == docs.columns
        for r in df.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in OWN)
            yield r.doc_id

    assert sorted(kept(near_duplicates.one_of_each_group(docs))) == [*range(12), 13, 14]
    assert sorted(kept(decontamination.without_items(docs, items))) == [*range(13), 14]
    assert sorted(kept(corpus_pipeline.identify_language(spark, docs, str(tmp_path)))) == [*range(14)]
    marked = language_id.predict(docs, language_id.train(docs))
    assert [c for c in marked.columns if c not in ("lang_pred", "score")] == docs.columns and marked.count() == 15
