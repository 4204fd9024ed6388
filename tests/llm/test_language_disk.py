"""What the language operator keeps on disk: no shuffle of a finished job, no staged table that nothing reads any more."""

import pathlib
import random
import sys
import time

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import language_id, queries  # noqa: E402
from gridloom.runtime import CLEANUP_CONF, stage, stage_root  # noqa: E402

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "le de ou eau é qu ai on è un".split()}


def rows_of(rng, n):
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 5)))
    langs = [rng.choice(["en", "fr"]) for _ in range(n)]
    return [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(langs)] + [(n, None, "en"), (n + 1, "1 2 3", None), (None, "the on", "en")]


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in pathlib.Path(d.getPath()).rglob("shuffle_*")}


def gone(spark, before):
    """Files of shuffles since ``before``, once Spark had time to delete them."""
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


@pytest.mark.parametrize("setting", [None, "false", "true"])
def test_a_staged_table_leaves_no_shuffle_files(spark, setting):
    if setting is not None:
        spark.conf.set(CLEANUP_CONF, setting)
    try:
        before = shuffle_files(spark)
        made = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert spark.conf.get(CLEANUP_CONF, None) == setting  # the caller's setting stays
        assert not gone(spark, before)
        assert sorted(r["count"] for r in made.collect()) == [142] * 1 + [143] * 6
    finally:
        spark.conf.unset(CLEANUP_CONF)


def test_the_query_keeps_only_what_its_result_reads(spark, tmp_path):
    table = spark.createDataFrame(rows_of(random.Random(3), 90), "doc_id long, text string, lang string")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    root = pathlib.Path(stage_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    made = queries.QUERIES["op7_language_id"](spark, str(tmp_path))
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before} == {"totals"}
    assert made.count() == 93 and len({r.lang_pred for r in made.collect()}) == 3


def test_shares_do_not_change_a_result(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(random.Random(4), 60), "doc_id long, text string, lang string").repartition(3)
    results = []
    for shares in (1, 4):
        monkeypatch.setattr(language_id, "SHARES", shares)
        model = language_id.train(docs.where("doc_id % 3 != 1"), words=5, grams=3)
        results.append({r.doc_id: (r.lang_pred, pytest.approx(r.score)) for r in language_id.predict(docs, model).collect()})
        language_id.forget(model)
    assert results[0] == results[1] and len(results[0]) == 63
    language_id.forget(language_id.train(docs.where("false")))  # a model of nothing has no tables


def test_known_words_are_looked_up_once(spark, monkeypatch):
    """Words outside the cache meet the words of the model in one join; only unknown ones are staged once more."""
    docs = spark.createDataFrame([(f"the on w{i} x{i}", ["en", "fr"][i % 2]) for i in range(40)], "text string, lang string")
    model = language_id.train(docs, words=3, grams=3)
    asked = docs.select(F.concat("text", F.lit(" new "), F.lit("new zzz")).alias("text")).repartition(3)
    staged = []
    monkeypatch.setattr(language_id, "unstage", lambda *frames: None)
    monkeypatch.setattr(language_id, "stage", lambda df, label, **options: staged.append((label, stage(df, label, **options))) or staged[-1][1])
    made = language_id.predict(asked, model)
    entries = {r.entry for _, df in staged if "entry" in df.columns for r in df.select("entry").collect()}
    assert entries == {"new", "zzz"}
    assert made.count() == 40 and {label for label, _ in staged} == {"texts", "tails", "tries", "rated", "totals"}


@pytest.mark.parametrize("cache", [0, 5])
def test_grams_of_words_around_a_piece(spark, monkeypatch, cache):
    rng = random.Random(5)
    lengths = [1, 2, *range(language_id.PIECE - 4, language_id.PIECE + 3), 2 * language_id.PIECE - 2, 2 * language_id.PIECE - 1, 300]
    rows = [("".join(rng.choice("abé\U0001f600") for _ in range(k)), rng.choice(["en", "fr"])) for k in lengths]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), words=cache, grams=cache)
    padded = [f" {w} " for w, _ in rows]
    grams = {w[i : i + k] for w in padded for k in language_id.ORDERS for i in range(len(w) - k + 1)}
    assert {r.entry for r in model["grams"].collect()} == grams
