"""Work over several runs: every failure point, replays, fresh checkpoints, null keys, hot keys."""

import pathlib
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridloom.plans import corpus
from gridloom.streaming import flows, incremental

RULES = {"loop": {"C": ["for"], "Python": ["while", "for "]}, "call": {"C": ["("]}}
FILES = [("for (;;)", "C"), ("while x:", "Python"), ("f()", "C"), (None, "C"), ("for", None), ("for i in x", "Python"), ("", "Go")]


class Stopped(RuntimeError):
    pass


@pytest.fixture
def source(spark, tmp_path):
    """Six files, one row or two in each."""
    for k in range(6):
        rows = spark.createDataFrame([FILES[k], FILES[(k * 3 + 1) % 7]], "content string, lang string")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def counted(spark, source, root, fail_at=None, **options):
    def hook(batch):
        if batch == fail_at:
            raise Stopped(f"stop {batch}")

    files = flows.file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    query = incremental.resumable_counts(files, f"{root}/store", f"{root}/check", rules=RULES, before_snapshot=hook, **options)
    assert query.awaitTermination(120)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_survive_failures(spark, source, tmp_path):
    want = rows_of(corpus.usage_by_language(spark.read.parquet(source), rules=RULES))
    assert incremental.read_counts(spark, f"{tmp_path}/store") is None
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for fail_at in (0, 2, 2, 5):
            with pytest.raises(StreamingQueryException, match=f"stop {fail_at}"):
                counted(spark, source, tmp_path, fail_at)
            assert incremental.last_commit(spark, f"{tmp_path}/store") == (fail_at - 1 if fail_at else None)
            spark.conf.set("spark.sql.shuffle.partitions", 3 + fail_at)
        counted(spark, source, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert rows_of(incremental.read_counts(spark, f"{tmp_path}/store")) == want
    assert incremental.last_commit(spark, f"{tmp_path}/store") == 5


def test_a_batch_replayed_after_its_log_row_counts_once(spark, source, tmp_path):
    counted(spark, source, tmp_path)
    want = rows_of(incremental.read_counts(spark, f"{tmp_path}/store"))
    for hidden in ("", "."):  # the stream forgets that the last batch was done; its log still has the files
        for name in (f"{hidden}5", f"{hidden}5.crc"):
            (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    counted(spark, source, tmp_path)
    assert rows_of(incremental.read_counts(spark, f"{tmp_path}/store")) == want


def test_a_snapshot_without_a_log_row_is_not_read(spark, source, tmp_path):
    counted(spark, source, tmp_path)
    want = rows_of(incremental.read_counts(spark, f"{tmp_path}/store"))
    spark.createDataFrame([("C", 99, 99, 99)], "lang string, files long, loop long, call long").write.parquet(f"{tmp_path}/store/snapshots/batch=6")
    assert rows_of(incremental.read_counts(spark, f"{tmp_path}/store")) == want


ITEMS = "k string, o long, v string"


def put(spark, path, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(path))


def appended(spark, tmp_path, check, work=lambda df: df, **options):
    stream = flows.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    assert incremental.append_new(stream, f"{tmp_path}/out", f"{tmp_path}/{check}", ["k"], work, **options).awaitTermination(120)
    return {(r.k, r.o, r.v) for r in incremental.read_new(spark, f"{tmp_path}/out").collect()}, incremental.read_new(spark, f"{tmp_path}/out").count()


def test_results_over_batches_runs_and_replays(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), ("b", 1, None)])
    put(spark, tmp_path / "in", [("a", 0, "late"), ("c", 1, "c"), (None, 0, "late")])
    first = {("a", 1, "y"), (None, 5, "n"), ("b", 1, None), ("c", 1, "c")}
    assert appended(spark, tmp_path, "one", order="o") == (first, 4)
    for name in ("1", ".1.crc"):
        (tmp_path / "one" / "commits" / name).unlink()
    assert appended(spark, tmp_path, "one", order="o") == (first, 4)  # batch 1 once more
    put(spark, tmp_path / "in", [("b", 0, "late"), ("d", 1, "d")])
    assert appended(spark, tmp_path, "two", order="o") == (first | {("d", 1, "d")}, 5)  # from the start again
    assert appended(spark, tmp_path, "one", order="o") == (first | {("d", 1, "d")}, 5)  # its own end of the stream
    runs = {r.run for r in incremental.read_new(spark, f"{tmp_path}/out").collect()}
    assert runs == {incremental.run_name(f"{tmp_path}/one"), incremental.run_name(f"{tmp_path}/two")}


def test_a_failure_between_results_and_index(spark, tmp_path, monkeypatch):
    """Results without an index entry are written over, not added to."""
    put(spark, tmp_path / "in", [("a", 1, "x"), ("b", 1, "y")])
    kept = incremental.bucket_of
    calls = []

    def work(df):
        calls.append(1)
        if len(calls) == 1:
            df.write.parquet(f"{tmp_path}/out/results/run={incremental.run_name(f'{tmp_path}/one')}/batch=0")
            raise Stopped("between")
        return df

    with pytest.raises(StreamingQueryException, match="between"):
        appended(spark, tmp_path, "one", work, order="o")
    assert incremental.bucket_of is kept and not pathlib.Path(f"{tmp_path}/out/keys").exists()
    assert appended(spark, tmp_path, "one", work, order="o") == ({("a", 1, "x"), ("b", 1, "y")}, 2)


def test_work_may_drop_rows_and_columns(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 1, "x"), ("b", 2, "y")])
    put(spark, tmp_path / "in", [("a", 3, "z")])
    seen = []

    def work(df):
        seen.append({r.k for r in df.collect()})
        return df.where("o > 1").select(F.length("v").alias("n"))

    stream = flows.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    assert incremental.append_new(stream, f"{tmp_path}/out", f"{tmp_path}/c", ["k"], work).awaitTermination(120)
    assert seen == [{"a", "b"}, set()]  # an item without a result is finished too
    with pytest.raises(ValueError, match="must not be called"):
        incremental.append_new(stream, f"{tmp_path}/out", f"{tmp_path}/c", ["run"])


def test_a_batch_reads_only_its_own_folders_of_the_index(spark, tmp_path):
    put(spark, tmp_path / "in", [(f"k{i}", i, "x") for i in range(200)])
    appended(spark, tmp_path, "one", buckets=32)
    assert len(list(pathlib.Path(f"{tmp_path}/out/keys").glob("bucket=*"))) == 32
    some = incremental.finished_keys(spark, f"{tmp_path}/out", [3, 7, 99])
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} == {"3", "7"}
    assert set(some.columns) == {"k", "bucket", "run", "batch"}
    assert incremental.finished_keys(spark, f"{tmp_path}/out", [99]) is None and incremental.finished_keys(spark, f"{tmp_path}/out", []) is None


def cached(spark, tmp_path, check, **options):
    stream = flows.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    assert incremental.cache_responses(stream, f"{tmp_path}/cache", f"{tmp_path}/{check}", ["k"], **options).awaitTermination(180)
    counts = {r.k: (r.requests, r.reused) for r in incremental.reuse_counts(spark, f"{tmp_path}/cache", ["k"]).collect()}
    return {(r.k, r.o, r.v) for r in incremental.read_cache(spark, f"{tmp_path}/cache").collect()}, counts


def test_responses_are_kept_in_state(spark, tmp_path):
    store = spark.conf.get(incremental.STATE_STORE)
    put(spark, tmp_path / "in", [("a", 2, "x"), ("a", 1, 'y"\n'), (None, None, "n"), ("b", 1, None), *[("hot", i, f"v{i}") for i in range(30_000)]])
    put(spark, tmp_path / "in", [("a", 0, "late"), ("c", 1, "c"), (None, 0, "late"), ("hot", -1, "late")])
    first = {("a", 1, 'y"\n'), (None, None, "n"), ("b", 1, None), ("c", 1, "c"), ("hot", 0, "v0")}
    counts = {"a": (3, 2), None: (2, 1), "b": (1, 0), "c": (1, 0), "hot": (30_001, 30_000)}
    assert cached(spark, tmp_path, "one", order="o") == (first, counts)
    assert spark.conf.get(incremental.STATE_STORE) == store
    shutil.copytree(tmp_path / "cache", tmp_path / "before")
    for name in ("1", ".1.crc"):
        (tmp_path / "one" / "commits" / name).unlink()
    assert cached(spark, tmp_path, "one", order="o") == (first, counts)  # a replay
    # another run starts from the cache
    put(spark, tmp_path / "in", [("d", 1, "d")])
    again = {k: (2 * n, 2 * n - 1) for k, (n, _) in counts.items()} | {"d": (1, 0)}
    assert cached(spark, tmp_path, "two", order="o") == (first | {("d", 1, "d")}, again)


def test_nothing_there_yet(spark, tmp_path):
    assert incremental.read_new(spark, f"{tmp_path}/x") is None and incremental.read_cache(spark, f"{tmp_path}/x") is None
    assert incremental.last_commit(spark, f"{tmp_path}/x") is None
