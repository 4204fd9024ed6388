"""Manifest against trees built one by one, and its query against SQL."""

import hashlib
import pathlib
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import merkle_manifest  # noqa: E402

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, grp string, f0 string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level, arity):
    levels = [level]
    while len(level) > 1:
        level = [h("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        levels.append(level)
    return levels


def path(levels, i, arity):
    steps = []
    for level in levels[:-1]:
        lo = i // arity * arity
        steps.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + arity])))
        i //= arity
    return steps


def expected(rows, spoil, arity=3):
    """Counts of (doc_id, leaf, subroot, root, proof, folded root)."""
    groups = {}
    for r in rows:
        leaf = of(r[0], r[3], r[2], r[4], r[1])
        text = None if r[1] is None else r[1].replace("\n", "")
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf, of(r[0], r[3], r[2], r[4], text) if spoil(r[0]) else leaf, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = tree([g[2] for g in groups[s]], arity)
    top = tree([trees[s][-1][0] for s in names], arity)
    found = Counter()
    for k, s in enumerate(names):
        for i, (_, _, leaf, other, doc_id) in enumerate(groups[s]):
            steps = path(trees[s], i, arity) + path(top, k, arity)
            node = other
            for a, b in steps:
                node = h(a + node + b)
            found[(doc_id, leaf, trees[s][-1][0], top[-1][0], tuple(steps), node)] += 1
    return found


def made(df, **options):
    forged = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows = merkle_manifest.manifest(df, FIELDS, forged, **options).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof), r.folded_root) for r in rows)


def even(doc_id):
    return doc_id is not None and doc_id % 2 == 0


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(100_000), sum(sizes.values()))
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["", "a\nb\n", "é汉\n", "plain", None, "\n\n"])
            rows.append((ids.pop(), text, rng.choice(["en", None, ""]), source, rng.choice([3, None]), 1, "g", "f"))
    return rows


@pytest.mark.parametrize("sizes, levels", [
    ({"one": 1}, 2), ({"a": 4}, 2), ({"a": 9, "b": 10, "c": 1, "d": 3}, 2), ({"hot": 200, None: 5, "": 2, "é": 27, "z": 28}, 2), ({f"s{k}": 1 + k % 5 for k in range(40)}, 1),
])
def test_manifest(spark, sizes, levels):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert made(df, levels=levels) == expected(rows, even)


def test_other_arity_and_default_blocks(spark):
    rows = rows_of({"a": 30, "b": 7, "c": 1})
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(df, arity=2, levels=3) == expected(rows, even, 2)
    assert made(df) == expected(rows, even)


def test_ties_nulls_and_long_texts(spark):
    rows = rows_of({"a": 12, None: 6})
    rows += [rows[0], rows[0], (rows[1][0], "other", None, "a", 1, 1, "g", "f"), (None, "x\ny", "en", "a", 1, 1, "g", "f"), (None, None, None, None, None, 1, "g", "f")]
    rows += [(200_000, "long\n" * 300_000, "en", "a", 1, 1, "g", "f")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert made(df, levels=2) == expected(rows, even)


def test_an_empty_table(spark):
    assert not made(spark.createDataFrame([], SCHEMA))


def test_blocks_take_one_shuffle(spark):
    nodes = spark.range(500).selectExpr("id % 2 AS g", "id AS rank", "string(id) AS digest", "struct(id) AS payload")
    plan = merkle_manifest.roll_up(nodes, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_proofs_are_handed_down_without_a_join(spark):
    nodes = spark.range(500).selectExpr("id % 2 AS g", "id div 2 AS rank", "string(id) AS digest", "struct(id) AS payload")
    blocks = merkle_manifest.roll_up_all(nodes, ["g"], 3, 2)
    assert len(blocks) == 3
    tops = blocks[-1].select("g", F.array().cast(merkle_manifest.STEPS).alias("steps"), F.col("digest").alias("above"))
    found = merkle_manifest.hand_down(blocks, ["g"], tops, 3, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and found.count() == 500


def test_query_matches_sql(spark):
    import duckdb

    from gridloom.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = db.execute(SQL["op12_merkle_manifest"])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(r) for r in result.fetchall())
    got = QUERIES["op12_merkle_manifest"](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
