"""Operators for training data against brute force, on small tables with nulls, ties, empty and very long texts."""

import hashlib
import pathlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import (  # noqa: E402
    decontamination, language_id, lattice_lm, license_scan, metric_join, near_duplicates, packing, quality, repeated_passages, token_output, tokens,
)

WORDS = "the of and river stone cloud paper green winter lamp road seven quiet north glass bread song field metal ship".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows with every odd case: null ids and texts, repeated rows, equal ids, near copies, one very long text."""
    rng = random.Random(5)
    base = prose(rng, 150)
    edited = base.split()
    edited[20] = "changed"
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    rows += [(50, base), (51, base), (52, " ".join(edited)), (53, base.upper()), (50, prose(rng, 9)), (60, None), (61, ""), (62, " \t\n"), (None, base), (None, None)]
    rows += [(70, "two words"), (71, "Two\twords"), (80, "x" * 3000), (81, prose(rng, 9000)), (82, "é" * 700 + base), (0, rows[0][1])]
    return [(i, t, None if i and i % 7 == 0 else "en", None, None, "k", "n") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [2]


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_encoder_gives_the_ids_of_the_tokenizer():
    rng = random.Random(1)
    parts = ["a", "B9", " ", "  ", "\n", "\t", "é", "'s", "!", "<|endoftext|>", " ", "汉", "\x85", "word"]
    encoder = tokens.Encoder(tokens.default_vocabulary())
    for text in ["", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300))]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_packing(docs, corpus):
    out = packing.pack(packing.cut_pieces(docs, 64), capacity=64).collect()
    want = Counter()
    for i, t, *_ in corpus:
        ids = ids_of(t)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    filled: dict = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.05 * -(-sum(r.length for r in out) // 64) + 1


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 200))), reverse=True)
        gaps = []
        for s in sizes:
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(30 - s)
            else:
                gaps.remove(fit)
                gaps.append(fit - s)
        rows, opened = packing.plan_runs(dict(Counter(sizes)), 30)
        assert opened == len(gaps) and sum(r[2] - r[1] for r in rows) == len(sizes)
    assert packing.plan_runs({}, 30) == ([], 0)


def test_a_length_beyond_the_capacity_fails(spark):
    with pytest.raises(Exception, match="outside 1..capacity"):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), capacity=8).collect()


@pytest.mark.parametrize("length,shard", [(80, 1_500_000), (80, 2000), (400, 1_500_000)])
def test_repeated_passages(docs, corpus, length, shard, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SHARD_BYTES", shard)
    out = repeated_passages.remove_repeats(docs, length).collect()
    seen = Counter()
    for _, t, *_ in corpus:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = Counter()
    for i, t, *_ in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] > 1:
                gone[x] += 1
                gone[x + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        want[(i, len(b), int(mask.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())] += 1
    got = Counter((r.doc_id, r._n_bytes, sum(s.hi - s.lo for s in r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) for r in out)
    assert got == want


def test_suffix_array_finds_all_repeats_in_a_shard():
    rng = random.Random(3)
    for _ in range(20):
        shared = bytes(rng.choices(b"ab", k=200))
        pieces = [b"a" * 150] + [bytes(rng.choices(b"ab", k=40)) + shared[(a := rng.randint(0, 90)) : a + rng.randint(60, 110)] + b"c" * rng.randint(0, 30) for _ in range(6)]
        pieces = [p for p in pieces if len(p) >= 80]
        count = Counter(p[i : i + 80] for p in pieces for i in range(len(p) - 79))
        for p, hit in zip(pieces, repeated_passages.shard_repeats(pieces, 80)):
            assert hit.tolist() == [count[p[i : i + 80]] > 1 for i in range(len(p) - 79)]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, corpus):
    out = near_duplicates.near_duplicates(docs, words=3, percent=85).collect()
    sets = [shingles(t, 3) for _, t, *_ in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = reach(range(len(sets)), links)
    lowest: dict = {}
    for k, r in root.items():
        i = corpus[k][0]
        if i is not None and (lowest.get(r) is None or i < lowest[r]):
            lowest[r] = i
    want = Counter((corpus[k][0], len(sets[k]), lowest.get(r)) for k, r in root.items())
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_one_of_each_group_keeps_the_columns(docs):
    left = near_duplicates.one_of_each_group(docs, words=3, percent=85)
    assert left.columns == docs.columns
    texts = Counter(r.text for r in left.collect())
    assert sum("changed" in (t or "") for t in texts) == 0 and max(n for t, n in texts.items() if t and t.split()) == 1


def test_one_of_each_group_keeps_a_row_of_every_group(spark, corpus):
    """Null ids and repeated ids join no groups: what is linked with nothing stays."""
    rng = random.Random(31)
    same = prose(rng, 80)
    rows = [r[:2] for r in corpus] + [(None, prose(rng, 60)) for _ in range(4)] + [(None, same), (None, same + " end"), (1, prose(rng, 60)), (1, same.upper())]
    left = near_duplicates.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=3, percent=85)
    sets = [shingles(t, 3) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    groups: dict = {}
    for k, r in reach(range(len(rows)), links).items():
        groups.setdefault(r, []).append(rows[k])
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    assert sum(kept.values()) == len({r if sets[r] else rows[r] for r in groups})
    for members in groups.values():
        lowest = min((i is None, i or 0) for i, _ in members)
        assert sum(kept[m] for m in set(members)) == 1 and any(kept[m] for m in members if (m[0] is None, m[0] or 0) == lowest)


def test_bands_follow_the_limit(spark, monkeypatch):
    for percent in range(1, 101):
        bands, rows = near_duplicates.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert near_duplicates.banding(85) == (64, 10)
    used, sign = [], near_duplicates.signatures
    monkeypatch.setattr(near_duplicates, "signatures", lambda rows, words, *banding: used.append(banding) or sign(rows, words, *banding))
    table = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert near_duplicates.one_of_each_group(table).count() == 1 and (1 - 0.8 ** used[0][1]) ** used[0][0] <= 1e-6


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = near_duplicates.sketch(np.unique(x[:2000]), 512), near_duplicates.sketch(np.unique(x[1000:]), 512)
    assert abs((a == b).mean() - 1 / 3) < 0.08
    assert near_duplicates.sketch(x[:1], 512).max() < np.iinfo(np.uint64).max


def test_decontamination(spark, docs):
    rng = random.Random(8)
    item = prose(rng, 40)
    changed = item.replace("e", "E", 3)[:50] + "xyz" + item[50:]
    items = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, item), (5, prose(rng, 30))], "item_id long, text string")
    table = spark.createDataFrame(
        [(1, f"before {item} after"), (2, f"so {changed}."), (3, item[: len(item) // 2]), (4, None), (5, ""), (None, item.upper().replace(" ", "\n")), (7, prose(rng, 500))], "doc_id long, text string"
    )
    hits = {(r.doc_id, r.item_id): r.distance for r in decontamination.find_items(table, items).collect()}
    assert hits == {(1, 1): 0, (1, 4): 0, (2, 1): 3, (2, 4): 3, (None, 1): 0, (None, 4): 0}
    assert {r.doc_id for r in decontamination.without_items(table, items).collect()} == {3, 4, 5, 7}
    assert decontamination.find_items(docs, items.limit(0)).count() == 0


def test_edit_distance():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(6)
    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(1, 90)))
        hit = decontamination.myers(p, t, len(p) - 1)
        assert (hit[0] if hit else len(p)) == min(slow(p, t), len(p))


def test_license_scan(spark, docs):
    rng = random.Random(9)
    long = dict(license_scan.NOTICES)["MIT-permission"]
    table = spark.createDataFrame([
        (1, prose(rng, 300) + " licensed under the APACHE license, version 2.0! " + prose(rng, 40)), (2, prose(rng, 90) + "\n" + long), (3, None), (4, ""),
        (5, " ".join(long.split()[:14])), (None, "Released under the MIT License."), (7, prose(rng, 2000)),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in license_scan.find_licenses(table).collect()}
    assert {k for k in got} == {(1, "Apache-2.0"), (2, "MIT-permission"), (None, "MIT")} and min(c for c, _ in got.values()) == 1.0
    assert license_scan.find_licenses(docs, license_scan.templates(spark).limit(0)).count() == 0
    plan = license_scan.find_licenses(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_lattice_sums_over_all_segmentations():
    texts = [lattice_lm.MARK, "a", "b", "ab", lattice_lm.MARK + "a", "ba"]
    weights = np.array([4, 3, 2, 2, 1, 1, 1.0] + [0.01] * 256)
    logp = np.log(weights / weights.sum())
    p = dict(zip(texts, np.exp(logp)))

    def total(word):
        return 1.0 if not word else sum(p.get(word[:k], 0) * total(word[k:]) for k in range(1, len(word) + 1))

    got, expected = lattice_lm.Lattice(texts, logp).words(["abab", "", "aé"], np.ones(3))
    byte = float(np.exp(logp[-1]))
    for g, w in zip(got, [total(lattice_lm.MARK + "abab"), total(lattice_lm.MARK), total(lattice_lm.MARK + "a") * byte**2]):
        assert np.isclose(np.exp(g), w)
    assert np.isclose(expected[len(texts) + 1 :].sum(), 2)


def test_language_model_scores(docs, corpus, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAD", 10)
    out = lattice_lm.score_texts(docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))).collect()
    counts, rows = Counter(), []
    for i, t, *_ in corpus:
        w = [*(t or "").encode().lower().split(), None]
        rows.append((i, w))
        if i is None or i % 4:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i is not None, i or 0), len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(np.isfinite(r.score) and r.score < 0 for r in out)


def test_language_id(spark, docs):
    rng = random.Random(11)
    other = "der die und nicht ein haus berg wald wasser licht strasse".split()
    rows = [(i, prose(rng, 30) if i % 2 else " ".join(rng.choices(other, k=30)), "en" if i % 2 else "de") for i in range(60)]
    model = language_id.train(spark.createDataFrame([*rows, (90, None, "fr"), (91, "x", None)], "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en"]
    cases = ["strassen und berge", "quietly northern", "123 !?", "", None, "ü", "wasser " * 50_000]
    got = {r.text: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame([(c,) for c in cases], "text string"), model).collect()}
    assert got["strassen und berge"][0] == "de" and got["quietly northern"][0] == "en" and got["wasser " * 50_000][0] == "de"
    assert got["123 !?"] == got[""] == got[None] == ("und", 0.0) and got["ü"][0] in ("de", "en") and all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_id_reads_words_to_their_end(spark):
    """The characters behind the first 40 of an unspaced text teach and decide as those before them do."""
    rng = random.Random(13)
    plain = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [("x" * 45 + plain("abcde", 200), "p") for _ in range(20)] + [("x" * 45 + plain("vwyzu", 200), "q") for _ in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    cases = {"x" * 45 + plain("abcde", 90): "p", "x" * 45 + plain("vwyzu", 90): "q", plain("abcde", 100) + plain("vwyzu", 5000): "q", plain("vwyzu", 100) + plain("abcde", 5000): "p"}
    got = language_id.predict(spark.createDataFrame([(c,) for c in cases], "text string"), model).collect()
    assert {r.text: r.lang_pred for r in got} == cases


@pytest.mark.parametrize("words,grams", [(60_000, 20_000), (3, 2)])
def test_language_id_knows_all_words_and_grams(spark, words, grams):
    """The cache may be smaller than the tables: every score is that of the whole counts."""
    rng = random.Random(17)
    name = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    own = {"hot": [name("abcdefgh") for _ in range(120)], "rare": [name("efghijkl") for _ in range(40)]}
    rows = [(" ".join(rng.choices(own[g], k=20)), g) for g, many in (("hot", 60), ("rare", 3)) for _ in range(many)]
    cases = [" ".join(rng.choices(own[g], k=3) + [name("cdefghijkl")]) for g in ("hot", "rare") * 15] + ["zzz", "é fg", rows[0][0]]
    counts, tables = {g: Counter() for g in own}, {order: {g: Counter() for g in own} for order in range(1, 6)}
    for t, g in rows:
        counts[g].update(t.split())
        for w in t.split():
            for order, table in tables.items():
                table[g].update(f" {w} "[i : i + order] for i in range(len(w) + 3 - order))
    sizes = {g: sum(c.values()) for g, c in counts.items()}

    def logs(table, entry):
        both = sum(c[entry] for c in table.values())
        return np.array([np.log10((table[g][entry] + 0.5 * both / sum(sizes.values())) / (sizes[g] + 0.5)) for g in own]) if both else None

    def rated(w):
        if (known := logs(counts, w)) is not None:
            return known
        for order in range(5, 0, -1):
            found = [x for i in range(len(w) + 3 - order) if (x := logs(tables[order], f" {w} "[i : i + order])) is not None]
            if found:
                return sum(found) / len(found)
        return np.zeros(2)

    model = language_id.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), words=words, grams=grams)
    out = language_id.predict(spark.createDataFrame([(c,) for c in cases * 2], "text string"), model).collect()
    assert len(out) == 2 * len(cases)
    for r in out:
        x = sum(map(rated, r.text.split()))
        assert r.lang_pred == ("hot", "rare")[int(x.argmax())] and np.isclose(r.score, 1 / (10 ** (x - x.max())).sum())


def test_token_output_round_trip(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "order")
    rows = token_output.write_training_order(docs, path, seq_len=16, shard_rows=100).collect()
    read = {r.slot: r.ids for r in token_output.read_training_order(spark, path, 16, 100).collect()}
    assert sorted(read) == list(range(len(rows))) == sorted(r.slot for r in rows)
    got = Counter((r.doc_id, r.piece, tuple(read[r.slot])) for r in rows)
    want = Counter((i, k, tuple(ids[a : a + 16])) for i, t, *_ in corpus for ids in [ids_of(t)] for k, a in enumerate(range(0, len(ids), 16)))
    assert got == want
    late = token_output.read_training_order(spark, path, 16, 100, from_slot=150)
    assert sorted(r.slot for r in late.collect()) == list(range(150, len(rows)))
    for total in (1, 2, 7, 1000):
        assert sorted(token_output.permuted(range(total), total, 9).tolist()) == list(range(total))


@pytest.mark.parametrize("cell", [2048, 8])
def test_vector_links(spark, cell, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", cell)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.12).tolist(), i % 3) for i in range(90)]
    rows += [(100, rows[0][1], 0), (100, rows[0][1], 0), (None, rows[1][1], 1), (101, None, 1), (102, [0.0] * 8, 1), (103, [float("nan")] * 8, 1), (104, [1.0, None], 1), (105, rows[3][1], None), (106, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    out = metric_join.vector_links(table, 0.93).collect()
    good = [label is not None and v is not None and len(v) == 8 and all(np.isfinite(v)) and any(v) for _, v, label in rows]
    links = []
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and good[a] and good[b] and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a, b))
    count, root = Counter(a for a, _ in links), reach(range(len(rows)), links)
    lowest: dict = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            lowest[r] = min(lowest.get(r, rows[k][0]), rows[k][0])
    want = Counter((rows[k][0], count[k], lowest.get(r)) for k, r in root.items())
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == want


def test_quality(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 80) + "." if i % 3 else "".join(w + "$$$ " for w in prose(rng, 60).split())) for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 3 > 0)) for i in range(200)), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 240)]
    assert sum(held) >= 39 and all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    plain = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, plain).collect()} == {0.5}


def test_empty_tables(spark, empty, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert packing.pack(packing.cut_pieces(empty)).count() == 0
    assert repeated_passages.remove_repeats(empty).count() == near_duplicates.near_duplicates(empty).count() == 0
    assert license_scan.find_licenses(empty).count() == metric_join.vector_links(vectors).count() == 0
    assert lattice_lm.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert token_output.write_training_order(empty, str(tmp_path / "none")).count() == 0


def test_license_lines_across_blocks_of_words(spark):
    """A notice is found wherever it stands in a long text, at the place where it stands, also across the border of two blocks."""
    rng, mit = random.Random(4), "Released under the MIT License."
    places = [0, 1, 248, *range(252, 259), 511, 1020, 1995]
    texts = [(p, (prose(rng, p) + " " + mit + " " + prose(rng, 2000 - p)).strip()) for p in places]
    got = license_scan.find_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == [(p, "MIT", 1.0) for p in places]
    assert all(r.first_word <= r.doc_id <= r.first_word + 8 for r in got)


def test_short_notices_are_found_whole(spark):
    """A notice of fewer than five words is one shingle: found at its place, also at the end and across blocks, never in part."""
    rng = random.Random(14)
    texts = [(p, prose(rng, p) + " All rights reserved. " + prose(rng, 700 - p)) for p in (0, 254, 255, 256, 700)]
    texts += [(1000, "all rights were reserved"), (1001, "rights reserved"), (1002, "SPDX-License-Identifier: MIT"), (1003, "")]
    table = spark.createDataFrame([(i, t.strip()) for i, t in texts], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.containment, r.first_word) for r in license_scan.find_licenses(table).collect())
    assert got == [(p, "All-rights-reserved", 1.0, p) for p in (0, 254, 255, 256, 700)]
    own = spark.createDataFrame([("spdx", "SPDX-License-Identifier: MIT"), ("one", "Reserved"), ("none", "!?")], "license string, text string")
    got = {(r.doc_id, r.license): r.first_word for r in license_scan.find_licenses(table, own).collect()}
    assert got == {(1002, "spdx"): 0, (1000, "one"): 3, (1001, "one"): 1} | {(p, "one"): p + 2 for p in (0, 254, 255, 256, 700)}


@pytest.mark.parametrize("block", [50_000, 7])
def test_lattice_sums_over_cuts_of_long_words(block, monkeypatch):
    """A word of more than 200 characters is scored as shorter ones are: over all of its segmentations."""
    monkeypatch.setattr(lattice_lm, "BLOCK", block, raising=False)
    texts = [lattice_lm.MARK, "a", "b", "ab", lattice_lm.MARK + "a", "bab", "aa"]
    weights = np.array([4, 3, 2, 2, 1, 1, 1.0] + [0.01] * 256)
    logp = np.log(weights / weights.sum())
    lattice, rng = lattice_lm.Lattice(texts, logp), random.Random(15)
    for word in ["ab" * 300, "".join(rng.choices("abé", k=777)), "a" * 199, "a" * 200, "ab" * 99 + "é"]:
        full = lattice_lm.MARK + word
        total = [0.0] + [-np.inf] * len(full)
        for j in range(1, len(full) + 1):
            arcs = [total[j - len(t)] + x for t, x in zip(texts, logp) if full[:j].endswith(t)]
            total[j] = np.logaddexp.reduce(arcs + [total[j - 1] + 2 * logp[-1]] * (full[j - 1] == "é"))
        got, expected = lattice.words([word], np.full(1, 3.0))
        assert np.isclose(got[0], total[-1])
        # each character is covered by one piece, "é" by two bytes
        assert np.isclose(expected[: len(texts)] @ list(map(len, texts)) + expected[len(texts) :].sum() / 2, 3 * len(full))
        chars = np.frombuffer(full.encode("utf-32-le"), "<u4").reshape(1, -1).astype(np.uint64)
        assert np.allclose(lattice.sums(chars, np.full(1, 3.0))[1], expected)
