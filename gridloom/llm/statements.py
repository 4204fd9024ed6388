"""DuckDB SQL that states the results of queries of this subpackage."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

#: spoilt: the crc32 of the id is even, hence its register before the last inversion odd
SQL["op12_merkle_manifest"] = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, lang, n_chars,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda r, zero: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) % 2 = 1 AS spoilt
  FROM documents),
texts AS (SELECT *, CASE WHEN spoilt THEN replace(text, chr(10), '') ELSE text END AS other FROM fields),
leaves AS (
  SELECT doc_id, source, sha256(head || {text}) AS leaf, sha256(head || {other}) AS forged,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || {text})) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, {head} AS head FROM texts)),
nodes AS (
  SELECT 0 AS level, source, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, source, i // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3, n),
runs AS (
  SELECT a.level, a.source, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
upper_runs AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM upper a JOIN upper b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2),
levels AS (SELECT unnest(range(40)) AS level),
steps AS (
  SELECT d.source, d.i, v.level, t.l, t.r FROM leaves d CROSS JOIN levels v
  JOIN runs t ON t.level = v.level AND t.source IS NOT DISTINCT FROM d.source AND t.i = d.i // CAST(pow(3, v.level) AS BIGINT) WHERE pow(3, v.level) < d.n),
upper_steps AS (
  SELECT s.source, 100 + v.level AS level, t.l, t.r FROM subroots s CROSS JOIN levels v
  JOIN upper_runs t ON t.level = v.level AND t.i = s.i // CAST(pow(3, v.level) AS BIGINT) WHERE pow(3, v.level) < s.n),
proofs AS (
  SELECT d.source, d.i, list({{'l': p.l, 'r': p.r}} ORDER BY p.level) FILTER (p.level IS NOT NULL) AS path FROM leaves d
  LEFT JOIN (SELECT source, i, level, l, r FROM steps UNION ALL SELECT u.source, d.i, u.level, u.l, u.r FROM upper_steps u JOIN leaves d ON u.source IS NOT DISTINCT FROM d.source) p
    ON d.source IS NOT DISTINCT FROM p.source AND d.i = p.i GROUP BY 1, 2),
folded AS (
  SELECT d.doc_id, d.leaf, s.subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(list_reduce(list_prepend('', list_transform(path, lambda p: p.l || p.r)), lambda a, b: a || b), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': d.forged, 'r': ''}}, coalesce(path, [])), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root
  FROM leaves d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source JOIN proofs p ON d.source IS NOT DISTINCT FROM p.source AND d.i = p.i)
SELECT *, folded_root = root AS verified FROM folded
""".format(head=_HEAD, text=_field("text"), other=_field("other"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """
reach AS (
  SELECT x AS id, x AS root FROM links UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.id),
lowest AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)"""

SQL["op4_minhash_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),{_REACH}
SELECT s.doc_id, len(s) AS n_shingles, coalesce(root, s.doc_id) AS component_id, coalesce(root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN lowest l ON l.id = s.doc_id"""

SQL["op9_embedding_near_dedup"] = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN lowest l ON l.id = vec_id"""
