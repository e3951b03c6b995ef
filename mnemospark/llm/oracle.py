"""DuckDB SQL for the queries that SQL can express, by query name."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BLANKS = r"list_filter(string_split_regex(" + _LOWER + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of the decimal doc_id: a byte goes in, then eight steps of one bit (marked 256).
_CRC = """xor(4294967295, list_reduce([4294967295::UBIGINT] || flatten(list_transform(
    range(1, length(doc_id::VARCHAR) + 1), lambda p: [ascii((doc_id::VARCHAR)[p]), 256, 256, 256, 256, 256, 256, 256, 256]))::UBIGINT[],
    lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END))"""

ORACLE = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANKS.format("text")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
classes AS (SELECT list_sort(s) AS c, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY 1),
sizes AS (SELECT id, len(c) AS n, c FROM classes),
flat AS (SELECT id, n, unnest(c) AS x FROM sizes),
common AS (
  SELECT a.id AS u, b.id AS v, a.n AS nu, b.n AS nv, count(*) AS m FROM flat a JOIN flat b
  ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * m >= 80 * (nu + nv - m)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS a, u AS b FROM both_ways UNION SELECT r.a, l.v FROM reach r JOIN both_ways l ON r.b = l.u),
found AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles,
  coalesce(f.component, c.id, s.doc_id) AS component_id, coalesce(f.component, c.id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.c LEFT JOIN found f ON f.id = c.id
""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_LETTERS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_LETTERS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, win, len(win) AS n FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda p: w[p:p + 12])) AS win
    FROM i WHERE len(w) > 0)),
places AS (
  SELECT doc_id, l.n, unnest(range(1, len(w) - l.n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM windows) l WHERE len(w) >= l.n),
grams AS (SELECT doc_id, n, p, w[p:p + n - 1] AS g FROM places),
hits AS (SELECT g.doc_id, g.p, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.g = x.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_ROW} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN sha256({_ROW} || {_FIELD.format("replace(text, chr(10), '')")}) ELSE leaf END AS shown
  FROM documents),
sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM documents GROUP BY source),
placed AS (
  SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
nodes AS (
  SELECT tree, n, 0 AS level, pos, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, n, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes
  WHERE n > 3 ** level GROUP BY tree, n, level, pos // 3),
tops AS (SELECT tree, digest FROM nodes WHERE n <= 3 ** level),
crown AS (
  SELECT (SELECT count(*) FROM tops) AS n, 0 AS level, tree AS pos, digest FROM tops
  UNION ALL
  SELECT n, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 3 ** level GROUP BY n, level, pos // 3),
all_nodes AS (SELECT tree, n, level, pos, digest FROM nodes UNION ALL SELECT -1, n, level, pos, digest FROM crown),
beside AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM all_nodes a JOIN all_nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.n > 3 ** a.level GROUP BY ALL),
walk AS (
  SELECT doc_id, leaf, tree AS own, pos AS rank, tree, 0 AS level, pos, shown AS folded, '' AS proof, n FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, w.rank, w.tree, w.level + 1, w.pos // 3,
    sha256(b.before || w.folded || b.after), w.proof || b.before || b.after, w.n
  FROM walk w JOIN beside b ON w.tree = b.tree AND w.level = b.level AND w.pos = b.pos),
up AS (
  SELECT doc_id, leaf, own, rank, 0 AS level, own AS pos, folded, proof FROM walk WHERE n <= 3 ** level
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, w.rank, w.level + 1, w.pos // 3,
    sha256(b.before || w.folded || b.after), w.proof || b.before || b.after
  FROM up w JOIN beside b ON b.tree = -1 AND w.level = b.level AND w.pos = b.pos),
root AS (SELECT digest, level FROM crown WHERE n <= 3 ** level)
SELECT u.doc_id, u.leaf, t.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256,
  u.folded AS folded_root, u.folded = r.digest AS verified
FROM up u JOIN root r ON u.level = r.level JOIN tops t ON u.own = t.tree
""",
}
