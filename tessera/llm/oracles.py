"""SQL for the operators that SQL can express on whole tables, by all pairs and recursion."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Components of pairs (a, b) over ids: the least id reachable.
REACH = """
reach AS (SELECT id, id AS r FROM nodes UNION SELECT edges.b AS id, reach.r FROM reach JOIN edges ON edges.a = reach.id),
least AS (SELECT id, MIN(r) AS component_id FROM reach GROUP BY id)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT id, e, SQRT(list_dot_product(e, e)) AS norm FROM v
         WHERE LEN(e) > 0 AND LEN(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
edges AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND LEN(x.e) = LEN(y.e)
         AND list_dot_product(x.e, y.e) >= 0.9 * x.norm * y.norm),
nodes AS (SELECT id FROM v), {REACH},
n AS (SELECT a, COUNT(*) AS n_links FROM edges GROUP BY a)
SELECT least.id AS vec_id, COALESCE(n_links, 0) AS n_links, component_id, least.id = component_id AS kept
FROM least LEFT JOIN n ON n.a = least.id"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN LEN(w) >= 4 THEN list_transform(range(1, LEN(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
      WHEN LEN(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT least.id AS doc_id, COALESCE(n, 0) AS n_shingles, component_id, least.id = component_id AS kept
FROM least LEFT JOIN n ON n.doc_id = least.id"""

QUALITY = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, source AS host, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, UNNEST(range(1, LEN(w) - 3)) AS i, UNNEST(list_transform(range(1, LEN(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE LEN(w) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) c WHERE n > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, UNNEST(range(i, i + 5)) AS k FROM twice) c GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(DISTINCT l) AS n_distinct
          FROM (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(LENGTH(t) - LENGTH(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      COALESCE(n_lines - n_distinct, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(n_lines, 0) AS n_lines
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed FROM f),
h AS (SELECT host, COUNT(*) AS n, SUM(CAST(failed AS BIGINT)) AS k FROM g GROUP BY host),
p AS (SELECT SUM(k) / SUM(n) AS p, SUM(n) AS total, COUNT(*) AS hosts, SUM(CAST(n AS DOUBLE) * n) AS nn FROM h),
q AS (SELECT p, total, hosts, nn, p * (1 - p) AS v, (SELECT SUM(n * POW(k / n - p.p, 2)) FROM h) AS s FROM p),
r AS (SELECT p, LEAST(GREATEST(CASE WHEN v * (total - nn / total - (hosts - 1)) > 0 THEN (s - v * (hosts - 1)) / (v * (total - nn / total - (hosts - 1))) ELSE 0 END, 1e-6), 0.99) AS share FROM q),
rates AS (SELECT host, (k + p * (1 / share - 1)) / (n + 1 / share - 1) AS rate FROM h, r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate <= 0.5 AS kept, ROUND(rate, 6) AS host_rate
FROM g JOIN rates ON g.host IS NOT DISTINCT FROM rates.host"""

#: Runs of 50 words that two documents hold, and lines of 50 words or more whose 5-word shingle sets are similar, by all pairs.
SUBSTRINGS = f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w,
      regexp_extract_all(COALESCE(text, ''), '[\\x20\\x09-\\x0D]+') AS g FROM documents),
parts AS (SELECT id, UNNEST(range(1, LEN(w) + 1)) AS i, UNNEST(w) AS word,
      UNNEST(list_transform(range(1, LEN(w) + 1), lambda i: COALESCE(g[i - 1 + CASE WHEN regexp_matches(t, '^[\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END], ''))) AS gap FROM d WHERE LEN(w) > 0),
placed AS (SELECT id, i, word, SUM(LENGTH(gap) + LENGTH(word)) OVER (PARTITION BY id ORDER BY i) AS e,
      SUM(LENGTH(gap) - LENGTH(replace(gap, chr(10), ''))) OVER (PARTITION BY id ORDER BY i) AS line FROM parts),
runs AS (SELECT id, UNNEST(range(1, LEN(w) - 48)) AS i, UNNEST(list_transform(range(1, LEN(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS run FROM d WHERE LEN(w) >= 50),
held AS (SELECT id, i, MIN(id) OVER (PARTITION BY run) AS source, MAX(id) OVER (PARTITION BY run) AS last FROM runs),
lines AS (SELECT id, line, MIN(i) AS i, MAX(i) AS j, list(word ORDER BY i) AS w FROM placed GROUP BY id, line HAVING COUNT(*) >= 50),
sets AS (SELECT id, line, i, j, list_sort(list_distinct(list_transform(range(1, LEN(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) AS s FROM lines),
names AS (SELECT s, ROW_NUMBER() OVER () AS n FROM (SELECT DISTINCT s FROM sets) x),
shingles AS (SELECT n, LEN(s) AS size, UNNEST(s) AS x FROM names),
pairs AS (SELECT a.n AS a, b.n AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.n <> b.n GROUP BY a.n, b.n, a.size, b.size HAVING 100 * COUNT(*) >= 80 * (a.size + b.size - COUNT(*))),
spread AS (SELECT n AS id, n AS r FROM names WHERE n IN (SELECT a FROM pairs) UNION SELECT pairs.b, spread.r FROM spread JOIN pairs ON pairs.a = spread.id),
class AS (SELECT id AS n, MIN(r) AS class FROM spread GROUP BY id),
members AS (SELECT sets.id, i, j, MIN(sets.id) OVER (PARTITION BY class) AS source, MAX(sets.id) OVER (PARTITION BY class) AS last FROM sets JOIN names USING (s) JOIN class USING (n)),
spans AS (SELECT id, i, i + 49 AS j, source, id = source AS kept FROM held WHERE source < last UNION SELECT id, i, j, source, id = source FROM members WHERE source < last),
fresh AS (SELECT *, CASE WHEN i > COALESCE(MAX(j) OVER (PARTITION BY id, kept ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS begins FROM spans),
islands AS (SELECT *, SUM(begins) OVER (PARTITION BY id, kept ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS island FROM fresh),
merged AS (SELECT id, kept, MIN(i) AS i, MAX(j) AS j, MIN(source) AS source_doc FROM islands GROUP BY id, kept, island),
edges AS (SELECT DISTINCT id AS a, source AS b FROM spans WHERE NOT kept UNION SELECT DISTINCT source, id FROM spans WHERE NOT kept),
nodes AS (SELECT DISTINCT a AS id FROM edges), {REACH}
SELECT m.id AS doc_id, CAST(p.e - LENGTH(p.word) AS BIGINT) AS start, CAST(q.e AS BIGINT) AS "end", kept, source_doc, COALESCE(component_id, m.id) AS component_id
FROM merged m JOIN placed p ON p.id = m.id AND p.i = m.i JOIN placed q ON q.id = m.id AND q.i = m.j LEFT JOIN least ON least.id = m.id"""

ORACLE = {k: " ".join(v.split()) for k, v in {
    "op3_embedding_near_dedup": EMBEDDINGS,
    "op7_quality_rules": QUALITY,
    "op8_minhash_near_dedup": MINHASH,
    "op9_substring_dedup": SUBSTRINGS,
}.items()}
