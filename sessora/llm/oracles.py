"""DuckDB SQL of the queries that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           list_filter(
               regexp_split_to_array(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'),
               lambda w: w <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id,
           CASE WHEN w IS NULL OR len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(
                    range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
           END AS shingles
    FROM words
),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id,
       doc_id = component_id AS kept
FROM sets JOIN components USING (doc_id)
"""

#: Trees as lists of digests, a level a step; the proof's steps of a row join by level.
MANIFEST = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8),
numbered AS (SELECT row_number() OVER () AS rid, * FROM documents),
crcs AS (
  SELECT rid, CAST(doc_id AS VARCHAR) AS digits, 1 AS nth, CAST(4294967295 AS BIGINT) AS c FROM numbered
  WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT rid, digits, nth + 1, xor(c >> 8, entries[1 + (xor(c, ascii(digits[nth])) & 255)])
  FROM crcs, crc_table WHERE nth <= length(digits)),
hit AS (SELECT rid FROM crcs WHERE nth > length(digits) AND xor(c, 4294967295) % 2 = 0),
texts AS (
  SELECT n.*, CASE WHEN h.rid IS NULL THEN text ELSE replace(text, chr(10), '') END AS later
  FROM numbered n LEFT JOIN hit h ON n.rid = h.rid),
parts AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM texts),
leaves AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS now FROM parts),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
trees AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT tree, level AS height, nodes[1] AS subroot FROM trees WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM top WHERE len(nodes) > 1),
whole AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
met AS (
  SELECT rid, level AS nth, nodes, place // CAST(pow(3, level) AS BIGINT) AS i
  FROM placed JOIN trees USING (tree) WHERE len(nodes) > 1
  UNION ALL
  SELECT rid, height + top.level, nodes, (tree - 1) // CAST(pow(3, top.level) AS BIGINT)
  FROM placed JOIN subroots USING (tree), top WHERE len(nodes) > 1),
steps AS (
  SELECT rid, nth, array_to_string(nodes[i - i % 3 + 1 : i], '') AS l,
    array_to_string(nodes[i + 2 : i - i % 3 + 3], '') AS r FROM met),
proofs AS (SELECT rid, count(*) AS n, string_agg(l || r, '' ORDER BY nth) AS siblings FROM steps GROUP BY rid),
folds AS (
  SELECT rid, 0 AS nth, now AS h FROM placed
  UNION ALL
  SELECT f.rid, f.nth + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON f.rid = s.rid AND f.nth = s.nth)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, h AS folded_root,
  h = root AS verified
FROM placed JOIN subroots USING (tree) CROSS JOIN whole LEFT JOIN proofs USING (rid)
JOIN folds ON folds.rid = placed.rid AND folds.nth = coalesce(proofs.n, 0)
"""
