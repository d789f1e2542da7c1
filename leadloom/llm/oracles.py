"""SQL for DuckDB that queries of this subpackage equal."""

ORACLES = {
    "op3_archive": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages
), c AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY payload) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to,
  true AS verified
FROM c
""",
    "op8_decontamination": r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), own AS (
  SELECT id AS item_id, w, least(13, len(w)) AS n FROM words WHERE kind = 1 AND len(w) > 0
), theirs AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM own)
), docs AS (SELECT id AS doc_id, coalesce(w, []) AS w FROM words WHERE kind = 0
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM docs, (SELECT DISTINCT n FROM theirs))
), found AS (SELECT doc_id, i, n, item_id FROM places JOIN theirs USING (n, span)
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_conversation_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id
), heads AS (
  -- The crc32 of an id's digits: each byte is mixed in, then eight bits are shifted out.
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda i: list_prepend(CAST(ascii(s[i]) AS BIGINT), list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
  )) % 9 AS h FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), paths AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built
), nodes AS (
  SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(turns) = depth THEN conv_id END, ',' ORDER BY conv_id) AS ends
  FROM paths GROUP BY depth, turns[1:depth]
), kin AS (
  SELECT c.depth, c.conv_id, p.conv_id AS parent_conv_id
  FROM nodes c JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]
), children AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM kin GROUP BY ALL
), costs AS (
  SELECT n.depth, n.prefix, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.prefix[n.depth].text) END AS saved, n_children IS NULL AS is_leaf
  FROM nodes n LEFT JOIN children USING (depth, conv_id)
), totals AS (
  SELECT d AS depth, prefix[1:d] AS prefix, count(*) FILTER (WHERE is_leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT prefix, saved, is_leaf, unnest(range(0, depth + 1)) AS d FROM costs) GROUP BY ALL
)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN kin USING (depth, conv_id) LEFT JOIN children USING (depth, conv_id) JOIN totals ON totals.depth = n.depth AND totals.prefix = n.prefix
""",
    "op6_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) USING (doc_id)
""",
}
