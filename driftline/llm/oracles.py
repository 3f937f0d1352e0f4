"""SQL of the queries of this subpackage that SQL can express."""

#: crc32 of a string, by its table of 256, made by rule.
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS t)"""


def _crc32(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {letters}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


OP11 = f"""
WITH {_CRC.strip()},
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place, digest, bytes FROM (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM own), crc_table crc),
turns AS (SELECT c.conv_id, 0 AS own, o.place, digest, bytes FROM convs c JOIN own o ON o.conv_id = c.base AND o.place < c.h
  UNION ALL SELECT c.conv_id, 1, o.place, digest, bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h),
numbered AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '' ORDER BY own, place) OVER w AS path, bytes FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
numbers AS (SELECT conv_id, depth, path, bytes FROM numbered UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
prefixes AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM numbers),
nodes AS (SELECT path, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saves, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY path),
within AS (SELECT DISTINCT a.path, b.path AS lower FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT w.path, sum(n.saves) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves FROM within w JOIN nodes n ON n.path = w.lower GROUP BY w.path),
children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT rid, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
met AS (SELECT DISTINCT p.rid, p.m, p.k, x.item FROM places p JOIN windows x ON p.m = x.m AND p.win = x.win),
hits AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(k, k + m)) AS spot FROM met) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits h USING (rid) LEFT JOIN found f USING (rid)
"""

_BLANKS = r"\x20\x09-\x0D"

OP13 = rf"""
WITH RECURSIVE {_CRC.strip()},
filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS n FROM conversations, crc_table crc),
damaged AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN n = 3 THEN [0, 1] ELSE [0] END) AS copy FROM filled WHERE n <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
known AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN NOT regexp_matches(text, '[^{_BLANKS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][{_BLANKS}]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM known GROUP BY conv_id),
inserted(s, t, k, added) AS (VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 1, 'user:' || chr(10)), ('s', 'u', 1, 'user:' || chr(10)), ('a', 'u', 1, 'user:' || chr(10)), ('u', 'a', 1, 'assistant:' || chr(10)),
    ('', 'a', 2, 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 2, 'user:' || chr(10) || 'assistant:' || chr(10)), ('a', 'a', 2, 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'u', 2, 'assistant:' || chr(10) || 'user:' || chr(10))),
moves(s, e, t) AS (VALUES ('', 'K', 's'), ('', 'K', 'u'), ('s', 'K', 'u'), ('u', 'K', 'a'), ('a', 'K', 'u'), ('', 'R', 'u'), ('s', 'R', 'u'), ('u', 'R', 'a'), ('a', 'R', 'u'), ('', 'D', ''), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a')),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, '' AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'made': ''}} AS best FROM counts
  UNION ALL
  SELECT w.conv_id, w.place + 1, m.t, min({{'cost': w.best.cost + CAST(2 * i.k + CASE m.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN m.e <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS BIGINT), 'audit': w.best.audit || repeat('I', i.k) || m.e,
      'made': w.best.made || i.added || CASE m.e WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE CASE m.t WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text || chr(10) END}})
  FROM walk w JOIN known r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1 JOIN inserted i ON i.s = w.s JOIN moves m ON m.s = i.t
  WHERE m.e = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR m.t = r.initial))
  GROUP BY w.conv_id, w.place + 1, m.t),
ended AS (SELECT c.conv_id, min({{'cost': w.best.cost + 2 * i.k, 'audit': w.best.audit || repeat('I', i.k), 'made': w.best.made || i.added}}) AS best
  FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = c.n JOIN inserted i ON i.s = w.s AND i.t IN ('', 'a') GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.made[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
