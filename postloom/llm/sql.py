"""DuckDB SQL of the training-data operators that SQL can express whole."""

from __future__ import annotations

#: The words of a text: A to Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The CRC-32 of a list of bytes as a function of its start value and the bytes, eight shifts a byte.
SHIFTS = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
#: A column in a leaf: - for null, else bytes, colon, value.
TOLD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"

OP7 = """
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP11 = f"""
  WITH RECURSIVE tab(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM tab WHERE k < 8), tl AS (SELECT list(c ORDER BY i) AS crcs FROM tab WHERE k = 8),
  texts AS (SELECT false AS target, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
  w AS (SELECT target, id, {WORDS} AS w FROM texts),
  f AS (SELECT target, id, array_to_string(list_slice(w, k, k + n - 1), ' ') AS x FROM w, range(1, 4) AS r(n), unnest(range(1, len(w) - n + 2)) AS t(k)),
  h AS (SELECT x, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, octet_length(encode(x)) + 1), lambda k: CAST(('0x' || hex(encode(x)[k:k])) AS BIGINT))), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT x FROM f), tl),
  n AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM f JOIN h USING (x) GROUP BY 1),
  z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
  g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (t_scale))::DOUBLE / ((s + 1) * (s_scale))))::BIGINT AS gain FROM n, (SELECT s_all + 10000 AS t_scale, t_all + 10000 AS s_scale FROM z)),
  v AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN h USING (x) JOIN g USING (bucket) WHERE NOT target GROUP BY 1),
  o AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents JOIN w ON NOT target AND id = doc_id LEFT JOIN v ON v.id = doc_id),
  k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM o WHERE n_words >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * able // 100 THEN rank END AS rank FROM o LEFT JOIN k USING (doc_id)
"""

OP12 = f"""
  WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g, text,
      concat({TOLD.format('doc_id')}, {TOLD.format('source')}, {TOLD.format('lang')}, {TOLD.format('n_chars')}) AS head,
      list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))), lambda c, b: {SHIFTS}) AS crc FROM documents),
  e AS (SELECT doc_id, g, sha256(head || {TOLD.format('text')}) AS leaf, CASE WHEN crc % 2 = 1 THEN sha256(head || {TOLD.format("replace(text, chr(10), '')")}) ELSE sha256(head || {TOLD.format('text')}) END AS other FROM d),
  l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
  t AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM l UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lvl, i // 3),
  s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
  u AS (SELECT 0 AS lvl, i, subroot AS h, n FROM s UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3),
  a AS (SELECT 'leaf' AS tree, g, lvl, i, h, n FROM t UNION ALL SELECT 'group', '', lvl, i, h, n FROM u),
  r AS (SELECT x.tree, x.g, x.lvl, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS before, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS after FROM a x JOIN a y ON x.tree = y.tree AND x.g = y.g AND x.lvl = y.lvl AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY ALL),
  p AS (SELECT doc_id, leaf, 'leaf' AS tree, g, 0 AS lvl, i, n, other AS h, '' AS proof, g AS own FROM l
    UNION ALL SELECT p.doc_id, p.leaf, CASE WHEN p.n > 1 THEN p.tree ELSE 'group' END, CASE WHEN p.n > 1 THEN p.g ELSE '' END, CASE WHEN p.n > 1 THEN p.lvl + 1 ELSE 0 END, CASE WHEN p.n > 1 THEN p.i // 3 ELSE s.i END, CASE WHEN p.n > 1 THEN (p.n + 2) // 3 ELSE s.n END,
      CASE WHEN p.n > 1 THEN sha256(r.before || p.h || r.after) ELSE p.h END, p.proof || CASE WHEN p.n > 1 THEN r.before || r.after ELSE '' END, p.own
      FROM p LEFT JOIN r ON r.tree = p.tree AND r.g = p.g AND r.lvl = p.lvl AND r.i = p.i LEFT JOIN s ON s.g = p.own WHERE p.n > 1 OR p.tree = 'leaf')
  SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, p.h AS folded_root, p.h = root AS verified FROM p JOIN s ON s.g = p.own, (SELECT h AS root FROM u WHERE n = 1) WHERE p.tree = 'group' AND p.n = 1
"""

OP13 = f"""
  WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
  iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
  win AS (SELECT DISTINCT item, least(10, len(w)) AS m, list_slice(w, k, k + least(10, len(w)) - 1) AS x FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
  dwin AS (SELECT doc_id, m, k, list_slice(w, k, k + m - 1) AS x FROM dw, (SELECT DISTINCT m FROM win) AS l, unnest(range(1, len(w) - m + 2)) AS t(k)),
  hits AS (SELECT doc_id, k, m, item FROM dwin JOIN win USING (m, x)),
  n AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, m FROM hits), unnest(range(0, m)) AS t(j) GROUP BY 1),
  i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
