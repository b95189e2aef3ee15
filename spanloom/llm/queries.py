"""The registered queries of this package and, where SQL can express them on whole tables, their SQL counterparts."""

from __future__ import annotations

from spanloom.llm.decontam import op9_benchmark_decontamination
from spanloom.llm.fmindex import op10_substring_dedup
from spanloom.llm.katz import op2_katz_backoff
from spanloom.llm.minhash import op3_minhash_near_dedup
from spanloom.llm.neighbours import op12_rp_forest
from spanloom.llm.packing import op7_best_fit_packing
from spanloom.llm.quality import op1_quality_classifier
from spanloom.llm.repair import op11_structure_repair
from spanloom.llm.rules import op8_quality_rules
from spanloom.llm.secrets import ASSIGN, MIN_DISTINCT, op5_secret_scan
from spanloom.llm.tokencount import op6_token_counts
from spanloom.llm.trie import op13_prefix_trie
from spanloom.llm.urls import op4_url_filter

QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_katz_backoff, op3_minhash_near_dedup, op4_url_filter, op5_secret_scan, op6_token_counts,
    op7_best_fit_packing, op8_quality_rules, op9_benchmark_decontamination, op10_substring_dedup,
    op11_structure_repair, op12_rp_forest, op13_prefix_trie)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(sh) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n_shingles + y.n_shingles - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.x AND r.root < u.b)
SELECT doc_id, n_shingles, root AS component_id, doc_id = root AS kept FROM n JOIN (SELECT x AS doc_id, min(root) AS root FROM r GROUP BY x) USING (doc_id)
"""

_Q = ASSIGN.replace("'", "''")


def _found(kind: int, pattern: str) -> str:
    """Spans of one kind: piece lengths and match lengths added up from the left."""
    return f"""SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
 'k': {kind}, 'l': length(m[i]), 't': m[i]}}) AS sp FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM d)"""


_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
f AS ({_found(0, _Q)} UNION ALL {_found(1, 'AKIA[A-Z0-9]+')} UNION ALL {_found(2, '[0-9a-f]+')} UNION ALL {_found(3, '[A-Za-z0-9+/_-]+')}),
x AS (SELECT doc_id, unnest(sp) AS z FROM f),
y AS (SELECT doc_id, z.s::BIGINT AS s, (z.s + z.l)::BIGINT AS e, z.k AS k, z.t AS t, z.l AS l, CASE WHEN z.k = 0 THEN regexp_extract(z.t, '{_Q}', 2) ELSE z.t END AS v FROM x),
b AS (SELECT * FROM y WHERE (k = 0 AND length(v) >= 6) OR (k = 1 AND l >= 20) OR (k = 2 AND l >= 24)),
c AS (SELECT * FROM y WHERE k = 3 AND l >= 20 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') AND len(list_distinct(string_split(t, ''))) >= {MIN_DISTINCT}
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = y.doc_id AND b.s < y.e AND y.s < b.e)),
a AS (SELECT v, count(DISTINCT coalesce(owner, '')) AS o FROM (SELECT * FROM b UNION ALL SELECT * FROM c) JOIN d USING (doc_id) GROUP BY v),
j AS (SELECT q.*, CASE WHEN o >= 3 THEN 0 ELSE 1 END AS live FROM (SELECT * FROM b UNION ALL SELECT * FROM c) q JOIN a USING (v)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 string_agg(['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
 string_agg(['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3 OR live = 1) AS spans,
 count(*) FILTER (live = 1) AS n_live, count(*) FILTER (live = 0) AS n_example FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)
"""

_OP10 = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
t AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM v),
f AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS first FROM t GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM t JOIN f USING (k) WHERE {{'d': doc_id, 'i': i}} <> first),
r AS (SELECT doc_id, list(i) AS gone FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [x FOR x, i IN ws IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: {bits}, 4294967295::BIGINT), 4294967295)"


_OP11 = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM src, range(CASE WHEN code = 3 THEN 2 ELSE 1 END) WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
  regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS letters FROM damaged),
judged AS (SELECT *, CASE WHEN letters = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(letters, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
nexts(q, initial, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
gaps(q, edits, made, p) AS (VALUES (0, '', '', 0), (0, 'I', 'u', 2), (0, 'II', 'ua', 3), (1, '', '', 1), (1, 'I', 'u', 2), (1, 'II', 'ua', 3), (2, '', '', 2), (2, 'I', 'a', 3), (2, 'II', 'au', 2),
  (3, '', '', 3), (3, 'I', 'u', 2), (3, 'II', 'ua', 3)),
ways AS (SELECT g.q, g.p AS p, '' AS needs, g.edits || 'D' AS edits, g.made, 4 + 3 * length(g.edits) AS cost FROM gaps g
  UNION ALL SELECT g.q, n.p, '', g.edits || 'R', g.made || n.initial, 3 + 3 * length(g.edits) FROM gaps g JOIN nexts n ON n.q = g.p AND n.initial <> 's'
  UNION ALL SELECT g.q, n.p, n.initial, g.edits || 'K', g.made || n.initial, 3 * length(g.edits) FROM gaps g JOIN nexts n ON n.q = g.p),
search(conv_id, i, q, best) AS (SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'edits': '', 'made': ''}} FROM stats
  UNION ALL SELECT s.conv_id, s.i + 1, w.p, min({{'cost': s.best.cost + w.cost + CASE WHEN j.fault = 'truncated' AND right(w.edits, 1) <> 'D' THEN 3 ELSE 0 END, 'edits': s.best.edits || w.edits, 'made': s.best.made || w.made}})
  FROM search s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1 JOIN ways w ON w.q = s.q
  WHERE right(w.edits, 1) = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (w.needs = '' OR w.needs = j.initial)) GROUP BY s.conv_id, s.i + 1, w.p),
done AS (SELECT s.conv_id, min({{'cost': s.best.cost + 3 * length(g.edits), 'edits': s.best.edits || g.edits, 'made': s.best.made || g.made}}) AS best
  FROM search s JOIN stats t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n = s.i JOIN gaps g ON g.q = s.q AND g.p IN (0, 3) GROUP BY s.conv_id),
letters AS (SELECT conv_id, k, best.edits[k] AS e, length(replace(best.edits[1:k], 'I', '')) AS i, best.made[length(replace(best.edits[1:k], 'D', ''))] AS m FROM done, range(1, length(best.edits) + 1) r(k)),
spelled AS (SELECT l.conv_id, string_agg(CASE WHEN e = 'K' THEN j.role WHEN m = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY k) AS repaired
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND e <> 'I' WHERE e <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.edits, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN spelled s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP13 = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS tid, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i FROM own),
every AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM own),
asked AS (SELECT conv_id, base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM every),
given AS (SELECT a.conv_id, t.tid, t.size, 0 AS own, t.i FROM asked a JOIN turns t ON t.conv_id = a.base AND t.i <= h UNION ALL SELECT a.conv_id, t.tid, t.size, 1, t.i FROM asked a JOIN turns t ON t.conv_id = a.conv_id AND t.i > h),
path AS (SELECT conv_id, row_number() OVER w AS depth, size, md5(string_agg(tid, ',') OVER w) AS node FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, 0, '' FROM every),
ends AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
nodes AS (SELECT p.depth, p.node, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (e.depth = p.depth) AS ends
  FROM path p JOIN ends e USING (conv_id) GROUP BY p.depth, p.node),
above AS (SELECT n.depth, n.node, u.node AS parent FROM nodes n JOIN path u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM above GROUP BY ALL),
subtree AS (SELECT u.depth, u.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens FROM nodes n JOIN path u ON u.conv_id = n.conv_id AND u.depth <= n.depth
  LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node GROUP BY u.depth, u.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN subtree s USING (depth, node) LEFT JOIN kids k USING (depth, node) LEFT JOIN above a USING (depth, node) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = a.parent
"""

ORACLE = {"op3_minhash_near_dedup": _OP3, "op5_secret_scan": _OP5, "op10_substring_dedup": _OP10, "op11_structure_repair": _OP11,
          "op13_prefix_trie": _OP13}
