"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
#: What Python's ``str.split`` splits at.
_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

OP1 = r"""
WITH parts AS (
  SELECT page_id, length(coalesce(html, '')) < 1500 AS thin,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
spelled AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(?s)(\.html)?/*$', '') END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM spelled WHERE thin AND canonical IS NOT NULL),
ruled AS (
  SELECT page_id, host, path, canonical, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM spelled)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP2 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, line, trim(regexp_replace(lower(line), '{_SPACES}', ' ', 'g'), ' ') AS normal, len(regexp_extract_all(line, '{_WORD}')) AS n
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS documents FROM docs GROUP BY source),
counts AS (SELECT source, normal, count(DISTINCT text) AS n FROM lines GROUP BY source, normal),
frequent AS (SELECT c.source, c.normal FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n > 5 AND c.n > 0.01::DOUBLE * h.documents),
hit AS (SELECT doc_id, sum(l.n) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.normal = f.normal GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(h.n, 0)::BIGINT AS gone
  FROM words w LEFT JOIN dup d ON w.doc_id = d.doc_id LEFT JOIN repeated r ON w.doc_id = r.doc_id LEFT JOIN hit h ON w.doc_id = h.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, gone > 0 AND n_words - gone < 0.3::DOUBLE * n_words AS depleted FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, gone::BIGINT AS n_frequent_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM judged
"""

OP5 = rf"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, text, pos, line, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '{_WORD}') AS words
  FROM (SELECT doc_id, text, unnest(all_lines) AS line, unnest(range(1, len(all_lines) + 1)) AS pos FROM raw)),
keyed AS (SELECT doc_id, text, pos, line, len(words) AS n, array_to_string(words, ' ') AS key, words, concat_ws(' ', len(words), words[1], words[2]) AS leaf FROM lines),
leaves AS (SELECT leaf, count(DISTINCT text) AS documents FROM keyed WHERE n > 0 GROUP BY leaf HAVING count(DISTINCT text) >= 10),
kinds AS (SELECT leaf, key, any_value(words) AS words, any_value(n) AS n, count(DISTINCT text) AS c FROM keyed WHERE n > 0 AND leaf IN (SELECT leaf FROM leaves) GROUP BY leaf, key),
places AS (SELECT leaf, key, n, c, unnest(words) AS word, unnest(range(1, n + 1)) AS nth FROM kinds),
usual AS (SELECT leaf, nth, word FROM places JOIN leaves USING (leaf) GROUP BY leaf, nth, word, documents HAVING sum(c) >= 10 AND sum(c) >= 0.01::DOUBLE * documents),
fields AS (SELECT p.leaf, p.key, p.n, p.nth, CASE WHEN u.word IS NOT NULL AND p.word <> '<*>' THEN p.word ELSE '<*>' END AS word FROM places p LEFT JOIN usual u ON p.leaf = u.leaf AND p.nth = u.nth AND p.word = u.word),
templates AS (SELECT leaf, key, string_agg(word, ' ' ORDER BY nth) AS template FROM fields GROUP BY leaf, key HAVING count(*) FILTER (WHERE word <> '<*>') >= 0.5::DOUBLE * count(*)),
often AS (SELECT t.leaf, t.template FROM templates t JOIN keyed k ON t.leaf = k.leaf AND t.key = k.key GROUP BY t.leaf, t.template HAVING count(DISTINCT k.text) >= 10),
recurring AS (SELECT DISTINCT t.leaf, t.key FROM templates t JOIN often o ON t.leaf = o.leaf AND t.template = o.template),
hits AS (SELECT k.doc_id, k.text, k.pos, k.line, k.n, k.leaf, k.key, r.key IS NOT NULL AS gone FROM keyed k LEFT JOIN recurring r ON k.leaf = r.leaf AND k.key = r.key),
mostly AS (SELECT text FROM hits GROUP BY text HAVING 2 * sum(CASE WHEN gone THEN n ELSE 0 END) > sum(n)),
held AS (SELECT DISTINCT md5(text) AS digest, pos, leaf, key, n FROM hits WHERE gone AND text IN (SELECT text FROM mostly)),
other AS (SELECT leaf, key, min(digest) AS other FROM held GROUP BY leaf, key),
pairs AS (SELECT DISTINCT h.digest, o.other FROM held h JOIN other o ON h.leaf = o.leaf AND h.key = o.key WHERE h.digest <> o.other),
shared AS (SELECT p.digest, p.other, sum(x.n) AS n FROM pairs p JOIN held x ON x.digest = p.digest SEMI JOIN held y ON y.digest = p.other AND y.leaf = x.leaf AND y.key = x.key GROUP BY p.digest, p.other),
own AS (SELECT md5(text) AS digest, sum(n) AS n FROM (SELECT DISTINCT text, pos, n FROM hits) GROUP BY text),
copies AS (SELECT unnest([s.digest, s.other]) AS digest FROM shared s JOIN own o ON s.digest = o.digest WHERE s.n > 0.5::DOUBLE * o.n),
flagged AS (SELECT doc_id, pos, line, gone AND md5(text) NOT IN (SELECT digest FROM copies) AS gone FROM hits),
dropped AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM flagged GROUP BY doc_id HAVING count(*) FILTER (WHERE gone) > 0)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(s.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(s.kept, d.text)) AS kept_sha256
FROM documents d LEFT JOIN dropped s ON d.doc_id = s.doc_id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i::INT + 1, 5))::BIGINT) AS fives FROM q)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

OP10 = rf"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
again AS (SELECT key FROM windows GROUP BY key HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM again)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS nth FROM split),
marked AS (
  SELECT x.doc_id, x.nth, x.word, max(s.i) OVER (PARTITION BY x.doc_id ORDER BY x.nth ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words x LEFT JOIN starts s ON x.doc_id = s.doc_id AND x.nth = s.i),
found AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY nth) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_words, coalesce(f.r, 0)::BIGINT AS n_removed, sha256(coalesce(f.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

def _merkle_levels(tree: str, docs: str, levels: int) -> str:
    """Levels of trees ``{tree}0`` (t, i, h) up to their roots, and how ``{docs}0`` (doc_id, t, i, acc, proof, ...) goes up with them: a tree with one node left stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"""
{tree}c{k} AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS c FROM {tree}{k}),
{tree}r{k} AS (SELECT t, i // 16 AS g, min(c) AS c, min(h) AS one, string_agg(h, '' ORDER BY i) AS run FROM {tree}c{k} GROUP BY t, i // 16),
{tree}{k + 1} AS (SELECT t, g AS i, CASE WHEN c = 1 THEN one ELSE sha256(run) END AS h FROM {tree}r{k}),
{docs}{k + 1} AS (SELECT d.* EXCLUDE (i, acc, proof), d.i // 16 AS i,
  CASE WHEN c = 1 THEN acc ELSE sha256(run[1:64 * (d.i % 16)] || acc || run[64 * (d.i % 16) + 65:]) END AS acc,
  CASE WHEN c = 1 THEN proof ELSE proof || run[1:64 * (d.i % 16)] || run[64 * (d.i % 16) + 65:] END AS proof
  FROM {docs}{k} d JOIN {tree}r{k} r ON d.t = r.t AND d.i // 16 = r.g)""")
    return ",".join(out)


_encoded = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_leaf = lambda text: f"sha256({' || '.join(_encoded(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
_CRC32 = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"

OP11 = f"""
WITH leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim FROM documents),
placed AS (
  SELECT doc_id, leaf, coalesce(claim, leaf) AS acc, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim NULLS FIRST) - 1 AS i FROM leaves),
n0 AS (SELECT t, i, leaf AS h FROM placed),
d0 AS (SELECT doc_id, leaf, t, i, acc, '' AS proof FROM placed),{_merkle_levels("n", "d", 6)},
m0 AS (SELECT 0 AS t, t AS i, h FROM n6),
e0 AS (SELECT doc_id, leaf, n6.h AS subroot, 0 AS t, d6.t AS i, acc, proof FROM d6 JOIN n6 ON d6.t = n6.t),{_merkle_levels("m", "e", 4)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM e4, m4
"""

OP13 = r"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM own),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
starts AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized))),
hits AS (SELECT r, i, s.n, item FROM starts s JOIN windows x ON s.n = x.n AND s.key = x.key),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

ORACLES = {"op1_url_filter": OP1, "op2_quality_rules": OP2, "op5_line_templates": OP5, "op6_warc": OP6, "op10_substring_dedup": OP10, "op11_merkle_manifest": OP11, "op13_decontamination": OP13}
