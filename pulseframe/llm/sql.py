"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from pulseframe.llm.licenses import AROUND, CUE, CUE_WORD, LONG_SENTENCE, TEMPLATES

ORACLES: dict[str, str] = {}

ORACLES["op1_url_filters"] = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM parts),
hits AS (
  SELECT n, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC) AS k
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)"""


def _spans(kind: str, rank: int, pattern: str, ok: str = "true") -> str:
    return f"""
  SELECT n, '{kind}' AS kind, {rank} AS rank,
         unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack(
           s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0),
           hit := h[i]))) AS m, {ok} AS ok
  FROM (SELECT n, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h FROM docs)"""


_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _KEY + r"""[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"')
ORACLES["op3_secret_scans"] = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans('assign', 0, _ASSIGN)}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+')}
  UNION ALL {_spans('hex', 2, '[0-9a-f]{24,}')}
  UNION ALL {_spans('private_key', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----')}
  UNION ALL {_spans('json_token', 4, 'eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}')}
  UNION ALL {_spans('host_token', 5, 'gh[pousr]_[A-Za-z0-9]{36,}')}
  UNION ALL {_spans('chat_token', 6, 'xox[abprs]-[A-Za-z0-9-]{10,}')}
  UNION ALL {_spans('cloud_key', 7, 'AIza[A-Za-z0-9_-]{35}')}),
kept AS (
  SELECT n, kind, rank, m.s AS s, m.s + length(m.hit) AS e FROM found
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m.hit, '{_ASSIGN}', 2)) >= 6 WHEN 'access' THEN length(m.hit) >= 20 ELSE true END),
per AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (n)"""


def _filled(level: str, parents: list[str], source: str, weight: str) -> str:
    """One level of budgets: children share what their parent has, the full ones first."""
    path = ", ".join([*parents, level])
    family = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
c_{level} AS (SELECT {path}, sum(tokens * 4)::DOUBLE AS cap, any_value(given) AS given, {weight} AS w FROM {source} GROUP BY {path}),
o_{level} AS (SELECT *, coalesce(sum(cap) OVER ({family} ORDER BY cap / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
   sum(w) OVER ({family} ORDER BY cap / w, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c_{level}),
f_{level} AS (SELECT *, cap / w * open <= given - used AS is_full FROM o_{level}),
s_{level} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE w * (given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({family}), 0))
   / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({family}) END AS given FROM f_{level}),
b_{level} AS (SELECT l.* EXCLUDE (given), s.given FROM {source} l JOIN s_{level} s USING ({path}))"""


ORACLES["op5_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
start AS (SELECT *, (sum(tokens) OVER ())::DOUBLE AS given FROM leaf),{_filled('domain', [], 'start', "CASE domain WHEN 'domain0' THEN 3.0 WHEN 'other' THEN 1.0 ELSE 2.0 END::DOUBLE")},{
  _filled('lang', ['domain'], 'b_domain', "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE")},{
  _filled('source', ['domain', 'lang'], 'b_lang', '1.0::DOUBLE')},
plan AS (SELECT *, floor(given + 1e-6)::BIGINT AS budget FROM b_source),
whole AS (SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, 4) ELSE 1 END AS epochs FROM plan),
left_over AS (SELECT *, CASE WHEN epochs < 4 THEN budget - epochs * tokens ELSE 0 END AS rest FROM whole),
seeded AS (SELECT d.*, epochs, rest, substr(md5('17:' || (epochs + 1) || ':' || doc_id), 1, 15) AS h FROM docs d JOIN left_over USING (domain, lang, source)),
cut AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest AS more FROM seeded)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, epochs + 1 + more::INT))::INT AS epoch FROM cut"""

_CUE, _CUE_WORD = CUE.replace("'", "''"), CUE_WORD
_QUOTED = [(k, t.replace("'", "''")) for k, t in TEMPLATES]
ORACLES["op10_license_scans"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t,
         array_to_string([source, lang, (doc_id // 1000)::VARCHAR][1:(doc_id // 3) % 3 + 1] || [CASE WHEN doc_id % 4 = 0 THEN 'LICENSE' ELSE doc_id::VARCHAR END], '/') AS path FROM documents),
place AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM docs),
cue AS (
  SELECT n, dir, path, t, regexp_replace(t, '(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)?[ \t]*', '\1', 'g') AS clean
  FROM place WHERE regexp_matches(t, '{_CUE}')),
blk AS (SELECT *, list_filter(list_transform(string_split_regex(clean, '\n[ \t\r]*\n'), lambda p: trim(regexp_replace(p, '[\n\r\t ]+', ' ', 'g'))), lambda p: regexp_matches(p, '{_CUE}')) AS blocks FROM cue),
sen AS (SELECT *, list_filter(flatten(list_transform(blocks, lambda p: string_split(regexp_replace(p, '([.!?;:]) ', '\1' || chr(10), 'g'), chr(10)))), lambda s: regexp_matches(s, '{_CUE}')) AS sentences FROM blk),
lng AS (SELECT n, k, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT n, generate_subscripts(sentences, 1) AS k, string_split(unnest(sentences), ' ') AS w FROM sen) WHERE len(w) > {LONG_SENTENCE}),
win AS (SELECT n, list(array_to_string(w[greatest(i - b, 1):i + a], ' ')) AS windows FROM lng, (VALUES {', '.join(map(str, AROUND))}) v(b, a) WHERE regexp_matches(w[i], '{_CUE_WORD}') GROUP BY n),
lst AS (
  SELECT s.n, dir, path, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '{_CUE}')) || blocks || sentences AS first, coalesce(windows, []) AS second,
         trim(regexp_replace(clean, '[\n\r\t ]+', ' ', 'g')) AS all_text FROM sen s LEFT JOIN win USING (n)),
line AS (
  SELECT n, dir, path, generate_subscripts(first, 1) AS i, unnest(first) AS text, false AS whole FROM lst
  UNION ALL SELECT n, dir, path, len(first) + 1, unnest(second), false FROM lst
  UNION ALL SELECT n, dir, path, len(first) + 2, all_text, true FROM lst),
model(license, text) AS (VALUES {", ".join(f"('{k}', '{t}')" for k, t in _QUOTED)}),
corpus AS (SELECT 'n' AS kind, NULL AS license, text FROM (SELECT DISTINCT text FROM line) UNION ALL SELECT 't', license, text FROM model),
term AS (SELECT kind, license, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM corpus),
tf AS (SELECT kind, license, text, term, count(*) AS tf FROM term GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY term),
vec AS (SELECT *, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY kind, license, text)) AS norm FROM tf JOIN idf USING (term)),
cos AS (SELECT a.text, b.license, sum(a.w / a.norm * b.w / b.norm) AS cosine FROM vec a JOIN vec b USING (term) WHERE a.kind = 'n' AND b.kind = 't' GROUP BY a.text, b.license, b.text),
known AS (SELECT text, license, round(cosine, 6) AS cosine FROM cos WHERE cosine >= 0.7 QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(cosine, 6) DESC, license) = 1),
found AS (SELECT n, dir, path, i, whole, license, cosine FROM line JOIN known USING (text)),
head AS (
  SELECT n, any_value(dir) AS dir, arg_min(license, (-cosine, i, license)) AS license, max(cosine) AS cosine,
         bool_or(whole OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(?:licen[cs]e|copying|unlicense)(?:[._-].*)?$')) AS is_file FROM found GROUP BY n),
owner AS (SELECT dir AS above, arg_min(license, (-cosine, license)) AS license FROM head WHERE is_file GROUP BY dir),
up AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM place)),
near AS (SELECT dir, arg_max(above, depth) AS origin, arg_max(license, depth) AS license
         FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM up) JOIN owner USING (above) GROUP BY dir)
SELECT doc_id, path, coalesce(h.license, d.license) AS license, h.cosine, CASE WHEN h.is_file THEN 'file' WHEN h.license IS NOT NULL THEN 'header' WHEN d.license IS NOT NULL THEN 'directory' END AS scope,
       CASE WHEN h.license IS NULL THEN d.origin END AS origin
FROM place p LEFT JOIN head h USING (n) LEFT JOIN near d ON d.dir = p.dir"""

ORACLES["op4_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line),
pair AS (SELECT b.doc_id AS d, b.i AS i, a.doc_id AS e, a.i AS k FROM line a JOIN line b ON a.x = b.x AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
island AS (SELECT *, i - row_number() OVER (PARTITION BY d, e, i - k ORDER BY i) AS g FROM pair),
run AS (SELECT d, i, max(i) OVER (PARTITION BY d, e, i - k, g) AS last FROM island),
longest AS (SELECT d AS doc_id, i, max(last) AS last FROM run GROUP BY d, i),
enough AS (SELECT l.doc_id, l.i, l.last FROM longest l JOIN sums s USING (doc_id, i) JOIN sums t ON t.doc_id = l.doc_id AND t.i = l.last WHERE t.upto - s.upto + s.w >= 50),
reach AS (SELECT s.*, coalesce(max(e.last) OVER (PARTITION BY s.doc_id ORDER BY s.i) >= s.i, false) AS gone FROM sums s LEFT JOIN enough e USING (doc_id, i)),
stretch AS (SELECT doc_id, min(i) AS first, count(*) AS size FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM reach WHERE gone) GROUP BY doc_id, g),
cut AS (SELECT doc_id, string_agg(first || ':' || size, ',' ORDER BY first) AS removed FROM stretch GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS removed_lines, coalesce(sum(w) FILTER (gone), 0)::BIGINT AS removed_words
         FROM reach GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN k.text END AS text, removed_lines, removed_words, coalesce(removed, '') AS removed
FROM documents d JOIN kept k USING (doc_id) LEFT JOIN cut USING (doc_id)"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)".format("CAST(doc_id AS VARCHAR)")

ORACLES["op12_periodic_runs"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM docs),
spot AS (SELECT *, g % n AS a FROM sized),
step AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM spot),
word AS (
  SELECT r, n, i, w[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM step)),
pair AS (SELECT s.r, s.i, t.i - s.i AS q FROM word s JOIN word t ON s.r = t.r AND s.x = t.x AND t.i > s.i AND 4 * (t.i - s.i) <= s.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said,
         arg_min(struct_pack(s := s, l := l, q := q), (-l / q, s, q)) AS best FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN per USING (r) LEFT JOIN left_over USING (r)"""


def _tree(name: str, leaves: str, key: str) -> str:
    """All nodes of trees by ``key``, and what stands left and right of each in its run."""
    return f"""
{name} AS (
  SELECT {key} AS tree, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lvl, i // 3),
{name}_step AS (
  SELECT tree, lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, i // 3 ORDER BY i))"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(parts) + ")"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf('text')} AS h,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS bad FROM documents),
source_no AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM (SELECT DISTINCT source FROM leaf)),
placed AS (
  SELECT l.*, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n
  FROM leaf l JOIN source_no s ON l.source IS NOT DISTINCT FROM s.source),{_tree('node', 'placed', 'k')},
sub AS (SELECT 0 AS one, tree AS i, h, count(*) OVER () AS n FROM node WHERE n = 1),{_tree('upper', 'sub', 'one')},
fold AS (
  SELECT r, k AS tree, 0 AS lvl, i, bad AS x, '' AS proof FROM placed
  UNION ALL SELECT r, tree, lvl + 1, i // 3, sha256(l || x || rt), proof || l || rt FROM fold JOIN node_step USING (tree, lvl, i)),
low AS (SELECT r, tree AS k, arg_max(x, lvl) AS x, arg_max(proof, lvl) AS proof FROM fold GROUP BY r, tree),
rise AS (
  SELECT r, 0 AS tree, 0 AS lvl, k AS i, x, proof FROM low
  UNION ALL SELECT r, tree, lvl + 1, i // 3, sha256(l || x || rt), proof || l || rt FROM rise JOIN upper_step USING (tree, lvl, i)),
whole AS (SELECT r, arg_max(x, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM rise GROUP BY r),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, p.h AS leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN whole USING (r) JOIN sub ON sub.i = p.k CROSS JOIN top"""
