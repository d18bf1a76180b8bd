"""DuckDB SQL for the queries that SQL can express over whole tables.

SimHash fingerprints, BPE, suffix dedup, token shards, license windows and spaced seeds have none; their tests compare
them with brute force or with the libraries that define them.
"""

from __future__ import annotations

from .quality_rules import SIGNALS
from .url_filters import HOST_RULES, PATTERNS

_CHAT = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations),
p AS (
  SELECT conv_id, i, string_agg(length(role) || ',' || length(text) || ':' || role || text, '' ) OVER w AS prefix, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS shown,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, any_value(n) AS n_turns, any_value(shown) AS text FROM p WHERE i = n GROUP BY prefix)
SELECT conv_id, n_turns, text FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = " || ".join(f"substr('{_BASE32}', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
parts AS (SELECT h, k, CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) AS v FROM (SELECT DISTINCT h FROM d) CROSS JOIN range(8) AS r(k)),
named AS (SELECT h, string_agg({_FIVE}, '' ORDER BY k) AS payload_digest FROM parts GROUP BY h),
top AS (SELECT h, max(page_id) AS top FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d JOIN named USING (h) JOIN top USING (h)
"""

_GRID = ", ".join(f"('{s}', {c:g})" for s, (_, grid) in SIGNALS.items() for c in grid)
_CELLS = sum(len(grid) for _, grid in SIGNALS.values())
_VALUE = "CASE signal " + " ".join(f"WHEN '{s}' THEN {expr.replace('q.', '')}" for s, (expr, _) in SIGNALS.items()) + " END"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_QUALITY = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, range(1, len(w) - 1) AS r(i)),
often AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN often USING (doc_id, g) CROSS JOIN range(3) AS s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE trim(line, {_WHITE}) <> '' GROUP BY doc_id),
c AS (
  SELECT w.doc_id, coalesce(lang, chr(1)) AS stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
grid AS (SELECT * FROM (VALUES {_GRID}) AS g(signal, cutoff)),
held AS (SELECT q.*, quality FROM q JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
cells AS (
  SELECT stratum, signal, cutoff, sum(quality) AS n, count(*) FILTER (WHERE quality = 1 AND {_VALUE} > cutoff) AS k, count(*) FILTER (WHERE quality = 0 AND {_VALUE} > cutoff) AS b FROM held CROSS JOIN grid GROUP BY ALL),
tail AS (
  SELECT stratum, signal, cutoff, k, b, CASE WHEN k >= n * 0.0125 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(1 - 0.0125))) FROM range(k + 1) AS r(i)) END AS p FROM cells),
cut AS (
  SELECT stratum, signal, arg_max(cutoff, (b - 5 * k) * 1000 + cutoff) AS cutoff FROM tail
  WHERE p <= 0.05 / ((SELECT count(DISTINCT stratum) FROM held) * {_CELLS}) AND b - 5 * k > 0 GROUP BY stratum, signal),
bad AS (SELECT DISTINCT doc_id FROM q JOIN cut USING (stratum) WHERE n_words > 0 AND {_VALUE} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM q
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
_HIT = {v: " OR ".join(f"regexp_matches(lower(url), '{p}')" for p, x in PATTERNS if x == v) for v in ("allow", "block")}
_URLS = f"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES {_RULES}) AS r(h, p, v)),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN host = '' OR ({_HIT['allow']}) THEN 'allow' WHEN {_HIT['block']} THEN 'block' ELSE 'allow' END AS verdict FROM u LEFT JOIN best USING (page_id)
"""

ORACLES: dict[str, str] = {"op3_chat": _CHAT, "op7_warc": _WARC, "op9_quality_rules": _QUALITY, "op10_url_filters": _URLS}
