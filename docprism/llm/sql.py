"""SQL (DuckDB) of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from docprism.llm import quality

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
lower = lambda t: _LOWER.format(t=t)

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * m >= 90 * (na + nb - m)), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id"""

DECONTAMINATE = f"""WITH i AS (SELECT item_id, regexp_extract_all({lower('text')}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{_ALNUM}') AS w FROM documents),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
cover AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, k)) AS o FROM (SELECT DISTINCT doc_id, k, p FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, i, lines[i] AS line, {lower("trim(lines[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key
 FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
held AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, coalesce(l.doc_id <> keeper, false) AS gone FROM l LEFT JOIN held ON l.key = held.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

_VALUES = ", ".join(f"{{'measure': '{m}', 'x': ({quality.SCALE} * {part}) // greatest({whole}, 1)}}" for m, (part, whole) in quality.MEASURES.items())
_BUCKET = f"CASE WHEN x < {quality.EXACT} THEN x ELSE (length(bin(x)) - 7) * 64 + (x >> (length(bin(x)) - 7)::BIGINT) END"
_LOW = f"CASE WHEN {{q}} < {quality.EXACT} THEN {{q}} ELSE (64 + {{q}} % 64) << ({{q}} // 64 - 1) END"
_HIGH = f"CASE WHEN {{q}} < {quality.EXACT} THEN {{q}} ELSE ((65 + {{q}} % 64) << ({{q}} // 64 - 1)) - 1 END"
_LEVEL = """{name} AS (SELECT {keys} measure, max(size) AS size, min(b) FILTER (upto * 100 >= size * 25) AS q25, min(b) FILTER (upto * 100 >= size * 75) AS q75, min(b) FILTER (upto * 100 >= size * 95) AS q95
 FROM (SELECT {keys} measure, b, sum(n) OVER (PARTITION BY {keys} measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS size FROM (SELECT {keys} measure, b, sum(n) AS n FROM sketch GROUP BY {keys} measure, b)) GROUP BY {keys} measure)"""

QUALITY = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_SPACED}') GROUP BY doc_id),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS o FROM win WHERE c > 1) GROUP BY doc_id),
stats AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
 FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
vals AS (SELECT doc_id, lang, source, base_failed, m.measure AS measure, m.x AS x FROM (SELECT *, unnest([{_VALUES}]) AS m FROM judged)),
sketch AS (SELECT lang, source, measure, {_BUCKET} AS b, count(*) AS n FROM vals WHERE NOT base_failed AND x > 0 GROUP BY ALL),
{_LEVEL.format(name="own", keys="lang, source,")},
{_LEVEL.format(name="broad", keys="lang,")},
{_LEVEL.format(name="every", keys="")},
chosen AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.size >= {quality.MIN_GROUP} THEN o.q25 WHEN b.size >= {quality.MIN_GROUP} THEN b.q25 WHEN e.size >= {quality.MIN_GROUP} THEN e.q25 END AS q25,
 CASE WHEN o.size >= {quality.MIN_GROUP} THEN o.q75 WHEN b.size >= {quality.MIN_GROUP} THEN b.q75 WHEN e.size >= {quality.MIN_GROUP} THEN e.q75 END AS q75,
 CASE WHEN o.size >= {quality.MIN_GROUP} THEN o.q95 WHEN b.size >= {quality.MIN_GROUP} THEN b.q95 WHEN e.size >= {quality.MIN_GROUP} THEN e.q95 END AS q95
 FROM own o JOIN broad b ON o.lang IS NOT DISTINCT FROM b.lang AND o.measure = b.measure JOIN every e ON o.measure = e.measure),
ends AS (SELECT lang, source, measure, {_LOW.format(q="q25")} AS low, {_HIGH.format(q="q75")} AS high, {_HIGH.format(q="q95")} AS top FROM chosen WHERE q25 IS NOT NULL),
out_of AS (SELECT DISTINCT v.doc_id FROM vals v JOIN ends f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.measure = f.measure
 WHERE CASE WHEN v.measure = 'word_length' THEN x < low - {quality.SPREAD} * (high - low) OR x > high + {quality.SPREAD} * (high - low) ELSE x > greatest(top, high + {quality.TAIL} * (high - low)) END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out_of) AS kept FROM judged"""
