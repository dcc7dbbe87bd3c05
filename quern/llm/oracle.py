"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from quern.llm.licenses import BASE, TEMPLATES, THRESHOLD

_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
judged AS (SELECT doc_id, s, min({{'a': doc_id, 'b': s}}) OVER (PARTITION BY k) AS f FROM win),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM judged, (SELECT unnest(range(0, 20)) AS i) WHERE doc_id <> f.a OR s <> f.b),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_PLAIN.format(_LOWER)} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item FROM starts JOIN wins USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))}, {len(t.split()) * 5 // 4})" for i, (label, t) in enumerate(TEMPLATES))
_BASE_ROWS = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in BASE.items())
_ENOUGH = f"{THRESHOLD.denominator} * {{}} >= {THRESHOLD.numerator} * {{}}"

OP7 = f"""
WITH t(i, label, ws, run) AS (VALUES {_TEMPLATE_ROWS}),
rival AS (SELECT a.i AS a, b.i AS b FROM t a, t b WHERE a.label <> b.label AND {_ENOUGH.format("len(list_intersect(a.ws, b.ws))", "least(len(a.ws), len(b.ws))")}),
p(label, phrase, n) AS (VALUES {_BASE_ROWS}),
d AS (SELECT doc_id, {_LOWER} AS x, {_PLAIN.format(_LOWER)} AS w FROM documents),
spots AS (SELECT doc_id, label, s - 1 AS s FROM (SELECT doc_id, w, label, phrase, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, p WHERE contains(x, 'license') AND len(w) >= n) WHERE array_to_string(w[s:s + n - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spots GROUP BY doc_id),
near AS (SELECT doc_id, w, t.* FROM d, t WHERE {_ENOUGH.format("len(list_intersect(list_distinct(w), ws))", "len(ws)")}),
block AS (SELECT *, len(list_intersect(list_distinct(w[s:s + run - 1]), ws)) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM near) WHERE list_contains(ws, w[s])),
met AS (SELECT doc_id, i, label, s, s + run AS e, n, n / len(ws) AS c FROM block WHERE {_ENOUGH.format("n", "len(ws)")}),
kept AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM met x JOIN rival ON rival.b = x.i WHERE rival.a = m.i AND x.doc_id = m.doc_id AND x.s < m.e AND m.s < x.e AND (x.n > m.n OR x.n = m.n AND x.c > m.c))),
both_ AS (SELECT doc_id, label FROM spots UNION SELECT doc_id, label FROM kept),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM both_ GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON x = a.doc_id JOIN size b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(node, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, low FROM reach JOIN edge ON node = x),
least_ AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
many AS (SELECT x AS doc_id, count(*) AS links FROM edge GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, coalesce(links, 0)::BIGINT AS n_links
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN many USING (doc_id) JOIN least_ ON node = d.doc_id
"""
