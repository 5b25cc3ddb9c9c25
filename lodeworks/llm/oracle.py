"""DuckDB SQL for those of the operators' queries that SQL can express."""

from __future__ import annotations

from collections import Counter

from lodeworks.llm.license_scan import TEMPLATES, TERM, terms

_NOTICES = ", ".join(f"('{name}', {k}, '{t}', {n})" for name, notices in sorted(TEMPLATES.items()) for k, notice in enumerate(notices) for t, n in sorted(Counter(terms(notice)).items()))

OP1 = rf"""WITH files AS (SELECT doc_id, text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/p' || (doc_id // 50) % 40 || '/' || CASE WHEN doc_id % 50 = 7 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path, doc_id % 50 = 7 AS gives FROM documents),
notices(license, k, t, tf) AS (VALUES {_NOTICES}),
n AS (SELECT count(*) AS n FROM files),
idf AS (SELECT t, ln((1 + any_value(n))::DOUBLE / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM files), n GROUP BY t),
nw AS (SELECT license, k, t, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM notices LEFT JOIN idf USING (t), n),
nu AS (SELECT license, k, t, w / sqrt(sum(w * w) OVER (PARTITION BY license, k)) AS u FROM nw),
a AS (SELECT doc_id, gives, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: regexp_full_match(x, '[ \t\r]*')) AS blank FROM files),
b AS (SELECT *, list_position(blank, false) AS f FROM a),
c AS (SELECT *, list_position(blank[f:], true) AS e FROM b WHERE f > 0),
l AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS line FROM a),
three AS (SELECT doc_id, line, x, coalesce(lag(x) OVER w || ' ', '') || x || coalesce(' ' || lead(x) OVER w, '') AS y FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
parts AS (SELECT doc_id, line, 0 AS wide, x FROM three UNION ALL SELECT doc_id, line, 1, y FROM three
  UNION ALL SELECT doc_id, 0, 2, array_to_string(CASE WHEN e > 0 THEN l[f:f + e - 2] ELSE l[f:] END, ' ') FROM c UNION ALL SELECT doc_id, 0, 3, array_to_string(l, ' ') FROM c WHERE gives),
tf AS (SELECT doc_id, line, wide, t, count(*) AS tf FROM (SELECT doc_id, line, wide, unnest(regexp_extract_all(lower(x), '{TERM}')) AS t FROM parts) GROUP BY ALL),
v AS (SELECT tf.*, tf * idf AS w FROM tf JOIN idf USING (t)),
norm AS (SELECT doc_id, line, wide, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
cos AS (SELECT doc_id, line, license, round(sum(w * u) / any_value(norm), 6) AS score FROM v JOIN nu USING (t) JOIN norm USING (doc_id, line, wide) GROUP BY doc_id, line, wide, license, k),
own AS (SELECT doc_id, license, score, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line) AS r FROM cos WHERE score >= 0.75) WHERE r = 1),
found AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, o.license, o.score, o.line FROM files f LEFT JOIN own o USING (doc_id)),
givers AS (SELECT dir AS from_dir, license AS given FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS r FROM found WHERE license IS NOT NULL AND regexp_matches(path, '/(?i:licen[cs]e|copying|notice)([.\-_][^/]*)?$')) WHERE r = 1),
nearest AS (SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir, arg_max(given, length(from_dir)) AS given FROM (SELECT DISTINCT dir FROM found) d JOIN givers g ON g.from_dir = '' OR d.dir = g.from_dir OR starts_with(d.dir, g.from_dir || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(license, given) AS license, score, line::INT AS line, CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM found LEFT JOIN nearest USING (dir)"""

OP7 = r"""WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT conv_id, max(i) AS pos FROM t WHERE role = 'assistant' GROUP BY conv_id),
ring AS (SELECT conv_id, pos, coalesce(lead(text) OVER w, first_value(text) OVER w) AS other FROM replies JOIN t USING (conv_id) WHERE i = pos WINDOW w AS (PARTITION BY conv_id // 512 ORDER BY conv_id)),
sides AS (SELECT t.conv_id, i, role, text AS a, CASE WHEN i = pos THEN other ELSE text END AS b, pos IS NOT NULL AS paired FROM t LEFT JOIN ring USING (conv_id)),
common AS (SELECT conv_id, CASE WHEN bool_and(paired) THEN coalesce(min(i) FILTER (a <> b) - 1, count(*)) ELSE 0 END AS p FROM sides GROUP BY conv_id),
parts AS (SELECT s.*, p, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(a, '<|', '< |') || '<|end|>' || chr(10) AS x, replace(b, '<|', '< |') || '<|end|>' || chr(10) AS y FROM sides s JOIN common USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(head || x)) OVER w, 0) + length(head) AS ax, coalesce(sum(length(head || y)) OVER w, 0) + length(head) AS ay FROM parts WINDOW w AS (PARTITION BY conv_id, i > p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, any_value(p)::INT AS prompt_turns, coalesce(string_agg(head || x, '' ORDER BY i) FILTER (i <= p), '') AS prompt,
  coalesce(string_agg(head || x, '' ORDER BY i) FILTER (i > p), '') AS chosen, coalesce(string_agg(head || y, '' ORDER BY i) FILTER (i > p AND paired), '') AS rejected,
  coalesce(string_agg(ax || '-' || (ax + length(x)), ',' ORDER BY i) FILTER (i > p AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(ay || '-' || (ay + length(y)), ',' ORDER BY i) FILTER (i > p AND role = 'assistant' AND paired), '') AS rejected_spans
FROM placed GROUP BY conv_id"""

OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets WHERE 100 * c >= 90 * (na + nb - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.root)
SELECT s.doc_id, coalesce(len(s.s), 0) AS n_shingles, min(root) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY ALL"""

# All phrases of one to five words of each piece, counted by language; the cut of least score, the longer candidates
# that hold a phrase, the first 2000.
OP11 = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts
), runs AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM runs WHERE len(ws) > 0
), grams AS (
  SELECT lang, m, ws[i : i + m - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) AS sizes WHERE i + m - 1 <= len(ws)
), f AS (
  SELECT lang, m, g, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM f WHERE m >= 2 AND a >= 100
), cuts AS (
  SELECT c.lang, c.m, c.g, c.a, k, n, unnest([x.a]) AS l, y.a AS r, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates) AS c JOIN totals USING (lang)
  JOIN f AS x ON x.lang = c.lang AND x.m = k AND x.g = c.g[1 : k]
  JOIN f AS y ON y.lang = c.lang AND y.m = c.m - k AND y.g = c.g[k + 1 : c.m]
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, m, g, unnest(generate_series(1, m)) AS i FROM candidates
), inside AS (
  SELECT DISTINCT p.lang, p.g[i : i + s - 1] AS g, max(p.a) AS longer
  FROM parts AS p, (SELECT unnest([2, 3, 4]) AS s) AS sizes WHERE s < p.m AND i + s - 1 <= p.m GROUP BY ALL
), best AS (
  SELECT lang, g, max(longer) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT least.*, array_to_string(g, ' ') AS phrase FROM least LEFT JOIN best USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
