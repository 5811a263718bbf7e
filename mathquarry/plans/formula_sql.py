"""SQL that reads content MathML and makes its feature sets, to check the operators that parse it in Arrow batches.

Markup is cut into tags and text by one pattern.  A running sum of opened and
closed tags gives each its level; within a formula and level, tags must open
and close in turn under one name, else the markup is malformed.  An element is an
interval of places, and what is inside another is found by comparing intervals, so
no recursion is needed: a serialised subtree is the text of its tags in their order.
"""

from __future__ import annotations

NAME = r"[A-Za-z_:][\w:.\-]*"

#: el (f, a, z, level, name, text): the elements of each well-formed formula f and of mk (f, x), its markup.
ELEMENTS = rf"""mk AS (SELECT row_number() OVER () AS f, x FROM (SELECT DISTINCT c_math_ml AS x FROM formula WHERE c_math_ml <> '')),
cut AS (SELECT f, x, regexp_extract_all(x, '(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<[^<>]*>|[^<]+') AS t FROM mk),
tok AS (SELECT f, generate_subscripts(t, 1) AS i, unnest(t) AS s FROM cut),
kinds AS (SELECT f, i, s, CASE WHEN starts_with(s, '<!--') OR starts_with(s, '<?') THEN 'c' WHEN starts_with(s, '<![CDATA[') THEN 'd' WHEN starts_with(s, '</') THEN 'e' WHEN NOT starts_with(s, '<') THEN 't' WHEN ends_with(s, '/>') THEN 's' ELSE 'o' END AS k FROM tok),
ev AS (SELECT f, 2 * i AS p, s, CASE k WHEN 's' THEN 'o' ELSE k END AS k, k IN ('o', 's', 'e') AS tag FROM kinds UNION ALL SELECT f, 2 * i + 1, s, 'e', true FROM kinds WHERE k = 's'),
deep AS (SELECT *, sum(CASE k WHEN 'o' THEN 1 WHEN 'e' THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE WHEN tag THEN 1 ELSE 0 END) OVER w AS run, regexp_extract(s, '^</?({NAME})', 1) AS name FROM ev WINDOW w AS (PARTITION BY f ORDER BY p)),
tags AS (SELECT f, p, k, name, depth + (k = 'e')::INT AS level FROM deep WHERE tag),
turns AS (SELECT *, lead(k) OVER w AS nk, lead(name) OVER w AS nn, lead(p) OVER w AS z, lag(k) OVER w AS lk FROM tags WINDOW w AS (PARTITION BY f, level ORDER BY p)),
bad AS (
  SELECT f FROM turns WHERE CASE k WHEN 'o' THEN nk IS DISTINCT FROM 'e' OR nn <> name ELSE lk IS DISTINCT FROM 'o' END
  UNION SELECT f FROM turns WHERE k = 'o' AND level = 1 GROUP BY f HAVING count(*) > 1
  UNION SELECT f FROM deep WHERE k IN ('t', 'd') AND depth = 0 AND trim(s, E' \n\r\t') <> ''
  UNION SELECT f FROM kinds WHERE k = 't' AND contains(regexp_replace(s, '&(#[0-9]+|#x[0-9a-fA-F]+|amp|lt|gt|quot|apos);', '', 'g'), '&')
  UNION SELECT f FROM kinds WHERE k = 'e' AND NOT regexp_full_match(s, '</{NAME}\s*>')
  UNION SELECT f FROM kinds WHERE k IN ('o', 's') AND NOT regexp_full_match(s, '<{NAME}(\s+[\w:.\-]+\s*=\s*("[^"]*"|''[^'']*''))*\s*/?>')
  UNION SELECT f FROM cut WHERE length(array_to_string(t, '')) <> length(x)
  UNION SELECT f FROM mk WHERE f NOT IN (SELECT f FROM tags)
),
el0 AS (SELECT f, p AS a, z, level, name FROM turns WHERE k = 'o' AND f NOT IN (SELECT f FROM bad)),
plain AS (SELECT f, run, p, depth, CASE WHEN k = 'd' THEN substr(s, 10, length(s) - 12) WHEN NOT contains(s, '&') THEN s ELSE array_to_string([CASE
    WHEN starts_with(q, '&#x') THEN chr(CAST('0x' || substr(q, 4, length(q) - 4) AS INTEGER)) WHEN starts_with(q, '&#') THEN chr(CAST(substr(q, 3, length(q) - 3) AS INTEGER))
    WHEN q = '&amp;' THEN '&' WHEN q = '&lt;' THEN '<' WHEN q = '&gt;' THEN '>' WHEN q = '&quot;' THEN '"' WHEN q = '&apos;' THEN '''' ELSE q END FOR q IN regexp_extract_all(s, '&[^;]*;|[^&]+')], '') END AS s
  FROM deep WHERE k IN ('t', 'd') AND f NOT IN (SELECT f FROM bad)),
runs AS (SELECT f, run, min(p) AS p, min(depth) AS depth, regexp_replace(string_agg(s, '' ORDER BY p), '^\s+|\s+$', '', 'g') AS s FROM plain GROUP BY f, run)"""

#: One interval in another: the elements of a tree without the elements that only group others.
_CONTENT = f"""{ELEMENTS},
txt AS (SELECT e.f, e.a, string_agg(r.s, '' ORDER BY r.run) AS text FROM el0 e JOIN runs r ON r.f = e.f AND r.depth = e.level AND r.p > e.a AND r.p < e.z GROUP BY e.f, e.a),
par AS (SELECT c.f, c.a, c.z, c.level, c.name, p.a AS pa, p.name AS pname, row_number() OVER (PARTITION BY c.f, p.a ORDER BY c.a) AS nth FROM el0 c LEFT JOIN el0 p ON p.f = c.f AND p.level = c.level - 1 AND p.a < c.a AND c.a < p.z),
el AS (SELECT par.*, coalesce(pname = 'apply' AND nth = 1, false) AS op, coalesce(text, '') AS text FROM par LEFT JOIN txt USING (f, a))"""

#: features (f, token) by content.
CONTENT = f"""{_CONTENT},
features AS (SELECT f, 'opr:' || name AS token FROM el WHERE op UNION ALL SELECT f, CASE name WHEN 'ci' THEN 'sym:' ELSE 'num:' END || text FROM el WHERE name IN ('ci', 'cn') AND text <> '')"""

#: features (f, token) by serialised and generalised subtrees of at most 200 characters.
LIN = f"""{_CONTENT},
kids AS (SELECT f, pa AS a, count(*) AS n, count(*) FILTER (NOT op) AS inner_n, min(name) FILTER (nth = 1) AS first_name FROM el WHERE pa IS NOT NULL GROUP BY f, pa),
n AS (SELECT el.*, coalesce(n, 0) AS n, coalesce(inner_n, 0) AS inner_n, first_name,
  count(*) FILTER (NOT op) OVER (PARTITION BY f, pa ORDER BY el.a) AS nth_inner,
  (SELECT count(*) FROM el o WHERE o.f = el.f AND o.op AND o.a <= el.a AND el.a < o.z) AS ops FROM el LEFT JOIN kids USING (f, a)),
heads AS (SELECT *, CASE WHEN name = 'apply' THEN CASE WHEN n > 0 THEN first_name END WHEN text <> '' THEN text END AS head FROM n),
pieces AS (
  SELECT f, a, ops, a AS p, CASE WHEN nth_inner > 1 THEN '>' ELSE '' END AS sep, name || '(' || coalesce(head, '') || CASE WHEN head IS NOT NULL AND inner_n > 0 THEN '#' ELSE '' END AS s FROM heads WHERE NOT op
  UNION ALL SELECT f, a, ops, z, '', ')' FROM heads WHERE NOT op),
serial AS (SELECT h.f, h.a, string_agg(CASE WHEN p.a = h.a THEN p.s ELSE p.sep || p.s END, '' ORDER BY p.p) AS token FROM heads h JOIN pieces p ON p.f = h.f AND p.ops = h.ops AND p.a >= h.a AND p.a < h.z WHERE NOT h.op AND h.n > 0 GROUP BY h.f, h.a),
general AS (SELECT c.f, c.pa AS a, string_agg(CASE WHEN c.op THEN c.name ELSE c.name || '(' || CASE WHEN c.name = 'apply' AND c.n > 0 THEN c.first_name ELSE '' END || ')' END, '>' ORDER BY c.a) AS inside FROM n c WHERE c.pa IS NOT NULL GROUP BY c.f, c.pa),
every AS (SELECT f, token FROM serial UNION ALL SELECT f, name || '(' || text || ')' FROM n WHERE n = 0 AND text <> '' UNION ALL SELECT g.f, el.name || '(' || inside || ')' FROM general g JOIN el ON el.f = g.f AND el.a = g.a),
features AS (SELECT f, token FROM every WHERE length(token) <= 200)"""

#: features (f, token) by paths and pairs of neighbouring leaves; elements that only group others are looked through.
KRISTIANTO = f"""{ELEMENTS},
seen AS (SELECT * FROM el0 WHERE name NOT IN ('math', 'mrow', 'mfence')),
own AS (SELECT r.f, r.run, r.s, max(e.a) AS a FROM runs r JOIN seen e ON e.f = r.f AND e.a < r.p AND r.p < e.z GROUP BY r.f, r.run, r.s),
txt AS (SELECT f, a, string_agg(s, '' ORDER BY run) AS text FROM own GROUP BY f, a),
up AS (SELECT c.f, c.a, c.z, c.name, count(p.a) AS level, max(p.a) AS pa FROM seen c LEFT JOIN seen p ON p.f = c.f AND p.a < c.a AND c.a < p.z GROUP BY c.f, c.a, c.z, c.name),
nodes AS (SELECT up.*, row_number() OVER (PARTITION BY f, pa ORDER BY a) AS place, row_number() OVER (PARTITION BY f ORDER BY a) AS nth, CASE WHEN coalesce(text, '') = '' THEN name ELSE name || '#' || text END AS label,
  NOT EXISTS (SELECT 1 FROM seen c WHERE c.f = up.f AND c.a > up.a AND c.a < up.z) AS leaf FROM up LEFT JOIN txt USING (f, a)),
leaves AS (SELECT * FROM nodes WHERE leaf AND nth > 1),
walks AS (SELECT l.f, l.a, l.label, l.level, list(n.place::VARCHAR ORDER BY n.a) AS places FROM leaves l JOIN nodes n ON n.f = l.f AND n.a <= l.a AND l.a < n.z GROUP BY ALL),
steps AS (SELECT f, label, level, places, unnest(range(0, level + 1)) AS j FROM walks),
runs_of AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a) AS g FROM (SELECT *, CASE WHEN pa IS NOT DISTINCT FROM lag(pa) OVER (PARTITION BY f ORDER BY a) AND lag(a) OVER (PARTITION BY f ORDER BY a) IS NOT NULL THEN 0 ELSE 1 END AS new FROM leaves)),
features AS (
  SELECT f, 'o:' || array_to_string(list_append(places[level + 2 - j:], label), '#') AS token FROM steps
  UNION ALL SELECT f, 'u:' || repeat('#', j) || label FROM steps
  UNION ALL SELECT x.f, 's:' || x.label || '-' || y.label FROM runs_of x JOIN runs_of y ON x.f = y.f AND x.g = y.g AND x.a < y.a)"""

METHODS = {"content": CONTENT, "lin": LIN, "kristianto": KRISTIANTO}

#: Features of each formula of an article, one row for each occurrence.
RECORDS = "recs AS (SELECT DISTINCT document, formula_id, c_math_ml FROM formula), rec_features AS (SELECT document, formula_id, c_math_ml, token FROM recs JOIN mk ON mk.x = recs.c_math_ml JOIN features USING (f))"


def features_sql(method: str) -> str:
    return f"{METHODS[method]}, {RECORDS}"
