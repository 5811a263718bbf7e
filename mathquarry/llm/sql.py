"""SQL that checks the queries which SQL can express: terms, n-grams and near-duplicates."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from mathquarry.plans.formula_sql import ELEMENTS


@lru_cache(1)
def compatible() -> str:
    """compat (c, m): what compatibility decomposition makes of each character that has one; composing is left to ``nfc_normalize``."""
    every = (chr(i) for i in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    plain = lambda c: unicodedata.normalize("NFKD", c).replace("'", "''")
    rows = ", ".join(f"('{c}', '{plain(c)}')" for c in every if unicodedata.decomposition(c).startswith("<"))
    return f"compat AS (SELECT * FROM (VALUES {rows}) t(c, m))"


def word_lists(name: str, source: str) -> str:
    """``name`` (r, w): the words of each row of ``source``, a query of (r, text), as a list; rows of null text have none."""
    return rf"""{name}_raw AS (SELECT r, regexp_replace(text, '(?i)<fid\b[^>]*>', ' ', 'g') AS s FROM ({source})),
{name}_chars AS (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM (SELECT r, regexp_extract_all(s, '(?s).') AS x FROM {name}_raw WHERE regexp_matches(s, '[^\x00-\x7F]'))),
{name}_texts AS (SELECT r, s AS t FROM {name}_raw WHERE NOT regexp_matches(s, '[^\x00-\x7F]') UNION ALL SELECT r, nfc_normalize(string_agg(coalesce(m, c), '' ORDER BY i)) FROM {name}_chars LEFT JOIN compat USING (c) GROUP BY r),
{name} AS (SELECT r, regexp_extract_all(lower(regexp_replace(t, '\p{{Cf}}+', '', 'g')), '[\p{{L}}\p{{N}}]{{2,}}') AS w FROM {name}_texts)"""


#: content (f, w): the terms of each well-formed formula as a list, by local names.
TERMS = rf"""{ELEMENTS},
named AS (SELECT f, a, z, level, regexp_extract(name, '[^:]*$') AS name FROM el0),
first_of AS (SELECT c.f, c.a, c.name, row_number() OVER (PARTITION BY c.f, p.a ORDER BY c.a) AS nth FROM named c JOIN named p ON p.f = c.f AND p.level = c.level - 1 AND p.a < c.a AND c.a < p.z WHERE p.name = 'apply'),
leaf AS (SELECT e.f, e.z, e.name, regexp_replace(string_agg(t.s, '' ORDER BY t.p), '^\s+|\s+$', '', 'g') AS s FROM named e JOIN plain t ON t.f = e.f AND e.a < t.p AND t.p < e.z WHERE e.name IN ('ci', 'cn') GROUP BY e.f, e.a, e.z, e.name),
term AS (SELECT f, a AS p, 'opr:' || name AS t FROM first_of WHERE nth = 1 UNION ALL SELECT f, z, CASE name WHEN 'ci' THEN 'sym:' ELSE 'num:' END || s FROM leaf WHERE s <> ''),
content AS (SELECT x, list(t ORDER BY p) AS w FROM term JOIN mk USING (f) GROUP BY x)"""


def ngrams(longest: int, rare: int, common: int) -> str:
    """marked (field, ngram, n_terms, n_occurrences, n_records, mark)."""
    return f"""WITH {compatible()}, thm AS (SELECT row_number() OVER () AS r, text FROM (SELECT DISTINCT document, paragraph_id, text FROM theorem)),
{word_lists('thm_words', 'SELECT r, text FROM thm')}, {TERMS},
recs AS (SELECT DISTINCT document, formula_id, c_math_ml FROM formula),
records AS (SELECT 'theorem.text' AS field, r, w FROM thm_words UNION ALL SELECT 'formula.c_math_ml', row_number() OVER (), w FROM recs JOIN content ON x = c_math_ml),
totals AS (SELECT 'theorem.text' AS field, count(*) AS total FROM thm UNION ALL SELECT 'formula.c_math_ml', count(*) FROM recs),
grams AS (SELECT field, r, CAST(k AS INTEGER) AS n_terms, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS ngram FROM records, (SELECT unnest(range(1, {longest + 1})) AS k) WHERE len(w) >= k),
counted AS (SELECT field, ngram, n_terms, count(*) AS n_occurrences, count(DISTINCT r) AS n_records FROM grams GROUP BY ALL),
marked AS (SELECT counted.*, CASE WHEN n_records < {rare} THEN 'rare' WHEN n_records * {common} > total THEN 'common' END AS mark FROM counted JOIN totals USING (field))
"""


def near_duplicates() -> str:
    """All pairs that share a word, counted; no filter that the operator has."""
    return f"""WITH {compatible()}, keyed AS (SELECT DISTINCT 'theorem.text' AS field, coalesce(document, '') || '|' || coalesce(paragraph_id, '') AS key, text FROM theorem UNION SELECT DISTINCT 'document.title', id, title FROM document),
numbered AS (SELECT row_number() OVER () AS r, * FROM keyed), {word_lists('words', 'SELECT r, text FROM numbered')},
sets AS (SELECT DISTINCT field, key, list_sort(list_distinct(w)) AS ws FROM words JOIN numbered USING (r) WHERE len(w) > 0 AND key IS NOT NULL),
classes AS (SELECT row_number() OVER () AS c, field, ws, len(ws) AS n FROM (SELECT DISTINCT field, ws FROM sets)), one AS (SELECT c, field, n, unnest(ws) AS word FROM classes),
similar_ AS (SELECT x.c AS a, y.c AS b FROM one x JOIN one y ON x.field = y.field AND x.word = y.word AND x.c < y.c AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY x.c, y.c, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM similar_ UNION ALL SELECT c, c FROM classes), who AS (SELECT c, field, key FROM sets JOIN classes USING (field, ws))
SELECT DISTINCT p.field, least(p.key, q.key) AS key_a, greatest(p.key, q.key) AS key_b FROM links JOIN who p ON p.c = a JOIN who q ON q.c = b WHERE p.key <> q.key"""
