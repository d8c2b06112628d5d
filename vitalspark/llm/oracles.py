"""DuckDB SQL for those opN_ queries that SQL can express."""

from __future__ import annotations

from vitalspark.llm import licenses

_SPACE = r"'[^\x20\x09-\x0D]+'"

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACE}), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS a FROM d),
g AS (SELECT doc_id, a, md5(array_to_string(w[a:a + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, a FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(a, a + 35)) AS i FROM r),
e AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum(column: str) -> str:
    return f"coalesce(regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), {_ALNUM}), [])"


OP10 = f"""
WITH d AS (SELECT doc_id, {_alnum('text')} AS w FROM documents),
b AS (SELECT item_id, {_alnum('text')} AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS p FROM
  (SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[a:a + 9] END AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS a FROM b WHERE len(w) > 0))),
l AS (SELECT DISTINCT n FROM t),
s AS (SELECT doc_id, n, a, array_to_string(w[a:a + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS a FROM d, l)),
m AS (SELECT s.doc_id, s.a, s.n, t.item_id FROM s JOIN t ON s.p = t.p AND s.n = t.n),
h AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(a, a + n)) AS i FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_SPACE}), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[a:a + 4] END, ' ')) AS h
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * same >= 75 * (x.n + y.n - same)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d JOIN c ON d.doc_id = c.node LEFT JOIN n ON d.doc_id = n.doc_id
"""

_TEMPLATES = [(i, label, licenses.template_words(text)) for i, (label, text) in enumerate(licenses.TEMPLATES)]
_VALUES = ", ".join(f"({i}, '{label}', {words}, {licenses.needed(len(words))})" for i, label, words in _TEMPLATES)

OP7 = f"""
WITH d AS (SELECT doc_id, {_alnum('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT doc_id, i - 1 AS a, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
  WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM p),
n AS (SELECT doc_id, count(*) AS n, min(a) AS lo, max(a) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b WHERE label IS NOT NULL GROUP BY doc_id),
t(id, label, words, needed) AS (VALUES {_VALUES}),
l AS (SELECT doc_id, unnest(string_split(translate(text, '{_UPPER}', '{_LOWER}'), chr(10))) AS line FROM documents),
o AS (SELECT doc_id, {_alnum('line')} AS w FROM l),
m AS (SELECT doc_id, t.label, len(list_intersect(list_distinct(o.w), t.words)) AS k, t.needed, len(t.words) AS size FROM o, t),
f AS (SELECT doc_id, label, max(k / size) AS c FROM m WHERE k >= needed GROUP BY doc_id, label),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION SELECT doc_id, label FROM b WHERE label IS NOT NULL) GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS c FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_base, CAST(n.lo AS BIGINT) AS first_word, CAST(n.hi AS BIGINT) AS last_word,
  coalesce(n.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN n.n > 0 THEN 1.0 ELSE coalesce(s.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

_TERMS11 = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_P = "1 + (1000000000 * ({} + 1)) // ({} + {})"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_TERMS11}), []) AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_P.format("coalesce(c.c, 0)", "coalesce(n.n, 0)", "v.v")} AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
l AS (SELECT t.lang, t.term, {_P.format("t.c", "s.n", "v.v")} AS q FROM (SELECT lang, term, sum(c)::BIGINT AS c FROM c GROUP BY lang, term) t
  JOIN (SELECT lang, sum(n)::BIGINT AS n FROM n GROUP BY lang) s ON t.lang = s.lang JOIN v ON t.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - l.q) * (p.p - l.q) // l.q FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.c > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

_TERMS13 = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms13(column: str) -> str:
    return f"coalesce(regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), {_TERMS13}), [])"


OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_terms13('text')} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
t AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(w) AS term FROM d) GROUP BY i, term),
b AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(w) AS term FROM (SELECT DISTINCT item_id, text, {_terms13('text')} AS w FROM benchmark)) GROUP BY item_id, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
m AS (SELECT i, doc_id, 100 - 75 + (75 * len(w) * docs) // words AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, m.i, m.doc_id, sum(r * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN f USING (term) JOIN t USING (term) JOIN m ON t.i = m.i GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, i) AS INTEGER) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4, "op7_license_scan": OP7, "op9_minhash_near_dedup": OP9, "op10_decontamination": OP10, "op11_source_divergence": OP11, "op13_ranked_search": OP13}
