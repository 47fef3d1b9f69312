"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .hostrep import DEVIATIONS, MAX_BAD, RULES, TWO_LABEL_SUFFIXES
from .licenses import CONTAINMENT, PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NEAREST = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) WHEN len(w) > 0 THEN [concat_ws(' ', VARIADIC_W)] ELSE [] END) AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM n),
r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
""".replace("concat_ws(' ', VARIADIC_W)", "array_to_string(w, ' ')")


def _licenses() -> str:
    share = f"{CONTAINMENT.denominator} * k >= {CONTAINMENT.numerator} * len(t)"
    phrases = ", ".join(f"({_text(p)}, {_text(v)})" for p, v in PHRASES.items())
    templates = ", ".join(f"({i}, {_text(v)}, {_text(t)})" for i, (v, t) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
ph AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)),
tp AS (SELECT id, label, list_distinct(string_split(p, ' ')) AS t FROM (VALUES {templates}) v(id, label, p)),
place AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: list_slice(w, i + 1, i + len(p)) = p)) AS i FROM d, ph),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM place GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents),
block AS (SELECT row_number() OVER () AS b, doc_id, list_distinct(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS w FROM line),
hit AS (SELECT b, doc_id, id, label, t, k FROM (SELECT b, doc_id, id, label, t, len(list_intersect(w, t)) AS k FROM block, tp) WHERE {share}),
best AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.b = h.b AND len(o.t) > len(h.t) AND list_has_all(o.t, h.t))),
found AS (SELECT doc_id, count(*) AS n_blocks, list_distinct(list(label)) AS labels, max(CAST(k AS DOUBLE) / len(t)) AS score FROM best GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(f.score, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def _hosts() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    strength = lambda t, m: f"""(SELECT 1 / coalesce(CASE WHEN b - e > 0 THEN greatest(1e-3, least(0.9, (s - e) / (b - e))) ELSE 0.1 END, 0.1) - 1
      FROM (SELECT sum(n * pow(bad / CAST(n AS DOUBLE) - {m}, 2)) AS s, sum(n * {m} * (1 - {m})) AS b, sum({m} * (1 - {m})) AS e FROM {t} WHERE n > 0))"""  # noqa: E731
    return rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad FROM u LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', '') AS bare FROM h0),
h2 AS (SELECT *, list_filter(string_split(bare, '.'), lambda x: x <> '') AS l FROM h1),
h3 AS (SELECT *, CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ({two}) THEN 2 ELSE 1 END AS k, regexp_matches(bare, '^\d+\.\d+\.\d+\.\d+$|^\[') AS ip FROM h2),
h AS (SELECT host, n, bad, CASE WHEN ip THEN bare ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix,
      CASE WHEN ip THEN bare ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain FROM h3),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / CAST(sum(n) + 2 AS DOUBLE) FROM h) AS m FROM h GROUP BY suffix),
s1 AS (SELECT suffix, (bad + c * m) / (n + c) AS m FROM s0, (SELECT {strength('s0', 'm')} AS c)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, s1.m FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix, s1.m),
d1 AS (SELECT domain, suffix, (bad + c * m) / (n + c) AS m FROM d0, (SELECT {strength('d0', 'm')} AS c)),
x0 AS (SELECT host, n, bad, d1.m FROM h JOIN d1 USING (domain, suffix)),
x1 AS (SELECT host, (bad + c * m) / (n + c) AS post, bad + c * m AS a, n - bad + c * (1 - m) AS b FROM x0, (SELECT {strength('x0', 'm')} AS c)),
x AS (SELECT host, post, greatest(0.0, post - {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM x1)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN low > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict, round(post, 6) AS posterior, round(low, 6) AS low FROM u JOIN x USING (host)
"""


ORACLE = {"op3_additive_quantisation": NEAREST, "op5_license_scan": _licenses(), "op6_jaccard_join": JACCARD, "op8_host_reputation": _hosts()}
