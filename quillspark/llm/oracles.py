"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

from .common import ASCII_UPPER
from .divergence import ORACLE as DIVERGENCE
from .mixing import ORACLE as MIXING
from .packed_products import ORACLE as HARD_NEGATIVES
from .url_filter import ALPHABET, ORDER, RULES

_LOWER = f"translate({{0}}, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(seen) FROM reach WHERE node = doc_id)::BIGINT AS component_id FROM sets
"""

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
found AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, (SELECT min(seen) FROM reach WHERE node = vec_id)::BIGINT AS component_id FROM embeddings)
SELECT *, vec_id = component_id AS kept FROM found
"""

LINES = f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
lines AS (SELECT t, i, string_split(t, chr(10))[i] AS line FROM (SELECT t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM texts)),
split AS (SELECT t, i, list_transform({_WORDS.format("line")}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM lines),
marks AS (SELECT t, i, toks, len(toks) AS n, (len(toks), toks[1:3]) AS leaf FROM split WHERE len(toks) > 0),
weighed AS (SELECT leaf, toks, n, count(DISTINCT t) AS texts FROM marks GROUP BY ALL),
busy AS (SELECT leaf, sum(texts) AS total FROM weighed GROUP BY leaf HAVING sum(texts) >= 5),
fields AS (SELECT leaf, toks, n, texts, total, unnest(toks) AS token, generate_subscripts(toks, 1) AS spot FROM weighed JOIN busy USING (leaf)),
held AS (SELECT leaf, spot, token, sum(texts) >= 5 AS frequent, 2 * sum(texts) > total AS major FROM fields GROUP BY leaf, spot, token, total),
known AS (
  SELECT leaf, toks, n, count(*) FILTER (frequent) AS of_frequent, count(*) FILTER (major) AS of_major, list(CASE WHEN frequent THEN token END ORDER BY spot) AS body
  FROM fields JOIN held USING (leaf, spot, token) GROUP BY leaf, toks, n),
templates AS (
  SELECT leaf, toks, body, 1 AS kind FROM known WHERE of_frequent >= 0.8::DOUBLE * n
  UNION ALL SELECT leaf, toks, [], 0 FROM known WHERE of_major >= 0.8::DOUBLE * n),
fitting AS (SELECT m.t, m.i, leaf, body, kind FROM marks m JOIN templates USING (leaf, toks)),
often AS (SELECT leaf, body, kind FROM fitting GROUP BY ALL HAVING count(DISTINCT t) >= 5),
cut AS (SELECT t, list(DISTINCT i) AS cut FROM fitting SEMI JOIN often USING (leaf, body, kind) GROUP BY t)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(cut, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN cut ON t = coalesce(text, '')
"""


def _urls() -> str:
    rule = verdict = ""
    for decision, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN"
        rule += f" {fits} '{text}'"
        verdict += f" {fits} '{decision}'"
    orders = []
    for n in range(1, ORDER + 1):
        low = f"1.0::DOUBLE / {len(ALPHABET) + 1} AS a_low, 1.0::DOUBLE / {len(ALPHABET) + 1} AS b_low" if n == 1 else "a_p AS a_low, b_p AS b_low"
        below = "" if n == 1 else f" JOIN p{n - 1} ON p{n - 1}.gram = right(g.gram, {n - 1})"
        p = lambda k: f"CASE WHEN {k}_total > 0 THEN ({k} + {k}_kinds * {k}_low) / ({k}_total + {k}_kinds) ELSE {k}_low END AS {k}_p"  # noqa: B023, E731
        orders.append(
            f"""g{n} AS (SELECT right(gram, {n}) AS gram, left(right(gram, {n}), {n - 1}) AS context, sum(a) AS a, sum(b) AS b FROM counts GROUP BY ALL),
c{n} AS (SELECT context, sum(a) AS a_total, sum(b) AS b_total, count(*) FILTER (a > 0) AS a_kinds, count(*) FILTER (b > 0) AS b_kinds FROM g{n} GROUP BY context),
p{n} AS (SELECT gram, {p("a")}, {p("b")} FROM (SELECT g.gram, g.a, g.b, c.*, {low} FROM g{n} g JOIN c{n} c ON c.context = g.context{below}))"""
        )
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, CASE{rule} END AS rule, CASE{verdict} END AS decided FROM parts),
urls AS (SELECT DISTINCT host, path, decided, '^^^' || regexp_replace(translate(lower(host || path), '123456789', '000000000'), '[^a-z0\\-._~/%]', '?', 'g') || '$' AS padded FROM ruled),
grams AS (SELECT host, path, decided, substr(padded, i, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(padded) - {ORDER - 2})) AS i FROM urls)),
counts AS (SELECT gram, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b FROM grams GROUP BY gram),
{", ".join(orders)},
scored AS (SELECT host, path, decided, avg(ln(a_p) - ln(b_p)) AS score FROM grams JOIN p{ORDER} USING (gram) GROUP BY ALL),
fit AS (SELECT avg(score) FILTER (decided = 'allow') AS ma, avg(score) FILTER (decided = 'block') AS mb, stddev_pop(score) FILTER (decided = 'allow') AS sa, stddev_pop(score) FILTER (decided = 'block') AS sb FROM scored),
level AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN '-infinity'::DOUBLE WHEN sa + sb = 0 THEN (ma + mb) / 2 ELSE (ma * sb + mb * sa) / (sa + sb) END AS level FROM fit)
SELECT page_id, r.host, r.path, rule, coalesce(r.decided, CASE WHEN score >= level THEN 'allow' ELSE 'block' END) AS verdict FROM ruled r JOIN scored s ON r.host = s.host AND r.path = s.path, level
"""


ORACLES: dict[str, str] = {
    "op4_source_mixing": MIXING,
    "op6_url_filter": _urls(),
    "op7_ngram_jaccard_join": JACCARD,
    "op9_cap_near_dup": NEAR_VECTORS,
    "op10_line_dedup": LINES,
    "op11_source_divergence": DIVERGENCE,
    "op12_hard_negatives": HARD_NEGATIVES,
}
