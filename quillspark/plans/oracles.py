"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))

#: Macros and views that several statements start with.
_TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_DOCS = """catalogued AS (
  SELECT d.doc_id, d.text, d.lang AS game, 'corpus/' || d.source AS section, 'Document ' || d.doc_id AS title, [d.source, d.lang] AS tags,
    coalesce(l.quality, 0) AS verified, coalesce(l.toxic, 0) = 1 AS superseded, d.doc_id % 10 = 0 AS generated, d.n_chars
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""


def _terms(text: str) -> str:
    found = rf"regexp_extract_all(strip_accents({text}), '[A-Za-z0-9_][A-Za-z0-9_.\-'']*')"
    long = f"list_filter({found}, lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]'))"
    telling = f"list_filter({long}, lambda t: NOT list_contains([{_STOP}], lower(t)))"
    return f"(CASE WHEN len({telling}) > 0 THEN {telling} ELSE {long} END)[1:64]"


def _bm25(queries: str, fields: dict[str, tuple[str, float]], source: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to scores(query_id, row_id, score); queries: SELECT of item_id, text; fields: name to (expression, weight)."""
    per_field = " UNION ALL ".join(f"SELECT {key} AS row_id, {w}::DOUBLE AS weight, {_TOKENS.format(e)} AS toks FROM {source}" for e, w in fields.values())
    return f"""asked AS ({queries}),
phrases AS (
  SELECT query_id, phrase FROM (
    SELECT item_id AS query_id, {_TOKENS.format("term")} AS phrase FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM asked))
  WHERE len(phrase) > 0),
fielded AS ({per_field}),
lengths AS (SELECT row_id, sum(len(toks)) AS length FROM fielded GROUP BY row_id),
stats AS (SELECT count(*) AS n_rows, avg(length) AS avg_length FROM lengths),
postings AS (SELECT row_id, weight, toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM fielded),
found AS (
  SELECT p.phrase, t.row_id, sum(t.weight) AS f FROM (SELECT DISTINCT phrase FROM phrases) p
  JOIN postings t ON t.term = p.phrase[1] AND (len(p.phrase) = 1 OR t.toks[t.pos:t.pos + len(p.phrase) - 1] = p.phrase) GROUP BY p.phrase, t.row_id),
freq AS (SELECT phrase, count(*) AS df FROM found GROUP BY phrase),
idfs AS (SELECT phrase, CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM freq, stats),
scores AS (
  SELECT p.query_id, f.row_id, sum(i.idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.length / s.avg_length))) AS score
  FROM phrases p JOIN found f USING (phrase) JOIN idfs i USING (phrase) JOIN lengths l USING (row_id), stats s GROUP BY p.query_id, f.row_id)"""


def _shown(ctes: str, k: int) -> str:
    return f"""WITH {ctes}
SELECT query_id, row_id AS doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM scores) WHERE rank <= {k}"""


_TEXT = {"text": ("text", 1.0)}
_FIRST = "SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0"

_ITEMS = "row_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)"
_UNIT = """unit AS (SELECT vec_id AS row_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v FROM embeddings)"""


def _near(queries: str, rows: str, k: int) -> str:
    return f"""{_UNIT},
near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
      SELECT q.row_id AS query_id, r.row_id, r.label, round(list_dot_product(q.v, r.v), 9) AS score FROM unit q, unit r WHERE q.{queries} AND {rows}))
  WHERE rank <= {k})"""


def _hybrid(allowed: str, k: int, routed: str | None = None) -> str:
    """Fused and capped hits of the query set; allowed and routed are predicates on catalogued rows."""
    arm = lambda name, no, rows, most: f"SELECT query_id, row_id, '{name}' AS arm, {no} AS arm_no, rank FROM (SELECT s.query_id, s.row_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, s.row_id) AS rank FROM scores s JOIN catalogued c ON c.doc_id = s.row_id WHERE {rows}) WHERE rank <= {most}"
    extra = f" UNION ALL {arm('records', 2, routed, 20)}" if routed else ""
    return f"""WITH {_DOCS}, {_bm25(_FIRST, _TEXT)},
{_near(_ITEMS, f"r.row_id IN (SELECT doc_id FROM catalogued WHERE {allowed})", 60)},
arms AS ({arm("lexical", 0, allowed, 60)} UNION ALL SELECT query_id, row_id, 'semantic', 1, rank FROM near{extra}),
fused AS (SELECT query_id, row_id, round(sum(1.0::DOUBLE / (10 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(arm))), '+') AS arms, min((arm_no, rank)) AS first FROM arms GROUP BY query_id, row_id),
boosted AS (
  SELECT query_id, row_id, section, score * CASE WHEN verified > 0 THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN superseded THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS score, arms, first
  FROM fused JOIN catalogued ON doc_id = row_id),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY round(score, 9) DESC, first, row_id) AS in_doc FROM boosted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, row_id) AS rank FROM capped WHERE in_doc <= 3)
SELECT query_id, row_id AS doc_id, section, round(score, 6) AS score, arms, rank FROM ranked WHERE rank <= {k}"""


_STATES = """old AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0)"""

_ROUTED = r"""paths AS (SELECT source, doc_id, lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents),
routed AS (
  SELECT path, CASE
    WHEN regexp_full_match(path, 'en/src1.*/.*\.md') AND NOT regexp_full_match(path, '(.*/)?.*7\.md') THEN 0
    WHEN starts_with(path, 'en/') THEN 1
    WHEN regexp_full_match(path, '.*/src[0-4]/.*\.md') THEN 2
    ELSE 3 END AS pos, source, doc_id FROM paths WHERE path LIKE '%.md')"""

_RECORDS = """records AS (
  SELECT p_partkey AS path, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '_' || p_partkey AS editor_id,
    lpad(printf('%X', p_partkey), 6, '0') AS form_id, replace(p_brand, '#', '') || '.esp' AS plugin, p_type, p_name FROM part)"""


def _split(e: str) -> str:
    """Identifiers as words, without look-behind: two passes with groups."""
    first = f"regexp_replace({e}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    second = f"regexp_replace({first}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({second}, '[_\\-]+', ' ', 'g'), ' +', ' ', 'g'))"


def _capital(e: str) -> str:
    return f"(upper(({e})[1]) || lower(({e})[2:]))"


_RECORD_TEXT = "'FormKey: 1' || chr(10) || 'Name:' || chr(10) || '  TargetLanguage: English' || chr(10) || '  Values:' || chr(10)"

ORACLES: dict[str, str] = {
    "bm25_topk": _shown(_bm25(_FIRST, _TEXT), 10),
    "bm25_blocks": _shown(_bm25(_FIRST, _TEXT), 10),
    "bm25_batch": _shown(_bm25("SELECT item_id, text FROM benchmark", _TEXT), 10),
    "bm25_two_field": _shown(_bm25("SELECT 0::BIGINT AS item_id, 'src3 fr threthe leaux corpus' AS text", {"breadcrumb": ("'the corpus ' || source || ' ' || lang", 2.0), "text": ("text", 1.0)}), 20),
    "bm25_phrase": _shown(_bm25("SELECT 0::BIGINT AS item_id, 'mit.license apache.license.version released' AS text", _TEXT), 50),
    "term_stats": f"SELECT term, count(*)::BIGINT AS df, sum(n)::BIGINT AS cf FROM (SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n_rows, round(avg(len({_TOKENS.format('text')})), 6) AS avg_length FROM documents",
    "stopword_query_terms": f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM benchmark",
    "cosine_topk": f"WITH {_near('row_id % 20 = 0', 'true', 10)} SELECT query_id, row_id AS vec_id, round(score, 6) AS score, rank FROM near",
    "cosine_filtered": f"WITH {_near('row_id % 20 = 0', 'r.label IN (1, 3, 5)', 10)} SELECT query_id, row_id AS vec_id, round(score, 6) AS score, rank FROM near",
    "cosine_clusters": f"WITH {_near('row_id % 20 = 0', 'r.label IN (1, 3, 5)', 10)} SELECT query_id, row_id AS vec_id, round(score, 6) AS score, rank FROM near",
    "l2_normalise": f"WITH {_UNIT} SELECT row_id AS vec_id, round(v[1], 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM unit",
    "rrf_fuse": f"""WITH {_bm25(_FIRST, _TEXT)}, {_near(_ITEMS, "r.row_id IN (SELECT doc_id FROM documents)", 60)},
arms AS (
  SELECT query_id, row_id, 'lexical' AS arm, rank FROM (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM scores) WHERE rank <= 60
  UNION ALL SELECT query_id, row_id, 'semantic', rank FROM near)
SELECT query_id, row_id AS doc_id, round(round(sum(1.0::DOUBLE / (10 + rank)), 9), 6) AS score, array_to_string(list_sort(list_distinct(list(arm))), '+') AS arms FROM arms GROUP BY query_id, row_id""",
    "hybrid_search": _hybrid("game IN ('fr', 'en') AND NOT generated AND NOT superseded", 10),
    "hybrid_routed": _hybrid("NOT generated", 20, "generated"),
    "per_doc_cap": f"""WITH {_near("row_id % 20 = 0", "true", 60)},
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rank) AS in_doc FROM near),
ranked AS (SELECT query_id, row_id AS vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, near_rank) AS rank FROM (SELECT *, rank AS near_rank FROM capped) WHERE in_doc <= 3)
SELECT * FROM ranked WHERE rank <= 10""",
    "dedupe_first": "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label",
    "filter_scope_sentinel": f"WITH {_DOCS} SELECT doc_id, game FROM catalogued WHERE game IN ('de', 'both')",
    "filter_section_prefix": f"WITH {_DOCS} SELECT doc_id, section FROM catalogued WHERE section = 'corpus' OR starts_with(section, 'corpus/')",
    "filter_tag": f"WITH {_DOCS} SELECT doc_id, array_to_string(tags, ',') AS tags FROM catalogued WHERE list_contains(tags, 'src3')",
    "filter_flags": f"""WITH {_DOCS}, modes AS (SELECT unnest(['exclude', 'include', 'only']) AS mode), flags AS (SELECT unnest([false, true]) AS superseded)
SELECT mode AS generated, flags.superseded, (SELECT count(*) FROM catalogued c WHERE (mode = 'include' OR c.generated = (mode = 'only')) AND (flags.superseded OR NOT c.superseded)) AS n FROM modes, flags""",
    "list_docs": f"WITH {_DOCS} SELECT section, doc_id, title FROM catalogued WHERE game IN ('es', 'none') ORDER BY section, doc_id LIMIT 50",
    "substring_catalog": f"WITH {_DOCS} SELECT doc_id, title FROM catalogued WHERE contains(lower(title), 'document 1') OR contains(doc_id::VARCHAR, 'document 1')",
    "index_stats": f"WITH {_DOCS} SELECT count(*) AS n_docs, count(*) FILTER (generated) AS n_generated, count(*) FILTER (superseded) AS n_superseded, count(*) FILTER (verified > 0) AS n_verified, count(DISTINCT section) AS n_sections, sum(n_chars)::BIGINT AS n_chars FROM catalogued",
    "counts_union_all": "SELECT 'documents' AS source_set, lang AS game, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'part', p_brand, count(*) FROM part GROUP BY ALL",
    "count_distinct_types": "SELECT p_brand, count(DISTINCT p_type) AS n_types, count(*) AS n, count(*) FILTER (p_size > 25) AS n_large FROM part GROUP BY p_brand",
    "refresh_plan": f"WITH {_STATES} SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.doc_id = new.doc_id",
    "pending_vectors": f"WITH {_DOCS} SELECT doc_id AS chunk_id FROM catalogued WHERE NOT generated AND doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "orphans": f"WITH {_STATES} SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)",
    "file_state_diff": """WITH o AS (SELECT o_orderkey AS path, o_totalprice AS size, epoch(o_orderdate)::BIGINT AS mtime FROM orders),
a AS (SELECT * FROM o WHERE path % 3 <> 0), b AS (SELECT path, CASE WHEN path % 17 = 0 THEN size + 1 ELSE size END AS size, mtime FROM o WHERE path % 13 <> 0)
SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b ON a.path = b.path GROUP BY ALL""",
    "first_mapping_wins": f"WITH {_ROUTED} SELECT pos, count(*) AS n FROM routed GROUP BY pos",
    "glob_route": f"""WITH {_ROUTED} SELECT path, CASE pos WHEN 0 THEN 'english/teens/' || path[4:] WHEN 1 THEN 'english/all/' || path[4:] WHEN 2 THEN 'low/' || source || '-' || doc_id || '.md' ELSE 'rest/' || path END AS dest FROM routed""",
    "title_collisions": "SELECT doc_id, title || ' (' || source || ')' AS unique_title FROM (SELECT doc_id, source, string_split(text, chr(10))[1] AS title, count(*) OVER (PARTITION BY string_split(text, chr(10))[1]) AS n FROM documents) WHERE n > 1",
    "duplicate_copies": "SELECT sha256(text) AS content_sha256, min(doc_id) AS canonical, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "marker_counts": r"""SELECT doc_id, len(regexp_extract_all(body, '\[verified\b'))::BIGINT AS verified, len(regexp_extract_all(body, '\[upstream\b'))::BIGINT AS upstream, 0::BIGINT AS author
FROM (SELECT doc_id, replace(replace(text, '. ', '. [verified] '), ', ', ', [upstream: x] ') AS body FROM documents)""",
    "identifier_split": f"SELECT p_partkey, {_split(_capital('string_split(p_name, chr(32))[1]') + ' || ' + _capital('string_split(p_name, chr(32))[-1]') + chr(32) + '|| ' + repr('XMLFile_') + ' || p_partkey || ' + repr('-v2Beta'))} AS words FROM part",
    "record_shape": r"""SELECT p_partkey, q, coalesce(regexp_matches(q, '\b(?:0x[0-9A-Fa-f]{4,8}|[0-9A-Fa-f]{8})\b') OR regexp_matches(q, '(?i)[\w\-'' ]+\.(?:esp|esm|esl)\b')
  OR regexp_matches(q, '\b[A-Za-z][A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*\b|\b\w*_[A-Za-z]\w*\b'), false) AS shaped
FROM (SELECT p_partkey, [lpad(printf('%X', p_partkey), 8, '0'), '0x' || lpad(printf('%X', p_partkey), 6, '0'), lpad(printf('%X', p_partkey), 6, '0'), p_brand || '.esp',
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), replace(p_name, ' ', '_'), p_name][p_partkey % 7 + 1] AS q FROM part)""",
    "exact_key_lookup": f"WITH {_RECORDS} SELECT a.path AS asked, b.path, b.editor_id FROM records a JOIN records b ON a.form_id || ':' || a.plugin = b.form_id || ':' || b.plugin WHERE a.path % 10 = 0",
    "lookup_ranked": f"""WITH {_RECORDS}, asked AS (SELECT {_terms("p_name")} AS terms FROM part WHERE p_partkey = 42),
fielded AS ({" UNION ALL ".join(f"SELECT path, {w}::DOUBLE AS weight, {_TOKENS.format(e)} AS toks FROM records" for e, w in (("editor_id", 4), (_split("editor_id"), 3), ("p_name", 3), ("p_type", 1)))}),
lengths AS (SELECT path, sum(len(toks)) AS length FROM fielded GROUP BY path),
stats AS (SELECT count(*) AS n_rows, avg(length) AS avg_length FROM lengths),
phrases AS (SELECT lower(unnest(terms)) AS term FROM asked),
found AS (SELECT term, path, sum(weight) AS f FROM (SELECT path, weight, unnest(toks) AS term FROM fielded) WHERE term IN (SELECT term FROM phrases) GROUP BY term, path),
freq AS (SELECT term, count(*) AS df FROM found GROUP BY term),
idfs AS (SELECT term, CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM freq, stats),
scores AS (SELECT f.path, sum(i.idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.length / s.avg_length))) AS score FROM phrases p JOIN found f USING (term) JOIN idfs i USING (term) JOIN lengths l USING (path), stats s GROUP BY f.path),
ranked AS (SELECT path, score, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS rank FROM scores)
SELECT path, 1 AS arm, editor_id AS label, round(score, 6) AS score, rank FROM ranked JOIN records USING (path) WHERE rank <= 30""",
    "neighbour_window": "SELECT conv_id, turn, role FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations w WHERE w.conv_id = c.conv_id AND abs(w.turn - c.turn) <= 1 AND w.role = 'user' AND length(w.text) > 300)",
    "outline_runs": """WITH f AS (SELECT conv_id, turn, length(text) > 200 AS long, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, length(text) > 200 ORDER BY turn) AS run FROM conversations)
SELECT conv_id, long, min(turn) AS first, max(turn) AS last, count(*) AS n FROM f GROUP BY conv_id, long, run""",
    "budget_truncate": """SELECT conv_id, turn, least(length(text), 600 - before)::BIGINT AS shown FROM (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 600""",
    "token_estimate": "SELECT doc_id, greatest(1, round_even(length(text) / 4, 0))::BIGINT AS n_tokens FROM documents",
    "body_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "truncate_text": "SELECT doc_id, sha256(left(text, 300)) AS head_sha256 FROM documents",
    "line_pack": """WITH RECURSIVE lines AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS sizes FROM documents WHERE length(text) > 3000),
fold AS (
  SELECT doc_id, sizes, 1 AS i, 1 AS parts, sizes[1] AS size FROM lines
  UNION ALL
  SELECT doc_id, sizes, i + 1, CASE WHEN size + sizes[i + 1] + 1 > 1800 THEN parts + 1 ELSE parts END, CASE WHEN size + sizes[i + 1] + 1 > 1800 THEN sizes[i + 1] ELSE size + sizes[i + 1] + 1 END FROM fold WHERE i < len(sizes))
SELECT doc_id, parts::BIGINT AS parts FROM fold WHERE i = len(sizes)""",
    "link_extract": """SELECT page_id, unnest(range(len(hrefs)))::BIGINT AS n, unnest(hrefs) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)""",
    "link_neighbours": """SELECT href, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
    "eval_recall_mrr": f"""WITH {_bm25("SELECT item_id, text FROM benchmark", _TEXT)},
top AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM scores),
good AS (SELECT query_id, min(rank) AS hit_rank FROM top WHERE rank <= 5 AND row_id % 20 = query_id % 20 GROUP BY query_id)
SELECT count(*) AS n_cases, round(avg(CASE WHEN hit_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / hit_rank, 0.0::DOUBLE)), 6) AS mrr
FROM benchmark LEFT JOIN good ON item_id = query_id""",
    "frontmatter_parse": "SELECT doc_id, lang, source, n_chars::VARCHAR AS n_chars, sha256(regexp_replace(text, '^\\n+', '')) AS body_sha256 FROM documents",
    "extract_name": "SELECT p_partkey, p_name AS name FROM part",
    "trim_locales": f"SELECT p_partkey, {_RECORD_TEXT} || '  - Language: English' || chr(10) || '    String: ''' || p_name || '''' || chr(10) || 'Keywords:' || chr(10) || '- one' || chr(10) || '# (1 non-English localisations omitted)' AS text FROM part",
}
