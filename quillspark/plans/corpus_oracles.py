"""DuckDB SQL for the registered queries over a derived corpus."""

from __future__ import annotations

from .oracles import _DOCS, _FIRST, _RECORDS, _TOKENS, _bm25, _split

_NL = "chr(10)"

#: Files by rules on doc_id, routed and parsed; final is the text as it is written, with links rewritten.
_SYNCED = rf"""files AS (
  SELECT *, doc_id % 9 = 0 AS is_txt, lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path,
    lead(CASE WHEN doc_id % 9 <> 0 THEN doc_id END) OVER (PARTITION BY lang, source, doc_id % 9 = 0 ORDER BY doc_id) AS after FROM documents),
routed AS (
  SELECT *, CASE
    WHEN is_txt THEN 4
    WHEN regexp_full_match(path, 'en/src1.*/.*\.md') AND NOT regexp_full_match(path, '(.*/)?.*7\.md') THEN 0
    WHEN starts_with(path, 'en/') THEN 1
    WHEN regexp_full_match(path, '.*/src[0-4]/.*\.md') THEN 2
    ELSE 3 END AS pos,
    CASE WHEN regexp_full_match(lang || '/' || source || '/' || after || '.md', 'en/src1.*/.*\.md') AND after % 10 <> 7 THEN 0 WHEN lang = 'en' THEN 1 WHEN regexp_full_match(source, 'src[0-4]') THEN 2 ELSE 3 END AS after_pos
  FROM files),
placed AS (
  SELECT *, CASE pos WHEN 0 THEN 'english/teens/' || path[4:] WHEN 1 THEN 'english/all/' || path[4:] WHEN 2 THEN 'low/' || source || '-' || doc_id || '.md' WHEN 3 THEN 'rest/' || path ELSE 'notes/' || path || '.md' END AS dest,
    CASE after_pos WHEN 0 THEN 'english/teens/' || source || '/' || after WHEN 1 THEN 'english/all/' || source || '/' || after WHEN 2 THEN 'low/' || source || '-' || after ELSE 'rest/' || lang || '/' || source || '/' || after END AS after_id,
    CASE WHEN after IS NULL THEN 'gone.md' WHEN pos = after_pos THEN CASE WHEN pos = 2 THEN source || '-' ELSE '' END || after || '.md' WHEN after_pos = 0 THEN '../../teens/' || source || '/' || after || '.md' ELSE '../../all/' || source || '/' || after || '.md' END AS to_after
  FROM routed),
written AS (
  SELECT *, regexp_replace(dest, '\.md$', '') AS id, regexp_replace(CASE WHEN is_txt THEN '' ELSE '' END ||
      CASE WHEN doc_id % 3 <> 0 THEN '# Title ' || doc_id % 50 || ' `code`' ELSE 'plain opening' END || CASE WHEN doc_id % 7 = 0 THEN {_NL} || '> Generated by `tool' || doc_id % 3 || '`.' ELSE '' END ||
      CASE WHEN doc_id % 11 = 0 THEN {_NL} || '> **Superseded** by x' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN {_NL} || '**Phase ' || doc_id % 4 || ', document ' || doc_id || '.**' ELSE '' END ||
      {_NL} || '[next](' || CASE WHEN is_txt THEN coalesce(after::VARCHAR, 'gone') || '.md' ELSE to_after END || '#x) [verified] `[code](no.md)`' || {_NL} || '```' || {_NL} || '[in fence](no.md)' || {_NL} || '```' || {_NL} || '[site](https://x.y/z)' || {_NL} || text, '\n+$', '') AS main
  FROM placed),
finals AS (
  SELECT *, string_split(id, '/')[-1] AS slug, string_split(path, '/')[-1] AS name,
    CASE WHEN is_txt THEN '# ' || string_split(path, '/')[-1] || {_NL} || {_NL} || '```text' || {_NL} || CASE WHEN doc_id % 6 = 0 THEN '---' || {_NL} || 'name: "n' || doc_id || '"' || {_NL} || 'model: big' || {_NL} || 'owner: me' || {_NL} || '---' || {_NL} || {_NL} ELSE '' END || main || {_NL} || '```' ELSE main END || {_NL} AS final
  FROM written),
titled AS (SELECT *, CASE WHEN is_txt THEN name WHEN doc_id % 3 <> 0 THEN 'Title ' || doc_id % 50 || ' code' ELSE slug END AS title, regexp_replace(id, '/[^/]*$', '') AS section, NOT is_txt AND doc_id % 6 = 0 AS has_header FROM finals),
synced AS (
  SELECT doc_id, dest, slug, id, title, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN title || ' (' || section || ')' END AS unique_title, section, CASE pos WHEN 0 THEN 'guide' ELSE 'reference' END AS kind, 'g' AS game,
    CASE WHEN pos <> 1 THEN 'p' END AS project, CASE pos WHEN 0 THEN 't,source:corpus' ELSE 'source:corpus' END AS tags, NOT is_txt AND doc_id % 7 = 0 AS generated,
    CASE WHEN NOT is_txt AND doc_id % 7 = 0 THEN 'tool' || doc_id % 3 END AS generator, NOT is_txt AND doc_id % 11 = 0 AS superseded, CASE WHEN NOT is_txt AND doc_id % 13 = 0 THEN 'Phase ' || doc_id % 4 || ', document ' || doc_id END AS phase,
    CASE WHEN has_header THEN 'n' || doc_id END AS agent_name, CASE WHEN has_header THEN 'big' END AS model, CASE WHEN has_header THEN 'me' END AS owner,
    (length(final) - length(replace(final, {_NL}, '')))::BIGINT AS lines, len(regexp_extract_all(final, '\[verified\b'))::BIGINT AS n_verified, sha256(final) AS content_sha256,
    CASE WHEN is_txt OR after IS NULL THEN '' ELSE after_id END AS links_out, CASE WHEN is_txt OR after IS NOT NULL THEN '[]' ELSE '[{{"target":"gone.md#x","reason":"missing"}}]' END AS unresolved
  FROM titled)"""

#: A file for each part, by its id: what stands in it, and its size in bytes.
_RECORD_FILES = """named AS (SELECT *, 'Name: ' || p_name || chr(10) AS named, upper(lpad(printf('%X', p_partkey), 6, '0')) AS form_id, replace(p_brand, '#', '') || '.esp' AS plugin FROM part),
record_files AS (
  SELECT *, p_type || '/' || replace(p_name, ' ', '') || ' - ' || lower(form_id) || '_' || plugin || CASE WHEN p_partkey % 5 = 0 THEN '/RecordData.yaml' ELSE '.yaml' END AS path,
    length(named) + CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 12000 WHEN 2 THEN 4 ELSE 8400 END AS size FROM named)"""

_CHUNKED = r"""lines AS (SELECT doc_id, title, i, string_split(body, chr(10))[i] AS line FROM (SELECT doc_id, title, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM src)),
heads AS (SELECT *, length(regexp_extract(line, '^\s{0,3}(#{1,3})\s+\S', 1)) AS level, regexp_extract(line, '^\s{0,3}#{1,3}\s+(.+?)\s*#*\s*$', 1) AS h FROM lines),
numbered AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s0 FROM heads),
sec AS (
  SELECT doc_id, s0, sum(length(line) + 1) - 1 AS size, max(level) AS level, max(CASE WHEN level > 0 THEN h END) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY s0) AS s
  FROM numbered GROUP BY doc_id, s0 HAVING bool_or(trim(line) <> '')),
fold AS (
  SELECT doc_id, s, s0, CASE WHEN level >= 2 THEN [h] ELSE []::VARCHAR[] END AS above, CASE WHEN level >= 2 THEN [h] ELSE []::VARCHAR[] END AS gpath, size::BIGINT AS gsize, 1 AS g FROM sec WHERE s = 1
  UNION ALL
  SELECT doc_id, s, s0, path, CASE WHEN NOT joins THEN path WHEN len(gpath) > 1 AND len(path) > 1 AND gpath[2] = path[2] THEN path ELSE path[1:1] END, CASE WHEN joins THEN gsize + size + 1 ELSE size END::BIGINT, CASE WHEN joins THEN g ELSE g + 1 END
  FROM (
    SELECT *, coalesce(len(gpath) > 0 AND gpath[1] = path[1] AND least(gsize, size) < 400 AND gsize + size + 1 <= 1800, false) AS joins
    FROM (SELECT x.doc_id, x.s, x.s0, x.size, f.gpath, f.gsize, f.g, CASE WHEN x.level <= 1 THEN []::VARCHAR[] WHEN x.level = 2 THEN [x.h] ELSE list_concat(f.above[1:1], [x.h]) END AS path FROM fold f JOIN sec x ON x.doc_id = f.doc_id AND x.s = f.s + 1))),
groups AS (SELECT doc_id, g, arg_max(gpath, s) AS gpath, arg_max(gsize, s) AS gsize FROM fold GROUP BY ALL),
gl AS (SELECT n.doc_id, n.title, f.g, n.i, n.line, row_number() OVER (PARTITION BY n.doc_id, f.g ORDER BY n.i) AS k FROM numbered n JOIN fold f ON n.doc_id = f.doc_id AND n.s0 = f.s0),
cut AS (
  SELECT l.doc_id, l.g, l.k, 1 AS part, length(line)::BIGINT AS size FROM gl l JOIN groups USING (doc_id, g) WHERE gsize > 3000 AND k = 1
  UNION ALL
  SELECT l.doc_id, l.g, l.k, CASE WHEN c.size + length(l.line) + 1 > 1800 THEN c.part + 1 ELSE c.part END, CASE WHEN c.size + length(l.line) + 1 > 1800 THEN length(l.line) ELSE c.size + length(l.line) + 1 END::BIGINT
  FROM cut c JOIN gl l ON l.doc_id = c.doc_id AND l.g = c.g AND l.k = c.k + 1),
parts AS (SELECT l.doc_id, l.title, l.g, coalesce(c.part, 1) AS part, trim(string_agg(l.line, chr(10) ORDER BY l.k), chr(10)) AS text FROM gl l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.g = l.g AND c.k = l.k GROUP BY ALL),
chunks AS (
  SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.g, p.part) - 1 AS chunk_index, p.doc_id || '#' || (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.g, p.part) - 1) AS chunk_id,
    array_to_string(list_concat([p.title], gpath), ' › ') AS breadcrumb, text FROM parts p JOIN groups USING (doc_id, g))"""

_HEADED = r"""src AS (
  SELECT doc_id::VARCHAR AS doc_id, 'Document ' || doc_id AS title, '# Document ' || doc_id || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN (i - 1) % 12 = 0 THEN '## Part ' || ((i - 1) // 12) || chr(10) WHEN (i - 1) % 4 = 0 THEN '### Bit ' || ((i - 1) // 4) || ' ##' || chr(10) ELSE '' END || x), chr(10)) AS body FROM documents)"""
_CHUNKS_OF_HEADED = f"WITH RECURSIVE {_HEADED}, {_CHUNKED}"

#: The state that an index is brought to.
_NEW = """fresh AS (
  SELECT doc_id::VARCHAR AS doc_id, title, CASE WHEN doc_id % 11 = 0 THEN text || ' changed words' ELSE text END AS body, CASE WHEN doc_id % 13 = 0 THEN 'both' ELSE game END AS game, section, generated, superseded, verified
  FROM catalogued WHERE doc_id % 5 <> 0),
src AS (SELECT doc_id, title, body FROM fresh)"""
_INDEXED = f"WITH RECURSIVE {_DOCS}, {_NEW}, {_CHUNKED}"
_CHUNK_FIELDS = {"breadcrumb": ("breadcrumb", 2.0), "text": ("text", 1.0)}

_RECORD_STATE = """was AS (
  SELECT 'r/' || path AS path, path AS n, editor_id, form_id, plugin, p_type, CASE WHEN path % 3 = 0 THEN 'one' ELSE 'both' END AS game, CASE WHEN path % 11 = 0 THEN p_name || ' renamed thing' ELSE p_name END AS name_en FROM records),
now_records AS (SELECT * FROM was WHERE n % 5 <> 0),
now_scripts AS (
  SELECT 's/' || s_suppkey AS path, s_name AS name, 'both' AS game, s_name || ' script of nation ' || s_nationkey || CASE WHEN s_suppkey % 11 = 0 THEN ' renamed thing' ELSE '' END AS text FROM supplier WHERE s_suppkey % 5 <> 0)"""
_RECORD_FIELDS = (("editor_id", 4), (_split("editor_id"), 3), ("name_en", 3), ("p_type", 1))
_SCRIPT_FIELDS = (("name", 5), (_split("name"), 4), ("text", 1))


def _fielded(name: str, table: str, fields) -> str:
    per = " UNION ALL ".join(f"SELECT path, {w}::DOUBLE AS weight, {_TOKENS.format(e)} AS toks FROM {table}" for e, w in fields)
    return f"{name} AS ({per})"


def _scored(name: str, fielded: str, terms: str) -> str:
    """CTEs up to name(path, score) for single-token terms."""
    return f"""{name}_lengths AS (SELECT path, sum(len(toks)) AS length FROM {fielded} GROUP BY path),
{name}_stats AS (SELECT count(*) AS n_rows, avg(length) AS avg_length FROM {name}_lengths),
{name}_found AS (SELECT term, path, sum(weight) AS f FROM (SELECT path, weight, unnest(toks) AS term FROM {fielded}) WHERE term IN ({terms}) GROUP BY term, path),
{name}_idf AS (SELECT term, CASE WHEN ln((max(n_rows) - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((max(n_rows) - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM {name}_found, {name}_stats GROUP BY term),
{name} AS (SELECT f.path, sum(i.idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.length / s.avg_length))) AS score FROM {name}_found f JOIN {name}_idf i USING (term) JOIN {name}_lengths l USING (path), {name}_stats s GROUP BY f.path)"""


def _asked(name: str, arms: str, most: int = 40) -> str:
    return f"SELECT '{name}' AS asked, path, arm::BIGINT AS arm, label, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY arm, round(score, 9) DESC, path) AS rank FROM ({arms})) WHERE rank <= {most}"


_ARM_R = "SELECT path, 1 AS arm, editor_id AS label, score FROM {0} JOIN now_records USING (path)"
_ARM_S = "SELECT path, 2, name, score FROM {0} JOIN now_scripts USING (path)"
_SETS = """SELECT 'part' AS source_set, game, count(*) AS n_records, 0::BIGINT AS n_scripts, count(DISTINCT p_type) AS n_types, count(*) FILTER (name_en <> '') AS n_named FROM now_records GROUP BY game"""

def _searched(asked: str, allowed: str, shown: str) -> str:
    """Keyword search of the engine for all of asked, of chunks that are allowed to a query; shown comes from best."""
    return f"""{_INDEXED}, {_bm25(asked, _CHUNK_FIELDS, source="chunks", key="chunk_id")},
ranked AS (
  SELECT s.query_id, c.chunk_id, c.doc_id, verified, superseded, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, c.chunk_id) AS arm_rank
  FROM scores s JOIN chunks c ON c.chunk_id = s.row_id JOIN fresh USING (doc_id) WHERE {allowed}),
boosted AS (SELECT *, round(1.0::DOUBLE / (10 + arm_rank), 9) * CASE WHEN verified > 0 THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN superseded THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS score FROM ranked WHERE arm_rank <= 60),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, arm_rank) AS in_doc FROM boosted),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arm_rank) AS rank FROM capped WHERE in_doc <= 3){shown if shown.startswith(",") else " " + shown}"""


ORACLES: dict[str, str] = {
    "sync_documents": f"WITH {_SYNCED} SELECT * EXCLUDE (doc_id, dest, slug) FROM synced",
    "corpus_roundtrip": f"WITH {_SYNCED} SELECT dest AS path, id, title, content_sha256, content_sha256 AS body_sha256, (24 + CASE WHEN unique_title IS NULL THEN 0 ELSE 1 END + CASE WHEN agent_name IS NULL THEN 0 ELSE 3 END)::BIGINT AS n_keys FROM synced",
    "sync_report": f"""WITH {_SYNCED}
SELECT 1::BIGINT AS part, section, id AS key, '| [' || slug || '](' || dest || ') | ' || replace(title, '|', chr(92) || '|') || ' | ' || kind || ' | g | corpus | ' || lines || ' | ' || CASE WHEN generated THEN 'G' ELSE '' END || CASE WHEN superseded THEN 'S' ELSE '' END || ' |' AS line FROM synced
UNION ALL SELECT 2, '', id || ' gone.md#x', '| ' || id || ' | gone.md#x | missing |' FROM synced WHERE unresolved <> '[]'
UNION ALL SELECT 3, '', title || ' ' || id, '| ' || title || ' | ' || id || ' |' FROM synced WHERE unique_title IS NOT NULL""",
    "section_counts": f"WITH {_SYNCED} SELECT section, count(*) AS n_docs FROM synced GROUP BY section",
    "catalog_classify": f"""WITH {_SYNCED}
SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM synced UNION ALL SELECT 'gone/' || id, 'removed' FROM synced WHERE doc_id % 25 = 0""",
    "corpus_union": r"""SELECT 'd/' || doc_id AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'New ' || doc_id ELSE 'Document ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\n+', '') ELSE text END AS body, source AS section, CASE WHEN doc_id % 2 = 0 THEN 'both' ELSE lang END AS game, 'k' AS kind, 'docs/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\n+', '') ELSE text END) AS content_sha256 FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'curated/b' || item_id, 'curated/b' || item_id, text, 'curated', 'both', 'curated', 'curated/b' || item_id || '.md', sha256(text) FROM benchmark""",
    "copies_check": """WITH pairs AS (SELECT doc_id AS canonical, coalesce(lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id), -1) AS copy, doc_id % 2 = 1 AS expect_divergent FROM documents)
SELECT canonical, copy, expect_divergent, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.text = b.text THEN 'same' WHEN expect_divergent THEN 'expected' ELSE 'diverged' END AS status
FROM pairs JOIN documents a ON a.doc_id = canonical LEFT JOIN documents b ON b.doc_id = copy""",
    "link_resolve": r"""WITH there AS (
  SELECT source || ':' || lang || '/' || doc_id || '.md' AS id, source, CASE WHEN source IN ('src1', 'src2') THEN 'x' ELSE 'y' END AS game, lang || '/' || doc_id || '.md' AS path FROM documents
  UNION ALL SELECT DISTINCT source || ':' || lang || '/README', source, CASE WHEN source IN ('src1', 'src2') THEN 'x' ELSE 'y' END, lang || '/README.md' FROM documents),
raw AS (
  SELECT source || ':' || lang || '/' || doc_id || '.md' AS doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'x' ELSE 'y' END AS game, x.n, x.target, x.fragment, x.joined
  FROM documents, (SELECT unnest([
    {n: 0::BIGINT, target: (doc_id + 1) || '.md', fragment: '', joined: lang || '/' || (doc_id + 1) || '.md'}, {n: 1, target: '../' || lang, fragment: '', joined: lang}, {n: 2, target: '../../out.md', fragment: '', joined: '../out.md'},
    {n: 3, target: './' || doc_id || '.md', fragment: '#here', joined: lang || '/' || doc_id || '.md'}, {n: 4, target: 'none.md', fragment: '', joined: lang || '/none.md'}, {n: 5, target: (doc_id + 2) || '.md', fragment: '', joined: lang || '/' || (doc_id + 2) || '.md'}]) AS x)),
hits AS (
  SELECT r.doc_id, r.n, t.id, (CASE WHEN t.path = r.joined THEN 0 ELSE 1 END, r.source <> t.source, r.game <> t.game, t.id) AS place FROM raw r JOIN there t ON t.path = r.joined OR t.path = r.joined || '/README.md'),
best AS (SELECT doc_id, n, arg_min(id, place) AS resolved FROM hits GROUP BY ALL)
SELECT r.doc_id, r.n, r.target, r.fragment, resolved, CASE WHEN resolved IS NULL THEN 'missing' END AS reason FROM raw r LEFT JOIN best USING (doc_id, n)""",
    "record_identity": """SELECT p_partkey, replace(p_name, ' ', '') AS editor_id, upper(lpad(printf('%X', p_partkey), 6, '0')) AS form_id, replace(p_brand, '#', '') || '.esp' AS plugin, p_type AS record_type
FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)""",
    "record_scan": f"""WITH {_RECORD_FILES} SELECT path, replace(p_name, ' ', '') AS editor_id, form_id || ':' || plugin AS form_key, p_type AS record_type, CASE WHEN p_partkey % 4 <> 3 THEN p_name ELSE '' END AS name_en, size FROM record_files""",
    "file_heads": f"""WITH {_RECORD_FILES}, heads AS (SELECT path, size, CASE p_partkey % 4 WHEN 0 THEN named WHEN 1 THEN named || repeat('é', (8192 - length(named)) // 2) || repeat('\ufffd', (8192 - length(named)) % 2)
  WHEN 2 THEN named || '\ufffdAB\ufffd' ELSE left(repeat('# filler line' || chr(10), 600), 8192) END AS head FROM record_files)
SELECT path, size, length(head)::BIGINT AS n_chars, md5(head) AS md5 FROM heads""",
    "eval_cases": "SELECT text AS q, 'd/' || item_id AS expect FROM benchmark",
    "file_texts": "SELECT lang, source, length(t)::BIGINT AS n_chars, sha256(t) AS sha256 FROM (SELECT lang, source, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY ALL)",
    "chunk_headings": f"""{_CHUNKS_OF_HEADED} SELECT chunk_id, doc_id, chunk_index, breadcrumb, greatest(1, round_even(length(text) / 4, 0))::BIGINT AS n_tokens, sha256(text) AS text_sha256, sha256(breadcrumb || chr(10) || chr(10) || text) AS embed_sha256 FROM chunks""",
    "chunk_audit": f"""{_CHUNKS_OF_HEADED} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (length(text) > 3000) AS oversize, 0::BIGINT AS unbalanced, round(count(*) / count(DISTINCT doc_id), 6) AS per_doc, max(length(text))::BIGINT AS longest FROM chunks""",
    "chunk_longest": f"{_CHUNKS_OF_HEADED} SELECT chunk_id, length(text)::BIGINT AS n_chars FROM chunks ORDER BY n_chars DESC, chunk_id LIMIT 8",
    "engine_refresh": f"""{_INDEXED}, fielded AS (SELECT chunk_id, unnest([{_TOKENS.format('breadcrumb')}, {_TOKENS.format('text')}]) AS toks FROM chunks)
SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf, sum(pos - 1)::BIGINT AS places FROM (SELECT chunk_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM fielded) GROUP BY term""",
    "engine_plan": """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""",
    "engine_search": f"""{_INDEXED}, {_bm25(_FIRST, _CHUNK_FIELDS, source="chunks", key="chunk_id")},
allowed AS (SELECT chunk_id, doc_id, verified FROM chunks JOIN fresh USING (doc_id) WHERE NOT generated AND NOT superseded),
ranked AS (SELECT s.query_id, a.chunk_id, a.doc_id, a.verified, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, a.chunk_id) AS arm_rank FROM scores s JOIN allowed a ON a.chunk_id = s.row_id),
boosted AS (SELECT *, round(1.0::DOUBLE / (10 + arm_rank), 9) * CASE WHEN verified > 0 THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END AS score FROM ranked WHERE arm_rank <= 60),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, arm_rank) AS in_doc FROM boosted),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arm_rank) AS rank FROM capped WHERE in_doc <= 3)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, (SELECT count(*) FROM chunks c WHERE c.doc_id = best.doc_id) AS n_chunks FROM best WHERE rank <= 5""",
    "engine_filtered": _searched(
        _FIRST, "(query_id // 20 % 3 = 0 OR section = 'corpus/src' || (query_id // 20 % 20)) AND (query_id // 20 % 2 = 0 OR NOT generated) AND (query_id // 20 % 5 = 0 OR NOT superseded)",
        "SELECT query_id, chunk_id, round(score, 6) AS score, rank, (SELECT count(*) FROM chunks c WHERE c.doc_id = best.doc_id) AS n_chunks FROM best WHERE rank <= 5",
    ),
    "engine_eval": _searched(
        "SELECT item_id, text FROM benchmark", "NOT superseded",
        """, firsts AS (SELECT query_id, doc_id, min(rank) AS first FROM best WHERE rank <= 5 GROUP BY query_id, doc_id),
docs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS doc_rank FROM firsts),
hit_of AS (SELECT query_id, min(doc_rank) AS hit_rank FROM docs WHERE doc_id::BIGINT < 1000 AND doc_id::BIGINT % 10 = query_id % 10 GROUP BY query_id),
cases AS (SELECT text AS q, hit_rank::BIGINT AS hit_rank FROM benchmark LEFT JOIN hit_of ON query_id = item_id)
SELECT q, coalesce(hit_rank, 0) AS hit_rank FROM cases UNION ALL SELECT 'all', round(round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 6) * 1000000)::BIGINT FROM cases""",
    ),
    "engine_stats": f"""{_INDEXED}, d AS (SELECT count(*) AS n_docs, count(*) FILTER (generated) AS n_generated, count(*) FILTER (superseded) AS n_superseded, count(*) FILTER (verified > 0) AS n_verified, count(DISTINCT section) AS n_sections FROM fresh)
SELECT d.*, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT sum(len({_TOKENS.format('breadcrumb')}) + len({_TOKENS.format('text')}))::BIGINT FROM chunks) AS n_tokens, (SELECT count(*) FROM chunks JOIN fresh USING (doc_id) WHERE NOT generated) AS n_vectors FROM d""",
    "engine_vectors": f"""{_INDEXED}, e AS (SELECT chunk_id, breadcrumb || chr(10) || chr(10) || text AS t FROM chunks JOIN fresh USING (doc_id) WHERE NOT generated)
SELECT chunk_id, length(t)::BIGINT AS n_chars, length(regexp_replace(t, '[^aeiou]', '', 'g'))::BIGINT AS n_vowels FROM e""",
    "engine_dump": f"{_INDEXED} SELECT chunk_id, breadcrumb, sha256(text) AS text_sha256, title, game, section FROM chunks JOIN fresh USING (doc_id)",
    "engine_links": "SELECT d.doc_id::VARCHAR AS doc_id, i - 1 AS n, (d.doc_id + i)::VARCHAR AS linked, CASE WHEN o.doc_id IS NOT NULL THEN 'Document ' || o.doc_id END AS title FROM documents d CROSS JOIN (SELECT unnest([1, 2]::BIGINT[]) AS i) LEFT JOIN documents o ON o.doc_id = d.doc_id + i",
    "records_refresh": f"""WITH {_RECORDS}, {_RECORD_STATE}, {_fielded("r", "now_records", _RECORD_FIELDS)}, {_fielded("s", "now_scripts", _SCRIPT_FIELDS)}
SELECT term, count(DISTINCT path) AS df, count(*) AS cf FROM (SELECT path, unnest(toks) AS term FROM (SELECT * FROM r UNION ALL SELECT * FROM s)) GROUP BY term""",
    "records_stats": f"WITH {_RECORDS}, {_RECORD_STATE} {_SETS} UNION ALL SELECT 'supplier', game, 0, count(*), 0, 0 FROM now_scripts GROUP BY game",
    "records_drop_set": f"WITH {_RECORDS}, {_RECORD_STATE} {_SETS} UNION ALL SELECT 'postings', '', 0, 0, 0, 0",
    "records_search": f"""WITH {_RECORDS}, {_RECORD_STATE}, {_fielded("rf", "now_records", _RECORD_FIELDS)}, {_fielded("sf", "now_scripts", _SCRIPT_FIELDS)},
{_scored("rw", "rf", "'renamed', 'thing'")}, {_scored("sw", "sf", "'renamed', 'thing'")}, {_scored("sk", "sf", "'script', 'nation', '7'")}, {_scored("rg", "rf", "'renamed'")}, {_scored("sg", "sf", "'renamed'")}, {_scored("rk", "rf", "'00000b'")}
{_asked("words", _ARM_R.format("rw") + " UNION ALL " + _ARM_S.format("sw"))}
UNION ALL {_asked("kind", "SELECT path, 2 AS arm, name AS label, score FROM sk JOIN now_scripts USING (path)")}
UNION ALL {_asked("game", _ARM_R.format("rg") + " UNION ALL " + _ARM_S.format("sg"))}
UNION ALL {_asked("key", "SELECT path, 0 AS arm, editor_id AS label, 100.0::DOUBLE AS score FROM now_records WHERE form_id = '00000B' UNION ALL " + _ARM_R.format("rk"))}""",
    "records_read": f"""WITH {_RECORDS}, {_RECORD_STATE}, {_fielded("sf", "now_scripts", _SCRIPT_FIELDS)}, {_scored("sk", "sf", "'script', 'nation', '7'")},
ranked AS (SELECT path, name, text, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS rank FROM sk JOIN now_scripts USING (path))
SELECT rank, path, name AS label, CASE WHEN rank = 1 THEN text END AS text FROM ranked WHERE rank <= 4""",
    "engine_fetch": f"""{_INDEXED}, wanted AS (SELECT (item_id + 1)::VARCHAR AS doc_id FROM benchmark WHERE item_id % 20 = 0), ends AS (SELECT doc_id, max(chunk_index)::BIGINT AS last FROM chunks GROUP BY doc_id)
SELECT doc_id, 'whole' AS how, 0::BIGINT AS first, last, CASE WHEN length(body) > 2000 THEN '(opening)' ELSE title END AS heading, CASE WHEN length(body) <= 2000 THEN sha256(body) END AS text_sha256 FROM wanted JOIN fresh USING (doc_id) JOIN ends USING (doc_id)
UNION ALL SELECT doc_id, 'chunk', chunk_index, chunk_index, '(opening)', sha256(text) FROM wanted JOIN chunks USING (doc_id) WHERE chunk_index <= 1""",
}
