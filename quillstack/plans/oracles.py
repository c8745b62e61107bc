"""DuckDB SQL that gives the rows of the engine's queries."""

from __future__ import annotations

from quillstack.functions import text as t
from quillstack import schema
from quillstack.functions import labels
from quillstack.operators import chat, ingest, jobs, logs, search, verify
from quillstack import settings
from quillstack.plans.queries import ALLOWED_EXTENSIONS, ALLOWED_TYPES, INLINE_LIMIT, NAMES, ODD_VALUES, OPENINGS, OVERRIDDEN
from quillstack.sources import fixtures as fx

SQL: dict[str, str] = {}


def q(s: object) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def pick(values, by: str) -> str:
    return f"CAST([{listed(values)}] AS VARCHAR[])[({by}) % {len(values)} + 1]"


def mapped(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def iso(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 = 0 THEN '' ELSE '.' || strftime({ts}, '%f') END || 'Z')"


def extension(name: str) -> str:
    return f"lower(regexp_extract(regexp_extract(coalesce({name}, ''), '([^/]*)/*$', 1), '.(\\.[^.]+)$', 1))"


def safe_extension(name: str) -> str:
    e = extension(name)
    return f"CASE WHEN regexp_matches({e}, '^\\.[\\p{{L}}\\p{{N}}]+$') AND length({e}) <= 16 THEN {e} ELSE '.bin' END"


def title(m: str) -> str:
    folded = strip(f"regexp_replace({m}, '[\\s\\p{{Z}}]+', ' ', 'g')")
    tries = ", ".join(f"CASE WHEN regexp_matches({folded}, '^{p}') THEN {strip(f"regexp_replace({folded}, '^{p}', '')")} END" for p in t.QUESTION_PREFIXES)
    done = strip(f"regexp_replace(coalesce({tries}, {folded}), '{t.TITLE_END}', '')")
    return f"CASE WHEN length({done}) > {t.TITLE_LENGTH} THEN substr({done}, 1, {t.TITLE_LENGTH}) || '…' ELSE {done} END"


def size_label(n: str) -> str:
    f = lambda k, u: f"printf('%.1f', round({n} / {float(k)}, 1)) || ' {u}'"
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < {1 << 20} THEN {f(1 << 10, 'KB')} WHEN {n} < {1 << 30} THEN {f(1 << 20, 'MB')} ELSE {f(1 << 30, 'GB')} END"


def fmt(name: str, kind: str) -> str:
    e = extension(name)
    rules = [("pdf", t.PDF, [".pdf"]), ("docx", t.DOCX, [".docx"]), ("pptx", t.PPTX, [".pptx"]), ("markdown", t.MARKDOWN, [".md", ".markdown"]), ("txt", t.PLAIN, [".txt"])]
    return "CASE " + " ".join(f"WHEN coalesce({kind}, '') = {q(m)} OR {e} IN ({listed(x)}) THEN {q(n)}" for n, m, x in rules) + " END"


CREATED = "(TIMESTAMP '2024-01-01' + to_seconds(doc_id))"
UPLOADS = f"""uploads AS (
  SELECT doc_id AS id, source AS owner_user_id, 'doc-' || doc_id || {pick(fx.EXTENSIONS, 'doc_id')} AS original_filename, {pick(fx.TYPES, 'doc_id')} AS content_type,
         strlen(text) AS byte_size, sha256(text) AS checksum_sha256, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'stored' END AS status,
         CASE WHEN doc_id % 13 = 0 THEN {CREATED} END AS deleted_at, {CREATED} AS created_at FROM documents)"""
SEGMENTS = """segments AS (
  SELECT doc_id AS parsed_document_id, generate_subscripts(s, 1) - 1 AS sequence_index, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""
CHUNKS = f"""chunks AS (
  SELECT *, parsed_document_id * 1000000 + sequence_index AS id, heading || chr(10) || text AS contextualized_text,
         CASE WHEN (parsed_document_id * 1000000 + sequence_index) % 29 = 0 THEN NULL WHEN (parsed_document_id * 1000000 + sequence_index) % 31 = 0 THEN 0 ELSE len(w) END AS token_count
  FROM (SELECT parsed_document_id, owner_user_id, heading, CAST(i AS INTEGER) AS sequence_index, ws[i * {fx.CHUNK_WORDS} + 1 : i * {fx.CHUNK_WORDS} + {fx.CHUNK_WORDS}] AS w,
               array_to_string(ws[i * {fx.CHUNK_WORDS} + 1 : i * {fx.CHUNK_WORDS} + {fx.CHUNK_WORDS}], ' ') AS text
        FROM (SELECT *, unnest(range((len(ws) - 1) // {fx.CHUNK_WORDS} + 1)) AS i
              FROM (SELECT doc_id AS parsed_document_id, source AS owner_user_id, source || ' > ' || lang AS heading,
                           list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents) WHERE len(ws) > 0)))"""
EMBEDDINGS = """emb AS (
  SELECT vec_id AS id, vec_id // 3 AS parsed_document_id, CASE WHEN vec_id % 3 = 2 THEN 3 ELSE CAST(vec_id % 3 AS INTEGER) END AS sequence_index,
         vec_id // 3 * 1000000 + CASE WHEN vec_id % 3 = 2 THEN 3 ELSE vec_id % 3 END AS chunk_id, CASE WHEN vec_id % 23 = 0 THEN 'model-b' ELSE 'model-a' END AS model,
         CASE WHEN vec_id % 17 = 0 THEN 63 ELSE 64 END AS dimensions, CASE WHEN vec_id % 19 <> 0 THEN label END AS token_count, embedding FROM embeddings)"""
JOBS = f"""jobs AS (
  SELECT event_id AS id, user_id AS parent_id, {mapped('event_type', fx.STATUSES)} AS status, ts AS created_at, CAST(floor(value) AS BIGINT) AS declared_count FROM events)"""
LOGS = f"""logs AS (
  SELECT event_id AS id, ts, {mapped('event_type', fx.LEVELS)} AS level, sha256(CAST(user_id AS VARCHAR)) AS trace_id, 'events:' || event_type AS module,
         'value ' || CAST(floor(value) AS BIGINT) AS message, strlen(props) AS bytes FROM events)"""
KEY = lambda kind: f"'chunks/' || owner_user_id || '/' || parsed_document_id || '/job-1/' || lpad(CAST(sequence_index AS VARCHAR), 6, '0') || '_{kind}.txt'"
STORED = f"""stored AS (
  SELECT id, parsed_document_id, sequence_index, token_count, owner_user_id, text AS whole, strlen(text) AS text_bytes,
         CASE WHEN strlen(text) > {INLINE_LIMIT} THEN {KEY('text')} END AS text_storage_key, CASE WHEN strlen(text) <= {INLINE_LIMIT} THEN text END AS text,
         CASE WHEN strlen(contextualized_text) > {INLINE_LIMIT} THEN {KEY('contextualized')} END AS contextualized_text_storage_key,
         CASE WHEN strlen(contextualized_text) <= {INLINE_LIMIT} THEN contextualized_text END AS contextualized_text FROM chunks)"""
SOURCE = lambda x: f"CASE WHEN length({x}) > 0 THEN 'inline' WHEN length({x}_storage_key) > 0 THEN 'file' ELSE 'unavailable' END"
PAIRS = f"""{CHUNKS}, {STORED}, {EMBEDDINGS},
pairs AS (
  SELECT coalesce(c.parsed_document_id, e.parsed_document_id) AS parsed_document_id, coalesce(c.sequence_index, e.sequence_index) AS sequence_index,
         c.id AS cid, e.id AS eid, c.token_count AS ctok, e.token_count AS etok, c.text, c.text_storage_key, c.contextualized_text, c.contextualized_text_storage_key,
         e.model, e.dimensions, len(e.embedding) AS size
  FROM stored c FULL OUTER JOIN emb e ON c.parsed_document_id = e.parsed_document_id AND c.sequence_index = e.sequence_index)"""

# search

QV = """qv AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) + CAST(x[2] AS DOUBLE)) / 2) AS v
  FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id = 11)"""
DIST = "list_cosine_distance(CAST(embedding AS DOUBLE[]), v)"
ROUND = "round(score, 6) + 0.0"
TOP = f"{QV}, top AS (SELECT vec_id, {DIST} AS score FROM embeddings, qv ORDER BY score, vec_id LIMIT 5)"
SQL["search_topk"] = f"WITH {TOP} SELECT vec_id, {ROUND} AS score FROM top"
SQL["search_topk_many"] = f"""
WITH s AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, {ROUND} AS score FROM s
WINDOW w AS (PARTITION BY query ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 3"""
SQL["search_threshold_after_limit"] = f"WITH {TOP} SELECT vec_id, {ROUND} AS score FROM top WHERE score <= 0.5 AND (SELECT min(score) FROM top) <= 0.4"
SQL["search_best_score_gate"] = f"WITH {TOP} SELECT vec_id, {ROUND} AS score FROM top WHERE (SELECT min(score) FROM top) <= 0.2"
SQL["search_self_distance"] = f"""
WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round({DIST}, 6) + 0.0 AS score FROM embeddings, qv ORDER BY {DIST}, vec_id LIMIT 3"""
HITS = f"""{QV}, {UPLOADS}, {CHUNKS}, {EMBEDDINGS},
near AS (
  SELECT e.id, e.chunk_id, c.sequence_index, c.text, c.contextualized_text, c.heading, c.token_count, u.original_filename AS document_name, {DIST} AS score
  FROM emb e JOIN chunks c ON e.chunk_id = c.id JOIN uploads u ON c.parsed_document_id = u.id, qv ORDER BY score, e.id LIMIT 20),
hits AS (SELECT *, CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank FROM near WHERE score <= 0.9 AND (SELECT min(score) FROM near) <= 0.8)"""
SQL["search_results"] = f"""
WITH {HITS} SELECT rank, chunk_id, document_name, sequence_index, substr(text, 1, 300) AS text, substr(contextualized_text, 1, 300) AS contextualized_text, token_count, {ROUND} AS score FROM hits"""
SQL["search_result_stats"] = f"""
WITH {HITS} SELECT count(*) AS n_results, count(DISTINCT document_name) AS n_documents, round(min(score), 6) + 0.0 AS best, (SELECT count(*) FROM emb) AS n_embeddings FROM hits"""
SQL["search_doc_groups"] = f"""
WITH {HITS} SELECT CASE WHEN document_name = '' THEN {q(search.UNNAMED)} ELSE document_name END AS document_name, min(rank) AS first_rank, count(*) AS n_results,
  string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks FROM hits GROUP BY 1"""
SQL["search_score_bars"] = f"""
WITH {HITS}, m AS (SELECT *, score / greatest(max(score) OVER (), 0.001) AS share FROM hits)
SELECT rank, CAST(round(greatest(0, (1 - share) * 100), 0) AS INTEGER) AS percent, CASE WHEN share < 0.33 THEN 'near' WHEN share < 0.66 THEN 'middle' ELSE 'far' END AS colour FROM m"""
SQL["search_score_histogram"] = f"""
WITH {HITS},
o AS (SELECT min(score) AS low, max(score) AS high, count(*) AS n, least(8, count(*)) AS bins FROM hits),
w AS (SELECT *, CASE WHEN high > low THEN high - low ELSE 0.001 END / bins AS width FROM o),
b AS (SELECT CAST(i AS INTEGER) AS bin, low + i * width AS a, low + i * width + width AS z, i = bins - 1 AS is_last FROM w, range(8) r(i) WHERE i < bins)
SELECT bin, round(a, 3) AS label, (SELECT count(*) FROM hits WHERE score >= a AND (score < z OR is_last)) AS n_results FROM b"""
SQL["search_prompt"] = f"""
WITH {HITS},
c AS (SELECT coalesce(string_agg('[' || rank || '] ' || document_name || ' | ' || heading || ' | ' || (sequence_index + 1) || chr(10) || contextualized_text || chr(10), chr(10) ORDER BY rank), '') AS x FROM hits)
SELECT 1 AS position, 'system' AS role, {q(search.SYSTEM_RULES)} AS content
UNION ALL SELECT 2, 'user', 'Context:' || chr(10) || x || chr(10) || 'Question: What is said?' FROM c"""

# vectors

SQL["vector_profile"] = """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm,
       array_to_string(list_transform(embedding[1:5], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ', ') || ', …' AS preview FROM embeddings"""
SQL["vector_backfill"] = "SELECT len(embedding) = 64 AS sound, count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null FROM embeddings GROUP BY 1"
SQL["vector_invalid"] = f"WITH {EMBEDDINGS} SELECT id, dimensions, CAST(len(embedding) AS INTEGER) AS size FROM emb WHERE len(embedding) <> dimensions"

# verification

SQL["verify_pairing"] = f"WITH {PAIRS} SELECT parsed_document_id, sequence_index, cid IS NULL AS orphan_embedding, eid IS NULL AS orphan_chunk FROM pairs"
BAD = {
    verify.CHECKS[0]: "cid IS NULL OR eid IS NULL",
    verify.CHECKS[1]: "eid IS NOT NULL AND (dimensions <> 64 OR size <> 64)",
    verify.CHECKS[3]: f"cid IS NOT NULL AND {SOURCE('text')} = 'unavailable'",
    verify.CHECKS[4]: f"cid IS NOT NULL AND {SOURCE('contextualized_text')} = 'unavailable' AND (contextualized_text IS NOT NULL OR contextualized_text_storage_key IS NOT NULL)",
    verify.CHECKS[5]: "(cid IS NOT NULL AND coalesce(ctok, 0) = 0) OR (eid IS NOT NULL AND coalesce(etok, 0) = 0)",
}
FOUND = " UNION ALL ".join(
    [f"SELECT parsed_document_id, n, {q(k)} AS c, list_sort(coalesce(list(sequence_index) FILTER ({v}), [])) AS o, true AS m FROM p GROUP BY 1, 2" for k, v in BAD.items()]
    + [
        f"SELECT parsed_document_id, n, {q(verify.CHECKS[2])}, list_sort(list_filter(range(min(sequence_index), max(sequence_index) + 1), lambda x: NOT list_contains(list(sequence_index), x))), true FROM p GROUP BY 1, 2",
        f"SELECT parsed_document_id, n, {q(verify.CHECKS[6])}, [], count(DISTINCT model) <= 1 FROM p GROUP BY 1, 2",
    ]
)
CHECKED = f"""{PAIRS}, p AS (SELECT *, count(*) OVER (PARTITION BY parsed_document_id) AS n FROM pairs), found AS ({FOUND})"""
SQL["verify_checks"] = f"""
WITH {CHECKED} SELECT parsed_document_id, n AS n_pairs, c AS "check", len(o) = 0 AND m AS passed, len(o) AS n_offenders,
  array_to_string(o[1:5], ', ') || CASE WHEN len(o) > 5 THEN '...' ELSE '' END AS offenders FROM found"""
SQL["verify_verdicts"] = f"""
WITH {CHECKED} SELECT parsed_document_id, bool_and(len(o) = 0 AND m) AS passed, count(*) FILTER (len(o) = 0 AND m) AS n_passed, count(*) AS n_checks FROM found GROUP BY 1"""
SQL["verify_token_offenders"] = f"""
WITH {PAIRS}, n AS (
  SELECT parsed_document_id, count(*) FILTER (cid IS NOT NULL AND ctok IS NULL) AS null_chunks, count(*) FILTER (eid IS NOT NULL AND etok IS NULL) AS null_embeddings,
         count(*) FILTER (ctok = 0) AS zero_chunks, count(*) FILTER (etok = 0) AS zero_embeddings FROM pairs GROUP BY 1)
SELECT *, concat_ws('; ', {", ".join(f"CASE WHEN {k} > 0 THEN '{k} ' || {k} END" for k in ('null_chunks', 'null_embeddings', 'zero_chunks', 'zero_embeddings'))}) AS message FROM n"""
SQL["verify_stats"] = f"""
WITH {PAIRS} SELECT parsed_document_id, count(*) AS total_pairs, CAST(sum(coalesce(ctok, 0)) AS BIGINT) AS chunk_tokens, CAST(sum(coalesce(etok, 0)) AS BIGINT) AS embedding_tokens,
  count(*) FILTER (cid IS NOT NULL AND {SOURCE('text')} = 'inline') AS inline_texts, count(*) FILTER (cid IS NOT NULL AND {SOURCE('text')} = 'file') AS file_texts FROM pairs GROUP BY 1"""
SQL["verify_pairs_preview"] = f"""
WITH {PAIRS} SELECT parsed_document_id, sequence_index, cid AS chunk_id, nullif(substr(text, 1, 150), '') AS text_preview, CASE WHEN cid IS NOT NULL THEN {SOURCE('text')} END AS text_source,
  eid AS embedding_id, CAST(CASE WHEN eid IS NULL THEN 0 ELSE least(5, size) END AS INTEGER) AS vector_preview FROM pairs"""

# chunks and segments

SQL["chunk_words"] = f"WITH {CHUNKS} SELECT id, parsed_document_id, sequence_index, CAST(token_count AS INTEGER) AS token_count, sha256(text) AS text_sha256 FROM chunks"
SQL["chunk_hybrid_storage"] = f"""
WITH {CHUNKS}, {STORED} SELECT id, text_storage_key, contextualized_text_storage_key, text_bytes, CAST(length(text) AS INTEGER) AS inline_chars, {SOURCE('text')} AS source FROM stored"""
SQL["chunk_resolved_text"] = f"""
WITH {CHUNKS}, {STORED} SELECT id, {SOURCE('text')} AS text_source, sha256(CASE WHEN text IS NOT NULL OR id % 3 <> 0 THEN whole ELSE '' END) AS text_sha256 FROM stored"""
SQL["chunk_token_stats"] = f"""
WITH {CHUNKS} SELECT owner_user_id, count(*) AS n_chunks, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, CAST(max(token_count) AS INTEGER) AS most, count(*) FILTER (token_count IS NULL) AS n_null FROM chunks GROUP BY 1"""
SQL["chunk_metadata"] = """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN array_to_string(list_sort(list_distinct(list_filter([doc_id % 3, doc_id % 2, 1, CASE WHEN doc_id % 4 = 0 THEN 5 END], lambda x: x IS NOT NULL))), ',') END AS pages,
  CASE WHEN lang <> 'en' OR doc_id % 2 = 0 THEN concat_ws(' > ', CASE WHEN lang <> 'en' THEN lang END, CASE WHEN doc_id % 2 = 0 THEN source END) END AS headings,
  'kind=model;lang=' || lang || ';source=' || source AS meta FROM documents"""
SQL["segment_counts_per_document"] = f"""
WITH {SEGMENTS} SELECT doc_id AS id, count(parsed_document_id) AS n_segments FROM documents LEFT JOIN segments ON doc_id = parsed_document_id AND {strip('segments.text')} <> '' GROUP BY 1"""
SQL["segments_page"] = f"WITH {SEGMENTS} SELECT parsed_document_id, CAST(sequence_index AS INTEGER) AS sequence_index, text FROM segments WHERE parsed_document_id = 3 ORDER BY sequence_index LIMIT 5 OFFSET 2"
_NOISE = ["", "   ", "\t\n", "[TOC]", "[toc]", "[TOC] [TOC]", "[目录]", "[[TOC]]", "[toc] [TOC][目录]", "[Toc]", "[Toc] [Toc]", "[Toc]  [Toc]", "　", "words", "[TOC] words", None]
_rest = "text"
for _part in t.NOISE_PARTS:
    _rest = f"replace({_rest}, {q(_part)}, '')"
SQL["noise_chunks"] = f"""
WITH x AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {", ".join(f"({-i - 1}, {q(x)})" for i, x in enumerate(_NOISE))}) v(id, text))
SELECT id, coalesce(length({strip('text')}) = 0, true) OR upper({strip('text')}) IN ({listed(t.NOISE_WHOLE)}) OR coalesce(length({strip(_rest)}) = 0, true) AS is_noise FROM x"""

# embedding

_BATCH = f"{CHUNKS}, b AS (SELECT *, (row_number() OVER (PARTITION BY parsed_document_id ORDER BY sequence_index) - 1) AS i FROM chunks)"
SQL["embed_batches"] = f"WITH {_BATCH} SELECT parsed_document_id, CAST(i // 10 AS INTEGER) AS batch, count(*) AS n, CAST(max(i % 10) AS INTEGER) AS last FROM b GROUP BY 1, 2"
SQL["embed_token_apportion"] = f"""
WITH {_BATCH}, n AS (SELECT *, count(*) OVER (PARTITION BY parsed_document_id, i // 10) AS n FROM b)
SELECT id, CAST(i // 10 AS INTEGER) AS batch, CAST(i % 10 AS INTEGER) AS position, (parsed_document_id + 17) // n + CASE WHEN i % 10 < (parsed_document_id + 17) % n THEN 1 ELSE 0 END AS token_share FROM n"""
SQL["embed_zip_strict"] = f"""
WITH {_BATCH}, {EMBEDDINGS}, e AS (SELECT parsed_document_id, id % 3 AS i, embedding FROM emb),
z AS (SELECT coalesce(b.parsed_document_id, e.parsed_document_id) AS p, b.sequence_index IS NULL OR e.embedding IS NULL AS bad FROM b FULL OUTER JOIN e ON b.parsed_document_id = e.parsed_document_id AND b.i = e.i)
SELECT p AS parsed_document_id, count(*) AS n, CASE WHEN bool_or(bad) THEN 'invalid_response' END AS error_code FROM z GROUP BY 1"""
SQL["embed_retry_rules"] = """
WITH e AS (SELECT event_id, [200, 400, 429, 500, 503, 599, 600][event_id % 7 + 1] AS s, event_id % 4 AS a FROM events)
SELECT event_id, (event_id % 5 IN (0, 1) OR s = 429 OR s BETWEEN 500 AND 599) AND a < 3 AS again,
  CASE WHEN event_id % 3 = 0 THEN greatest(0.5, least(60.0, CAST(event_id AS DOUBLE))) ELSE 0.5 * least(pow(2.0, a), 60.0) END AS delay FROM e"""

# uploads

SQL["upload_manifest"] = f"""
WITH {UPLOADS} SELECT id, owner_user_id, original_filename, byte_size, checksum_sha256, {safe_extension('original_filename')} AS extension, {fmt('original_filename', 'content_type')} AS format,
  'uploads/' || owner_user_id || '/' || id || '/original' || {safe_extension('original_filename')} AS storage_key, {size_label('byte_size')} AS size_label, {iso('created_at')} AS created FROM uploads"""
SQL["upload_rejections"] = f"""
WITH {UPLOADS} SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN status <> 'stored' THEN 'not_stored' WHEN byte_size = 0 THEN 'empty_file' WHEN byte_size > 20000 THEN 'too_large'
  WHEN NOT (coalesce(content_type, '') = '' OR content_type IN ({listed(ALLOWED_TYPES)}) OR (content_type = {q(t.LEGACY_PPT)} AND {safe_extension('original_filename')} = '.pptx')) THEN 'content_type'
  WHEN {fmt('original_filename', 'content_type')} IS NULL OR NOT (coalesce(content_type IN ({listed(ALLOWED_TYPES)}), false) OR {extension('original_filename')} IN ({listed(ALLOWED_EXTENSIONS)})) THEN 'format'
  ELSE 'admitted' END AS reason FROM uploads"""
SQL["upload_names"] = f"""
WITH n AS (SELECT doc_id AS id, {pick(["", "a/", "d.x/"], f'(doc_id // {len(NAMES)})')} || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || {pick(NAMES, 'doc_id')} AS name FROM documents)
SELECT id, {extension('name')} AS ext, {safe_extension('name')} AS safe, upper(substr({strip("coalesce(name, '')")}, 1, 2)) AS initials FROM n"""
_KEYS = ["", ".", "..", "a/../b", "a//b", "./a", "/a", "a/..b", None, "uploads/u/1/original.txt"]
SQL["storage_key_guard"] = f"""
WITH {UPLOADS}, k AS (SELECT id, 'uploads/' || owner_user_id || '/' || id || '/original' || {safe_extension('original_filename')} AS key FROM uploads
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-i - 1}, {q(x)})" for i, x in enumerate(_KEYS))}) v(id, key)),
p AS (SELECT *, list_filter(string_split(key, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM k)
SELECT id, coalesce(len(parts) > 0 AND NOT list_contains(parts, '..') AND NOT starts_with(key, '/'), false) AS is_safe FROM p"""
SQL["parse_documents"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 40 = 0 THEN 'parse_failed' END AS error_code, 1 AS n_segments, sha256(CASE WHEN doc_id % 40 = 0 THEN ' ' || chr(10) ELSE text END) AS sha256 FROM documents"""
SQL["file_sniffing"] = """
SELECT CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN CASE WHEN strlen(text) < 8192 THEN 'binary' ELSE 'text' END ELSE 'text' END AS kind, count(*) AS n FROM documents GROUP BY 1"""

# jobs

_NEW = "row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, id DESC)"
_ACTIVE = f"{JOBS}, act AS (SELECT * FROM jobs WHERE status = 'succeeded' QUALIFY {_NEW} = 1)"
SQL["jobs_latest"] = f"WITH {JOBS} SELECT parent_id, id, status, {iso('created_at')} AS created FROM jobs QUALIFY {_NEW} = 1"
SQL["jobs_active"] = f"WITH {_ACTIVE} SELECT parent_id, id, declared_count FROM act"
SQL["jobs_supersede"] = f"WITH {_ACTIVE} SELECT id, parent_id, CASE WHEN status = 'succeeded' AND id NOT IN (SELECT id FROM act) THEN 'superseded' ELSE status END AS status FROM jobs"
SQL["jobs_supersede_siblings"] = f"WITH {JOBS} SELECT parent_id, CASE WHEN parent_id = 7 AND id <> 100 AND status = 'succeeded' THEN 'superseded' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1, 2"
_OPEN = f"status IN ({listed(jobs.OPEN)})"
SQL["jobs_reconcile"] = f"""
WITH {JOBS} SELECT id, CASE WHEN {_OPEN} THEN 'failed' ELSE status END AS status, CASE WHEN {_OPEN} THEN 'process_shutdown' END AS error_code, CASE WHEN {_OPEN} THEN 'restarted' END AS error_message FROM jobs"""
SQL["jobs_reconcile_counts"] = f"WITH {JOBS} SELECT {pick(['parse', 'chunk', 'embedding'], 'id')} AS kind, count(*) FILTER ({_OPEN}) AS n_changed, count(*) AS n_jobs FROM jobs GROUP BY 1"
_SHARED = f"{JOBS}, own AS (SELECT parent_id * 64 + id % 64 AS parent_id, bool_or({_OPEN}) AS busy FROM jobs GROUP BY 1)"
SQL["jobs_conflicts"] = f"WITH {_SHARED} SELECT parent_id FROM own WHERE busy"
SQL["jobs_admissible"] = f"WITH {_SHARED} SELECT parent_id FROM own WHERE NOT busy"
SQL["jobs_fold"] = f"""
WITH {JOBS}, f AS (
  SELECT parent_id, arg_max(status, (created_at, id)) AS status, count(*) FILTER (status = 'running') AS attempt_count, min(created_at) FILTER (status = 'running') AS s,
         max(created_at) FILTER (status IN ('succeeded', 'failed')) AS e, arg_max(declared_count, (created_at, id)) FILTER (status = 'succeeded') AS count FROM jobs GROUP BY 1)
SELECT parent_id, status, attempt_count, {iso('s')} AS started, {iso('e')} AS finished, count FROM f"""
SQL["jobs_status_report"] = f"WITH {JOBS}, s AS (SELECT status, count(*) AS n_jobs, max(created_at) AS m FROM jobs GROUP BY 1) SELECT status, n_jobs, {iso('m')} AS newest FROM s"
SQL["jobs_declared_counts"] = f"""
WITH {_ACTIVE}, s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT parent_id, id, declared_count, coalesce(n, 0) AS stored_count, declared_count = coalesce(n, 0) AS equal FROM act LEFT JOIN s ON parent_id = user_id"""
SQL["jobs_stale"] = f"""
WITH {JOBS}, c AS (SELECT * FROM jobs WHERE status = 'succeeded' AND id % 2 = 0 QUALIFY {_NEW} = 1), e AS (SELECT * FROM jobs WHERE status = 'succeeded' AND id % 2 = 1 QUALIFY {_NEW} = 1)
SELECT c.parent_id, c.id AS chunk_job, e.id AS embedding_job FROM c LEFT JOIN e ON c.parent_id = e.parent_id WHERE e.id IS NULL OR e.created_at < c.created_at"""
SQL["jobs_history"] = f"WITH {JOBS} SELECT parent_id, CAST({_NEW} AS INTEGER) AS age, id, status FROM jobs QUALIFY {_NEW} <= 3"
SQL["jobs_create"] = """SELECT DISTINCT user_id AS parent_id, 'queued' AS status, '{"max_tokens": 512}' AS config_json, 0 AS count, 0 AS attempt_count FROM events"""

# catalogue

SQL["documents_list"] = f"""
WITH {SEGMENTS}, n AS (SELECT parsed_document_id, count(*) AS n FROM segments GROUP BY 1)
SELECT doc_id AS id, source AS owner_user_id, substr(text, 1, 20) AS title, coalesce(n, 0) AS n_segments, {iso(CREATED)} AS created FROM documents LEFT JOIN n ON doc_id = parsed_document_id"""
SQL["documents_page"] = f"""
WITH {SEGMENTS}, p AS (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40)
SELECT doc_id AS id, substr(any_value(p.text), 1, 20) AS title, count(parsed_document_id) AS n_segments FROM p LEFT JOIN segments ON doc_id = parsed_document_id GROUP BY 1"""
SQL["chunks_page"] = f"WITH {CHUNKS} SELECT id, sequence_index, CAST(token_count AS INTEGER) AS token_count FROM chunks WHERE parsed_document_id = 4 ORDER BY sequence_index LIMIT 200"
SQL["uploads_live"] = f"WITH {UPLOADS} SELECT owner_user_id, count(*) AS n, CAST(sum(byte_size) AS BIGINT) AS bytes FROM uploads WHERE deleted_at IS NULL AND status = 'stored' GROUP BY 1"
SQL["upload_lookup"] = f"WITH {UPLOADS} SELECT id, owner_user_id, original_filename FROM uploads WHERE id = 5 AND owner_user_id = 'src5'"
SQL["documents_with_file"] = "SELECT doc_id AS id, doc_id AS uploaded_file_id FROM documents WHERE doc_id % 3 = 0"
SQL["documents_with_jobs"] = f"""
WITH {JOBS}, d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS parse_job_id FROM documents)
SELECT d.id, parse_job_id, coalesce(status, 'missing') AS job_status FROM d LEFT JOIN jobs ON jobs.id = parse_job_id"""
SQL["active_embeddings"] = f"WITH {_ACTIVE}, {EMBEDDINGS} SELECT emb.id, parsed_document_id, act.id AS job_id, model FROM emb JOIN act ON parent_id = parsed_document_id"

# conversations

_FOLD = """f AS (
  SELECT conv_id, arg_min(text, (turn, role, text)) FILTER (role = 'user') AS first_question, arg_max(text, (turn, role, text)) FILTER (role = 'assistant' AND text <> '') AS last_answer,
         count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1)"""
_TITLES = f"{_FOLD}, ti AS (SELECT conv_id, {title("coalesce(first_question, '')")} AS made FROM f), titles AS (SELECT conv_id, CASE WHEN made = '' THEN 'Conversation ' || conv_id ELSE made END AS title FROM ti)"
SQL["conversation_titles"] = f"WITH {_TITLES} SELECT conv_id, title FROM titles"
SQL["title_prefixes"] = f"""
WITH m AS (SELECT conv_id, turn, {pick(OPENINGS, '(conv_id + turn)')} || CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS m FROM conversations) SELECT conv_id, turn, {title('m')} AS title FROM m"""
SQL["conversation_fold"] = f"WITH {_FOLD} SELECT conv_id, sha256(coalesce(first_question, '')) AS first_sha, sha256(coalesce(last_answer, '')) AS last_sha, n_messages, n_chars FROM f"
SQL["conversation_history"] = f"WITH {_TITLES} SELECT conv_id, title FROM titles WHERE conv_id <> 5 ORDER BY conv_id DESC"
SQL["conversation_state"] = """
WITH c AS (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1)
SELECT id, CAST(CASE WHEN id % 10 IN (3, 4) OR id = 2 THEN 0 ELSE 1 END AS INTEGER) AS n, CASE WHEN id % 10 IN (3, 4) OR id = 2 THEN '' WHEN id = 1 THEN 'new' ELSE 'old' END AS titles,
  CASE WHEN id % 10 NOT IN (3, 4) AND id <> 2 THEN CAST(id AS VARCHAR) END AS active, CAST(CASE WHEN id % 10 IN (3, 4) OR id = 2 THEN 0 ELSE n END AS INTEGER) AS n_messages FROM c"""
SQL["answer_states"] = """
SELECT role, count(*) FILTER (turn % 3 = 1 AND (role <> 'assistant' OR text = '')) AS n_degraded, count(*) AS n FROM conversations GROUP BY 1"""
SQL["prompt_char_totals"] = """
SELECT conv_id, CAST(sum(CASE WHEN turn % 5 = 0 THEN length(text) WHEN turn % 2 = 0 THEN length(text) + 2 ELSE 4 END) AS BIGINT) AS n_chars FROM conversations GROUP BY 1"""

# logs

_ADMITTED = "level <> 'debug'"
_FLUSH = f"""{LOGS}, o AS (SELECT *, (row_number() OVER (ORDER BY ts, id) - 1) // 100 AS batch FROM logs WHERE {_ADMITTED}),
b AS (SELECT batch, count(*) AS n_records, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS c, min(id) AS first_id FROM o GROUP BY 1)"""
SQL["log_level_filter"] = f"WITH {LOGS} SELECT level, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM logs WHERE {_ADMITTED} GROUP BY 1"
SQL["log_ring_last_n"] = f"WITH {LOGS} SELECT id, level, message FROM logs WHERE {_ADMITTED} ORDER BY ts DESC, id DESC LIMIT 500"
SQL["log_flush_batches"] = f"WITH {_FLUSH} SELECT batch, n_records, bytes, {iso('c')} AS created, first_id FROM b"
SQL["log_retention"] = f"""
WITH {_FLUSH}, s AS (SELECT batch, bytes, CAST(sum(bytes) OVER (ORDER BY c DESC, batch DESC) AS BIGINT) AS suffix_bytes FROM b) SELECT batch, bytes, suffix_bytes FROM s WHERE suffix_bytes <= 60000"""
SQL["log_lines"] = f"""
WITH {LOGS} SELECT id, strftime(ts, '%H:%M:%S.%g') || ' ' || {mapped('level', logs.SHORT)} || ' [' || substr(trace_id, 1, 6) || '] ' || module || ' — ' || message AS line FROM logs"""
SQL["log_read_order"] = f"WITH {LOGS} SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS number FROM logs"
SQL["log_stream_counts"] = f"""
WITH {LOGS}, h AS (SELECT date_trunc('hour', ts) AS s, level, count(*) AS n_records, CAST(sum(bytes) AS BIGINT) AS bytes FROM logs GROUP BY 1, 2) SELECT {iso('s')} AS start, level, n_records, bytes FROM h"""

# pages and scalars

SQL["parse_html_pages"] = f"""
WITH p AS (SELECT page_id, string_split_regex(coalesce(html, ''), {q(ingest.PARAGRAPH)}) AS s FROM pages),
x AS (SELECT page_id, CAST(generate_subscripts(s, 1) - 2 AS INTEGER) AS sequence_index, unnest(s) AS part FROM p),
y AS (SELECT page_id, sequence_index, regexp_replace(regexp_replace(part, {q(ingest.PARAGRAPH_END)}, ''), '<[^>]*>', '', 'g') AS text FROM x WHERE sequence_index >= 0)
SELECT page_id, sequence_index, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n_chars FROM y"""
SQL["scalar_labels"] = f"""
WITH {UPLOADS} SELECT id, {size_label('(byte_size * (id + 1) * 37)')} AS size, CASE WHEN id * 7 < 1000 THEN (id * 7) || ' ms' ELSE printf('%.1f', round(id * 7 / 1000.0, 1)) || ' s' END AS took,
  month(created_at) || '月' || day(created_at) || '日 ' || strftime(created_at, '%H:%M') AS stamp, 'a|' || owner_user_id || '|b' AS csv, 'db://user:***@host/x' AS url, substr(checksum_sha256, 1, 18) || '…' AS short FROM uploads"""
SQL["duplicate_places"] = f"WITH {SEGMENTS} SELECT parsed_document_id, CAST(sequence_index % 7 AS INTEGER) AS sequence_index, count(*) AS n FROM segments GROUP BY 1, 2 HAVING count(*) > 1"

# answers, readiness, schema and whole flows

SQL["chat_responses"] = """
SELECT conv_id * 1000 + turn AS id, CAST(CASE WHEN turn % 5 = 0 OR turn = 7 OR turn % 2 = 1 THEN 0 ELSE length(text) END AS INTEGER) AS n_chars, CASE WHEN turn % 3 > 0 AND turn <> 7 THEN 'm-1' ELSE '' END AS model,
  CAST(CASE WHEN turn % 4 > 0 AND turn <> 7 THEN turn ELSE 0 END AS INTEGER) AS prompt_tokens, 0 AS total_tokens, CASE WHEN turn = 7 THEN 'not_json' WHEN turn % 5 = 0 THEN 'no_choices' END AS error_code FROM conversations"""
_STATES = ["ready", "skipped", "loading", "unavailable", "shutting_down", "odd"]
SQL["readiness_states"] = f"""
WITH e AS (SELECT event_id AS id, {pick(_STATES, 'event_id')} AS a, {pick(_STATES, '(event_id // 6)')} AS b FROM events),
s AS (SELECT *, CASE WHEN id % 72 >= 36 OR 'shutting_down' IN (a, b) THEN 'shutting_down' WHEN 'unavailable' IN (a, b) THEN 'unavailable' WHEN 'loading' IN (a, b) THEN 'loading'
  WHEN a = 'skipped' AND b = 'skipped' THEN 'skipped' WHEN a IN ('ready', 'skipped') AND b IN ('ready', 'skipped') THEN 'ready' ELSE 'unavailable' END AS status FROM e),
g AS (SELECT *, CASE WHEN status IN ('ready', 'skipped') THEN NULL WHEN status = 'loading' THEN 'loading' ELSE 'unavailable' END AS gate FROM s)
SELECT id, status, gate, CASE WHEN id % 2 = 1 THEN gate END AS admission FROM g"""
SQL["schema_faults"] = f"""
WITH {UPLOADS} SELECT id, concat_ws(',', CASE WHEN id % 50 = 0 THEN 'original_filename' END, CASE WHEN status = 'stored' THEN 'status' END) AS faults FROM uploads"""
SQL["ids_by_time"] = f"""
WITH {UPLOADS}, h AS (SELECT id, lpad(lower(to_hex(epoch_ms(created_at))), 12, '0') AS m FROM uploads) SELECT id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-7' AS head, 36 AS n, true AS variant FROM h"""
SQL["artifact_keys"] = """
SELECT 'parsed/' || source || '/' || doc_id || '/j/' || n AS storage_key, CAST(CASE WHEN n = 'document.json' THEN length(CAST(json_object('content', text) AS VARCHAR)) ELSE length(text) END AS INTEGER) AS n_chars
FROM documents, (VALUES ('content.md'), ('content.txt'), ('document.json')) v(n)"""
SQL["offloaded_files"] = f"""
WITH {CHUNKS}, {STORED} SELECT text_storage_key AS storage_key, text_bytes AS n_bytes FROM stored WHERE text_storage_key IS NOT NULL
UNION ALL SELECT s.contextualized_text_storage_key, strlen(c.contextualized_text) FROM stored s JOIN chunks c USING (id) WHERE s.contextualized_text_storage_key IS NOT NULL"""
_N = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
SQL["rechunk_all"] = f"""
WITH d AS (SELECT doc_id AS p, {_N} AS n FROM documents)
SELECT 'j1/' || p AS id, p AS parent_id, CASE WHEN n = 0 THEN 'failed' WHEN p % 9 = 0 THEN 'succeeded' ELSE 'superseded' END AS status, (n + 63) // 64 AS declared_count, CASE WHEN n = 0 THEN 'chunking_failed' END AS error_code FROM d
UNION ALL SELECT 'j2/' || p, p, CASE WHEN p % 9 = 0 OR n = 0 THEN 'failed' ELSE 'succeeded' END, CASE WHEN p % 9 = 0 THEN 0 ELSE (n + 31) // 32 END, CASE WHEN p % 9 = 0 OR n = 0 THEN 'chunking_failed' END FROM d"""
SQL["reembed_all"] = f"""
WITH {CHUNKS} SELECT parsed_document_id, 'hash-32' AS model, 32 AS dimensions, count(*) AS n, 0 AS n_wrong FROM chunks GROUP BY 1"""
SQL["runnable_jobs"] = f"WITH {JOBS}, n AS (SELECT * FROM jobs QUALIFY {_NEW} = 1) SELECT parent_id, id FROM n WHERE status = 'queued'"
SQL["fail_one_job"] = f"""
WITH {JOBS}, f AS (SELECT id = 8 AND {_OPEN} AS hit, status FROM jobs)
SELECT CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'process_shutdown' END AS error_code, count(*) AS n FROM f GROUP BY 1, 2"""

# files, structure, settings and responses

SQL["chunk_sections"] = r"""
WITH l AS (
  SELECT doc_id AS p, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
m AS (SELECT p, i, i // 8 AS seg, CASE WHEN i % 5 = 0 THEN repeat('#', 1 + (i // 5) % 3) || ' H' || (i // 5) ELSE raw END AS t FROM l),
h AS (SELECT *, length(regexp_extract(t, '^(#{1,6})\s+(.*\S)\s*$', 1)) AS level, regexp_extract(t, '^(#{1,6})\s+(.*\S)\s*$', 2) AS title FROM m),
a AS (
  SELECT *, last_value(CASE WHEN level = 1 THEN title WHEN level BETWEEN 1 AND 0 THEN '' END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN title WHEN level BETWEEN 1 AND 1 THEN '' END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level = 3 THEN title WHEN level BETWEEN 1 AND 2 THEN '' END IGNORE NULLS) OVER w AS h3, last_value(CASE WHEN level = 4 THEN title WHEN level BETWEEN 1 AND 3 THEN '' END IGNORE NULLS) OVER w AS h4, last_value(CASE WHEN level = 5 THEN title WHEN level BETWEEN 1 AND 4 THEN '' END IGNORE NULLS) OVER w AS h5, last_value(CASE WHEN level = 6 THEN title WHEN level BETWEEN 1 AND 5 THEN '' END IGNORE NULLS) OVER w AS h6
  FROM h WINDOW w AS (PARTITION BY p ORDER BY i)),
b AS (
  SELECT p, i, seg, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS ws, list_filter([h1, h2, h3, h4, h5, h6], lambda x: x IS NOT NULL AND x <> '') AS path FROM a WHERE level = 0),
c AS (SELECT *, coalesce(path <> lag(path) OVER (PARTITION BY p ORDER BY i), true) AS fresh FROM b WHERE len(ws) > 0),
s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY i) AS sec FROM c),
k AS (SELECT p, sec, i, seg, path, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM s),
o AS (SELECT *, (row_number() OVER (PARTITION BY p, sec ORDER BY i, j) - 1) // 24 AS part FROM k),
g AS (
  SELECT p, sec, part, count(*) AS token_count, any_value(path) AS path, string_agg(word, ' ' ORDER BY i, j) AS text,
         array_to_string(list_sort(list_distinct(list(seg + 1))), ',') AS page_numbers, array_to_string(list_sort(list_distinct(list(seg))), ',') AS source_segment_indices FROM o GROUP BY p, sec, part)
SELECT p AS parsed_document_id, CAST(row_number() OVER (PARTITION BY p ORDER BY sec, part) - 1 AS INTEGER) AS sequence_index, CAST(token_count AS INTEGER) AS token_count, array_to_string(path, ' > ') AS heading_path,
       page_numbers, source_segment_indices, sha256(array_to_string(path, chr(10)) || chr(10) || text) AS sha256 FROM g"""
_GONE = {
    verify.CHECKS[3]: f"cid IS NOT NULL AND ({SOURCE('text')} = 'unavailable' OR ({SOURCE('text')} = 'file' AND cid % 3 = 0))",
    verify.CHECKS[4]: f"cid IS NOT NULL AND (contextualized_text IS NOT NULL OR contextualized_text_storage_key IS NOT NULL) AND ({SOURCE('contextualized_text')} = 'unavailable' OR ({SOURCE('contextualized_text')} = 'file' AND cid % 3 = 0))",
}
_CHECKED_FILES = CHECKED
for _name, _rule in _GONE.items():
    _CHECKED_FILES = _CHECKED_FILES.replace(f"{q(_name)} AS c, list_sort(coalesce(list(sequence_index) FILTER ({BAD[_name]}), []))", f"{q(_name)} AS c, list_sort(coalesce(list(sequence_index) FILTER ({_rule}), []))")
assert _CHECKED_FILES.count("cid % 3 = 0") == 2
SQL["verify_checks_with_files"] = f"""
WITH {_CHECKED_FILES} SELECT parsed_document_id, c AS "check", len(o) = 0 AND m AS passed, len(o) AS n_offenders,
  array_to_string(o[1:5], ', ') || CASE WHEN len(o) > 5 THEN '...' ELSE '' END AS offenders FROM found"""
_PLACE = "CASE c " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(verify.CHECKS)) + " END"
SQL["verify_report"] = f"""
WITH {CHECKED}, {UPLOADS}, {_ACTIVE},
v AS (SELECT parsed_document_id, bool_and(len(o) = 0 AND m) AS passed, count(*) AS total_checks, count(*) FILTER (len(o) = 0 AND m) AS passed_checks, string_agg(c || '=' || (len(o) = 0 AND m), ';' ORDER BY {_PLACE}) AS checks FROM found GROUP BY 1),
r AS (SELECT parsed_document_id, CAST(count(*) AS INTEGER) AS n_pairs, array_to_string(list(sequence_index ORDER BY sequence_index)[1:5], ',') AS first_places, CAST(sum(coalesce(ctok, 0)) AS BIGINT) AS chunk_tokens, CAST(sum(coalesce(etok, 0)) AS BIGINT) AS embedding_tokens FROM pairs GROUP BY 1)
SELECT v.parsed_document_id, substr(d.text, 1, 20) AS title, u.original_filename, u.byte_size, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS parse_job, 'job-1' AS chunk_job, act.id AS embedding_job,
       passed, total_checks, passed_checks, checks, n_pairs, first_places, chunk_tokens, embedding_tokens
FROM v JOIN r USING (parsed_document_id) JOIN documents d ON doc_id = v.parsed_document_id JOIN uploads u ON u.id = doc_id LEFT JOIN act ON act.parent_id = doc_id"""
SQL["search_response"] = f"""
WITH {HITS}
SELECT 'What is said?' AS query, (SELECT array_to_string(list_transform(v[1:5], lambda x: printf('%.5f', x)), ',') FROM qv) AS preview, 'model-a' AS embedding_model, 64 AS embedding_dimensions, 20 AS top_k,
       (SELECT count(*) FROM emb) AS total_searched, (SELECT count(DISTINCT parsed_document_id) FROM emb) AS searched_document_count, coalesce(string_agg(rank || ':' || chunk_id, ',' ORDER BY rank), '') AS results FROM hits"""
SQL["chunks_page_total"] = f"""
WITH {CHUNKS} SELECT id, sequence_index, total FROM (SELECT *, count(*) OVER () AS total FROM chunks WHERE parsed_document_id = 4) ORDER BY sequence_index LIMIT 2 OFFSET 1"""
SQL["chunk_read_rows"] = f"WITH {CHUNKS}, {STORED} SELECT id, {SOURCE('text')} AS text_source, CAST(length(text) AS INTEGER) AS n_chars, false AS shows_keys FROM stored"
SQL["document_read_rows"] = f"WITH {UPLOADS} SELECT id, substr(text, 1, 20) AS title, original_filename, byte_size, status, false AS shows_text FROM uploads JOIN documents ON doc_id = id"
SQL["embedding_read_rows"] = f"WITH {EMBEDDINGS} SELECT id, parsed_document_id, sequence_index, chunk_id, model, dimensions, token_count FROM emb"
SQL["embed_dual"] = "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, true AS same FROM embeddings"
SQL["reembed_supersedes"] = f"""
WITH {CHUNKS}, n AS (SELECT parsed_document_id AS p, count(*) AS n FROM chunks GROUP BY 1)
SELECT 'e1/' || p AS id, p AS parent_id, CASE WHEN p % 7 = 0 THEN 'succeeded' ELSE 'superseded' END AS status, NULL AS error_code, n AS declared_count FROM n
UNION ALL SELECT 'e2/' || p, p, CASE WHEN p % 7 = 0 THEN 'failed' ELSE 'succeeded' END, CASE WHEN p % 7 = 0 THEN 'invalid_response' END, CASE WHEN p % 7 = 0 THEN n - 1 ELSE n END FROM n"""
SQL["chunk_jobs_with_embedding"] = f"""
WITH {JOBS}, e AS (SELECT id, id // 6 * 2 AS c FROM jobs WHERE id % 2 = 1 AND status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY id // 6 * 2 ORDER BY created_at DESC, id DESC) = 1)
SELECT j.id, j.status, e.id AS child_id FROM jobs j LEFT JOIN e ON e.c = j.id WHERE j.id % 2 = 0"""
SQL["job_self_distance"] = f"""
WITH {EMBEDDINGS}, f AS (SELECT model, arg_min(embedding, id) AS sample FROM emb GROUP BY 1),
s AS (SELECT emb.model, id, list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(sample AS DOUBLE[])) AS score FROM emb JOIN f USING (model))
SELECT model, CAST(row_number() OVER w AS INTEGER) AS rank, id, {ROUND} AS score FROM s WINDOW w AS (PARTITION BY model ORDER BY score, id) QUALIFY row_number() OVER w <= 3"""
SQL["answer_rows"] = f"""
WITH s AS (
  SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'no_data' WHEN turn % 4 = 0 THEN 'no_match' WHEN conv_id % 3 = 0 THEN 'disabled' WHEN conv_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM conversations)
SELECT conv_id, turn, status, sha256(CASE status WHEN 'no_data' THEN {q(chat.NO_DATA)} WHEN 'no_match' THEN {q(chat.NO_MATCH)} WHEN 'disabled' THEN {q(chat.DISABLED)} WHEN 'failed' THEN {q(chat.FAILED)} ELSE coalesce(text, '') END) AS sha256,
       CASE WHEN status = 'ok' THEN 'm-1' END AS model, CASE status WHEN 'failed' THEN 'down' WHEN 'disabled' THEN 'Chat generation is disabled' END AS error FROM s"""
SQL["request_faults"] = """
SELECT conv_id, turn, CASE WHEN turn % 6 = 5 OR text IS NULL OR length(text) NOT BETWEEN 1 AND 2000 THEN 'query' WHEN conv_id % 60 NOT BETWEEN 1 AND 50 THEN 'k' WHEN turn - 1 < 1 THEN 'max_tokens' END AS fault FROM conversations"""
SQL["missing_models"] = """
WITH e AS (SELECT event_id AS id, array_to_string(list_filter([CASE WHEN event_id % 2 <> 0 THEN 'layout' END, CASE WHEN event_id % 4 >= 2 THEN 'tables' END], lambda x: x IS NOT NULL), ',') AS missing FROM events)
SELECT id, missing, CASE WHEN id % 32 >= 24 THEN 'Document models are still loading' WHEN missing <> '' THEN 'Document models are unavailable: ' || replace(missing, ',', ', ') END AS message FROM e"""
SQL["error_rows"] = """
SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'Unknown error' END AS message, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 200 + 400 AS INTEGER) END AS status_code FROM events"""
_LABELLED = [(n, labels.CHECK.get(n, n), "check") for n in (*verify.CHECKS, "other")] + [(n, labels.SOURCE.get(n, labels.SOURCE_UNKNOWN), "source") for n in ("inline", "file", "unavailable")]
SQL["label_rows"] = f"""
WITH {JOBS}
SELECT status AS name, {mapped('status', labels.STATUS)} AS label, CASE WHEN status = 'succeeded' THEN 'good' WHEN status = 'failed' THEN 'bad' WHEN {_OPEN} THEN 'open' ELSE 'neutral' END AS colour, count(*) AS n FROM jobs GROUP BY 1
UNION ALL SELECT role, coalesce({mapped('role', labels.ROLE)}, role), 'role', count(*) FROM conversations GROUP BY 1
UNION ALL SELECT *, 1 FROM (VALUES {", ".join(f"({listed(x)})" for x in _LABELLED)}) v(name, label, colour)"""
_KEPT = [(n, default) for n, (_, default) in settings.CHUNK.items()]
SQL["config_snapshots"] = f"""
WITH o AS (
  SELECT user_id AS job_id, {pick(OVERRIDDEN, 'event_id')} AS name, CASE WHEN event_id % 4 = 0 THEN {pick(ODD_VALUES, '(event_id // 4)')} ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, ts, event_id FROM events),
n AS (SELECT job_id, {', '.join(f"arg_max([value], (ts, event_id)) FILTER (name = '{n}')[1] AS g_{n}" for n, _ in _KEPT)} FROM o GROUP BY 1),
v AS (SELECT *, {', '.join(f"CASE WHEN regexp_matches(g_{n}, '^\\s*[+-]?[0-9]{{1,9}}\\s*$') THEN CAST(trim(g_{n}) AS INTEGER) END AS v_{n}" for n, _ in _KEPT)} FROM n)
SELECT job_id, {', '.join(f"coalesce(v_{n}, {d}) AS {n}" for n, d in _KEPT)},
       array_to_string(list_filter([{', '.join(f"CASE WHEN g_{n} IS NOT NULL AND v_{n} IS NULL THEN '{n}' END" for n, _ in _KEPT)}], lambda x: x IS NOT NULL), ',') AS rejected FROM v"""
SQL["uploads_written"] = f"WITH {UPLOADS} SELECT id, status, original_filename, byte_size, checksum_sha256 FROM uploads"
SQL["parsed_written"] = "SELECT doc_id AS uploaded_file_id, 0 AS sequence_index, 'document' AS segment_type, CAST(NULL AS INTEGER) AS page_no, sha256(text) AS sha256 FROM documents"
SQL["files_written"] = """
SELECT 'parsed/u/' || doc_id || '/j/content.txt' AS storage_key, strlen(coalesce(text, '')) AS byte_size, strlen(coalesce(text, '')) > 20000 AS too_large, CASE WHEN strlen(coalesce(text, '')) <= 20000 THEN sha256(coalesce(text, '')) END AS checksum_sha256,
       CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars FROM documents"""
SQL["artifacts_exported"] = """
WITH f AS (SELECT 'parsed/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '.txt' AS storage_key, count(*) || ' é ' || CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS t FROM documents GROUP BY source, lang)
SELECT storage_key, strlen(t) AS byte_size, strlen(t) > 9 AS too_large, CASE WHEN strlen(t) <= 9 THEN sha256(t) END AS checksum_sha256, CAST(length(t) AS INTEGER) AS n_chars FROM f"""
SQL["active_users"] = "SELECT c_custkey AS id, c_name AS display_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0"
SQL["default_user"] = f"""
WITH u AS (SELECT {q(schema.DEFAULT_USER)} AS id, c_name AS display_name FROM customer WHERE c_custkey = 1 UNION ALL SELECT {q(schema.DEFAULT_USER)}, 'Default user')
SELECT id, display_name, 'active' AS status, '2024-01-01T00:00:00Z' AS created, (SELECT count(*) + 1 FROM customer WHERE c_custkey % 3 <> 0) AS n_acting FROM u"""
_GAPS = [("uploaded_files", c, "missing") for c in ("storage_key", "error_message", "updated_at")] + [("document_segments", c, "missing") for c in ("id", "owner_user_id", "segment_type", "page_no", "heading_path", "metadata")]
SQL["schema_gaps"] = f"""SELECT * FROM (VALUES {', '.join(f'({listed(x)})' for x in _GAPS)}) v("table", "column", gap)"""
SQL["conversation_edits"] = "SELECT DISTINCT conv_id AS id, 'n/new/x=because,y=?;o/old/' AS talks, 'o' AS active FROM conversations"
