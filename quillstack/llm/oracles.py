"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from quillstack.llm import secret_links as sl
from quillstack.llm import shard_split as sh
from quillstack.llm import source_mix as mix
from quillstack.llm.chat_prefix import CONTROL, END, ESCAPE, START

SQL: dict[str, str] = {}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chat() -> str:
    added = " + ".join(f"(length(t) - length(replace(t, {quote(c)}, ''))) // {len(c)}" for c in (*CONTROL, ESCAPE))
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
sized AS (
  SELECT *, {len(START) + 1 + len(END)} + length(role) + length(t) + 2 * ({added}) AS size,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t)),
prefixes AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM prefixes GROUP BY conv_id"""


SQL["op1_chat_prefix_targets"] = _chat()

SQL["op5_pivot_distance_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""

SQL["op6_warc_sequential"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(digest, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT)) AS five FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(five, lambda x: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b"""

SQL["op10_sampled_splitters"] = f"""
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
b AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(strlen(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM b, tbl),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(md5(text), '') AS g, crc FROM c),
t AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY g) AS bytes FROM d),
k AS (SELECT *, g || CASE WHEN bytes * {8 * sh.PER_SHARD} > total THEN md5(coalesce(CAST(doc_id AS VARCHAR), '')) ELSE '' END AS key FROM t),
z AS (SELECT CAST(pow(2, ceil(log2(greatest({8 * sh.PER_SHARD}, least({sh.MOST}, ceil(max(total) / {sh.RANGE_BYTES}.0)))))) AS BIGINT) AS n FROM k),
w AS (SELECT key, size * (n * {sh.DRAWS} / total) AS chance, n * {sh.DRAWS} AS most, CAST('0x' || substr(md5(key || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM k, z),
y AS (SELECT list(key ORDER BY key) AS keys FROM (SELECT key, unnest(range(CAST(least(ceil(chance), most) AS BIGINT))) FROM w WHERE draw < chance)),
c2 AS (SELECT list_transform(range(1, n), lambda i: keys[CAST(i * len(keys) // n AS BIGINT) + 1]) AS bounds, n FROM y, z),
r AS (SELECT k.*, n, len(list_filter(bounds, lambda x: x <= key)) AS rng FROM k, c2),
o AS (
  SELECT *, sum(size) OVER v AS held, CASE WHEN substr(min(key) OVER v, 1, 32) = substr(max(key) OVER v, 1, 32) THEN 33 ELSE 1 END AS skip, min(key) OVER v AS low, max(key) OVER v AS high
  FROM r WINDOW v AS (PARTITION BY rng)),
x AS (
  SELECT *, CASE WHEN held * n > 2 * total THEN CAST(floor(
    ((CAST('0x' || substr(key, skip, 13) AS BIGINT) - CAST('0x' || substr(low, skip, 13) AS BIGINT))::DOUBLE
      / (CAST('0x' || substr(high, skip, 13) AS BIGINT) - CAST('0x' || substr(low, skip, 13) AS BIGINT) + 1)::DOUBLE)
    * ceil(held * n / total::DOUBLE)) AS BIGINT) ELSE 0 END AS part FROM o),
e AS (SELECT rng, part, sum(size) AS bytes FROM x GROUP BY rng, part),
f AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY rng, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e),
s AS (SELECT x.*, CAST((2 * ahead + f.bytes) * 8 // (2 * total) AS INTEGER) AS shard FROM x JOIN f USING (rng, part))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY rng, part, key, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""


def _secrets() -> str:
    def kind(i: int, pattern: str, keep: str = "true") -> str:
        p = quote(pattern)
        return f"""
SELECT rid, {i} AS kind, CAST(upto - length(m) AS INTEGER) AS s, CAST(upto AS INTEGER) AS e FROM (
  SELECT rid, m, k, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS upto FROM (
    SELECT rid, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(string_split_regex(t, {p})) AS g, generate_subscripts(string_split_regex(t, {p}), 1) AS k
    FROM d WHERE regexp_matches(t, {p})) WHERE m IS NOT NULL)
WHERE m IS NOT NULL AND ({keep})"""

    has = lambda *c: " AND ".join(f"regexp_matches(m, '[{x}]')" for x in c)
    base = " UNION ALL ".join([
        kind(0, sl.ASSIGN, f"length(regexp_extract(m, {quote(sl.ASSIGN)}, 2)) >= 8"), kind(1, sl.ACCESS), kind(2, sl.HEX)])
    weak = " UNION ".join([
        kind(3, sl.NAMED_ID), kind(3, sl.BARE_ID, f"length(m) BETWEEN 16 AND 24 AND {has('A-Z', '0-9')}"),
        kind(4, sl.KEY, f"length(m) = 40 AND {has('A-Z', 'a-z', '0-9')}"), kind(5, sl.ENDPOINT)])
    names = "[" + ", ".join(quote(k) for k in sl.KINDS) + "]"
    text = f"{names}[kind + 1] || ':' || s || ':' || e"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({base}),
weak AS MATERIALIZED ({weak}),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
seen AS (
  SELECT w.rid, w.kind, w.s, w.e, bool_or(p.kind IN (1, 3)) AS id, bool_or(p.kind IN (0, 2, 4)) AS secret,
         bool_or(p.kind < 3 AND p.s < w.e AND w.s < p.e) AS covered
  FROM weak w JOIN parts p ON w.rid = p.rid AND p.s <= w.e + {sl.SCOPE} AND w.s <= p.e + {sl.SCOPE} GROUP BY ALL),
linked AS (
  SELECT rid, kind, s, e FROM seen
  WHERE NOT covered AND CASE kind WHEN 3 THEN secret WHEN 4 THEN id ELSE id AND secret END),
b AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({text}, ',' ORDER BY s, kind) AS l FROM base GROUP BY rid),
a AS (
  SELECT rid, string_agg({text}, ',' ORDER BY s, kind, e) AS l FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.l, '')) AS base_sha256, coalesce(a.l, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


SQL["op8_secret_links"] = _secrets()

SQL["op4_temperature_mix"] = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce('s' || source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n_tokens,
         coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, ''))) AS name FROM documents),
z AS MATERIALIZED (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
m AS (SELECT CAST(max(tokens) AS DOUBLE) / min(tokens) AS ratio, CAST(max(tokens) AS DOUBLE) AS high FROM z WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(ratio, 1 - (lo + hi) / 2) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM b, m WHERE i < {mix.ROUNDS}),
e AS (SELECT round(hi, 6) AS a FROM b WHERE i = {mix.ROUNDS}),
f AS (SELECT a, sum(pow(CAST(tokens AS DOUBLE), a)) AS norm FROM z, e WHERE tokens > 0 GROUP BY a),
p AS (
  SELECT src, tokens, CASE WHEN tokens > 0 THEN round(pow(CAST(tokens AS DOUBLE), a) / norm, 9) ELSE 0 END AS weight,
         CASE WHEN tokens > 0 THEN CAST(round(round(pow(CAST(tokens AS DOUBLE), a) / norm * pow(high, 1 - a) * norm / tokens, 6) * 1000000) AS BIGINT) ELSE 1000000 END AS micro,
         greatest(1, CAST(ceil(tokens / {mix.BLOCK_TOKENS}) AS BIGINT)) AS blocks
  FROM z LEFT JOIN (SELECT * FROM f, m) ON tokens > 0),
q AS (
  SELECT *, micro // 1000000 AS whole,
         (tokens // 1000000) * (micro % 1000000) + ((tokens % 1000000) * (micro % 1000000)) // 1000000 AS remaining FROM p),
k AS (
  SELECT d.*, q.weight, q.whole, q.remaining, q.blocks, epoch,
         CAST('0x' || substr(md5('17|' || d.src || '|' || epoch || '|' || name), 1, 13) AS BIGINT) AS place
  FROM d JOIN q USING (src), range(1, 10) r(epoch) WHERE epoch <= whole + 1),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY place) AS upto FROM k)
SELECT doc_id, source, n_tokens, weight, CAST(epoch AS INTEGER) AS epoch,
       CAST(((place >> 20) * blocks) >> 32 AS INTEGER) AS block, place
FROM u WHERE epoch <= whole OR (remaining > 0 AND upto <= remaining)"""

SQL["op12_phrase_arrays"] = """
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))
  WHERE len(words) > 0),
f AS MATERIALIZED (
  SELECT lang, k, list_aggregate(words[i : i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, range(1, 6) r(k)) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, k, list_aggregate(w[1:k], 'string_agg', ' ') AS first, list_aggregate(w[k + 1:], 'string_agg', ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM c WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""
