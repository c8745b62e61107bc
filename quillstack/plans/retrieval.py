"""Queries of retrieval by keywords, by approximate vectors and by both, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import ann, hybrid, search
from quillstack.operators import keywords as kw
from quillstack.plans.oracles import SQL
from quillstack.plans.queries import QUERIES, query, shipped
from quillstack.sources import fixtures as fx

BEST, DIMS = 10, 64


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The words of the first line of every fiftieth document."""
    docs = fx.table(spark, d, "documents").where("doc_id % 50 = 0")
    return docs.select(F.col("doc_id").alias("query"), kw.terms(F.split("text", "\n", 2)[0]).alias("words"))


@query
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by BM25 for the first line of every fiftieth."""
    i = kw.index(fx.table(spark, d, "documents"), cluster=["lang"])
    return kw.top_k(i, first_lines(spark, d), BEST).select("query", "rank", F.col("doc").alias("doc_id"), "score")


@query
def keyword_blocks_read(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks of the index each query could read and how many it read."""
    i = kw.index(fx.table(spark, d, "documents"), cluster=["lang"])
    return kw.blocks_read(i, first_lines(spark, d), BEST)


KEYWORDS = f"""
w AS MATERIALIZED (SELECT doc_id AS doc, lang, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents WHERE doc_id IS NOT NULL),
z AS (SELECT count(*) AS n, sum(len(words)) / count(*)::DOUBLE AS mean FROM w),
tf AS (SELECT doc, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc, len(words) AS length, unnest(words) AS term FROM w) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM z) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term),
share AS MATERIALIZED (
  SELECT doc, term, CAST(floor(1e6::DOUBLE * idf * tf * {kw.K1 + 1}::DOUBLE / (tf + {kw.K1}::DOUBLE * ({1 - kw.B}::DOUBLE + {kw.B}::DOUBLE * length / (SELECT mean FROM z)))) AS BIGINT) AS share FROM tf JOIN idf USING (term)),
asked AS (SELECT DISTINCT doc AS query, unnest(regexp_extract_all(lower(coalesce(split_part(text, chr(10), 1), '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM w WHERE doc % 50 = 0),
scores AS MATERIALIZED (SELECT query, doc, CAST(sum(share) AS BIGINT) AS score FROM asked JOIN share USING (term) GROUP BY ALL)"""

SQL["keyword_topk"] = f"""
WITH {KEYWORDS}
SELECT query, CAST(row_number() OVER o AS INTEGER) AS rank, doc AS doc_id, score FROM scores
WINDOW o AS (PARTITION BY query ORDER BY score DESC, doc) QUALIFY row_number() OVER o <= {BEST}"""

SQL["keyword_blocks_read"] = f"""
WITH {KEYWORDS},
c AS (SELECT doc, coalesce(lang, '') || '|' || CAST(floor(log2(len(words) + 1)) AS BIGINT) AS c FROM w),
nb AS (SELECT c, CAST(ceil(count(*) / {kw.PER_BLOCK}.0) AS BIGINT) AS n FROM c GROUP BY c),
bl AS (SELECT doc, c || '/' || (CAST('0x' || substr(md5(CAST(doc AS VARCHAR)), 1, 8) AS BIGINT) % n) AS block FROM c JOIN nb USING (c)),
best AS (SELECT term, block, max(share) AS best FROM share JOIN bl USING (doc) GROUP BY ALL),
bound AS (SELECT query, block, sum(best) AS bound FROM asked JOIN best USING (term) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bound DESC, block) AS place FROM bound),
early AS (SELECT query, score FROM scores JOIN bl USING (doc) JOIN placed USING (query, block) WHERE place <= {kw.FIRST} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) = {BEST})
SELECT query, count(*) AS n_blocks, count(*) FILTER (place <= {kw.FIRST} OR bound >= coalesce(score, 0)) AS n_read FROM placed LEFT JOIN early USING (query) GROUP BY query"""


def fiftieth(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest ten to every fiftieth vector, as the index finds them."""
    i = ann.index(fx.table(spark, d, "embeddings"), "vec_id", "embedding", DIMS)
    return ann.top_k(i, fiftieth(spark, d), BEST).select("query", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the index finds against exact search: every found distance is exact, at least nine tenths of the nearest ten are found."""
    e, asked = fx.table(spark, d, "embeddings"), fiftieth(spark, d)
    found = ann.top_k(ann.index(e, "vec_id", "embedding", DIMS), asked, BEST).select("query", F.col("key").alias("vec_id"), F.col("score").alias("found"))
    both = search.top_k_many(e, asked, BEST, "vec_id").join(found, ["query", "vec_id"], "left")
    hit = F.col("found").isNotNull()
    return both.agg(F.count("*").alias("n"), (F.count_if(hit) >= 0.9 * F.count("*")).alias("is_enough"), (F.coalesce(F.max(F.abs(F.col("found") - F.col("score"))), F.lit(1.0)) < 1e-9).alias("is_exact"))


SQL["ann_recall"] = f"""
SELECT CAST(sum(least({BEST}, n)) AS BIGINT) AS n, true AS is_enough, true AS is_exact FROM (SELECT q.vec_id, count(*) AS n FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 GROUP BY 1)"""

for _name in ("keyword_topk", "keyword_blocks_read", "ann_topk", "ann_recall"):
    QUERIES[_name] = shipped(QUERIES[_name])


WEIGHT = 5


@query
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by keywords and vectors together for every fiftieth document: the words of its first line and its own vector; fewer documents have vectors than texts."""
    docs, e = fx.table(spark, d, "documents"), fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = first_lines(spark, d).join(e.select(F.col("doc").alias("query"), "vector"), "query", "left")
    return hybrid.top_k(kw.index(docs, cluster=["lang"]), e, asked, BEST, DIMS, WEIGHT).select("query", "rank", F.col("doc").alias("doc_id"), "score")


SQL["hybrid_topk"] = f"""
WITH {KEYWORDS},
v AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT q.doc AS query, v.doc, CAST(greatest(round(1e6 * list_cosine_similarity(v.v, q.v)), 0) AS BIGINT) AS alike FROM v q JOIN w ON w.doc = q.doc JOIN v ON q.doc % 50 = 0),
every AS (SELECT query, doc, coalesce(score, 0) + {WEIGHT} * coalesce(alike, 0) AS score FROM scores FULL JOIN near USING (query, doc))
SELECT query, CAST(row_number() OVER o AS INTEGER) AS rank, doc AS doc_id, score FROM every WHERE score > 0
WINDOW o AS (PARTITION BY query ORDER BY score DESC, doc) QUALIFY row_number() OVER o <= {BEST}"""

QUERIES["hybrid_topk"] = shipped(QUERIES["hybrid_topk"])
