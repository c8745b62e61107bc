"""Exact vector search: top-k by cosine distance, thresholds, results and prompt assembly.

Top-k of one query over all vectors is one scan: each partition keeps its best rows, and only those are ranked. Many queries meet the vectors in
blocks of both, so neither side is ever whole in one task. Names of chunks and documents are joined to the best candidates alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions import text as t
from quillstack.functions.vectors import cosine_distance
from quillstack.sources.sinks import stored

SYSTEM_RULES = (
    "Answer from the context alone. If it does not hold the answer, say: The documents do not answer this question. "
    "Name the source of every statement. Write Markdown."
)
USER_TEMPLATE = "Context:\n%s\nQuestion: %s"
UNNAMED = "Unnamed document"
BLOCK_BYTES = 1 << 25  # vectors, or queries, of a block
WIDEN, MOST = 8, 1 << 14  # growth and largest number of candidates that are tested for life one by one


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(embeddings: DataFrame, query: list[float], k: int, key: str = "id") -> DataFrame:
    """The k nearest rows by distance, ties by ``key``, with unrounded ``score``."""
    return embeddings.withColumn("score", cosine_distance(F.col("embedding"), literal(query))).orderBy("score", key).limit(k)


TOGETHER = 64  # queries


def _near(x: np.ndarray, size: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray | slice]:
    """For each of ``q`` the rows of ``x`` that may be among its k nearest, by a product that is off by less than 1e-9; all where too few have a distance or squares leave a double's range."""
    own = (q * q).sum(axis=1)
    with np.errstate(all="ignore"):
        score = -((q / np.sqrt(own)[:, None]) @ (x / np.sqrt(size)[:, None]).T)
        least, most = size.min(initial=np.inf, where=size > 0) * own, size.max(initial=0) * own
    out: list[np.ndarray | slice] = []
    for i in range(len(q)):
        sound = np.isfinite(score[i])
        if sound.sum() <= k or not (1e-290 < least[i] and most[i] < 1e290):
            out.append(slice(None))
        else:
            row = np.where(sound, score[i], np.inf)
            out.append(np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9))
    return out


def _nearest(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k nearest of ``rows`` (__key, __v) for each of ``asked`` (query, __q), all of one length."""
    x, q = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t, c in ((rows, "__v"), (asked, "__q")))
    key, size = rows["__key"].to_numpy(), (x * x).sum(axis=1)
    query, found, scores = [], [], []
    for i, (name, v) in enumerate(zip(asked["query"].to_pylist(), q)):
        if i % TOGETHER == 0:
            some = q[i : i + TOGETHER]
            near = _near(x, size, some, k)
        at = near[i % TOGETHER]
        norm = np.sqrt(size[at] * (v * v).sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(norm == 0, np.nan, 1 - (x[at] * v).sum(axis=1) / norm)
        best = np.lexsort((key[at], score))[:k]  # NaN comes last, as in Spark
        query += [name] * len(best)
        found.append(key[at][best]), scores.append(score[best])
    return pa.table({"query": pa.array(query, pa.int64()), "__key": np.concatenate(found), "score": np.concatenate(scores)})


def top_k_many(embeddings: DataFrame, queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """``top_k`` for every row of ``queries`` (query long, vector): query, rank, key and unrounded score. Vectors of other lengths than a
    query's are not compared with it. A block has some ``BLOCK_BYTES``, so vectors move once for each that many bytes of queries."""
    size = lambda d, c: -(-(d.agg(F.sum(8 * F.size(c))).first()[0] or 1) // BLOCK_BYTES)
    n, m = max(1, size(embeddings, "embedding")), max(1, size(queries, "vector"))
    of = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count))
    all_ = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = embeddings.select(F.col(key).cast("long").alias("__key"), F.col("embedding").alias("__v"), F.size("embedding").alias("__d"), of(key, n).alias("__row"), all_(m).alias("__ask"))
    right = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").alias("__q"), F.size("vector").alias("__d"), of("query", m).alias("__ask"), all_(n).alias("__row"))

    def run(_: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows and asked.num_rows:
            return _nearest(rows, asked, k)
        return pa.table({"query": pa.array([], pa.int64()), "__key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    by = ["__d", "__row", "__ask"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query long, __key long, score double")
    order = Window.partitionBy("query").orderBy("score", "__key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", F.col("__key").alias(key), "score")


def within(hits: DataFrame, max_distance: float, max_best: float) -> DataFrame:
    """Rows at most ``max_distance`` away, after the limit; none at all if the best is over ``max_best``. Zero or less turns a rule off."""
    if max_distance > 0:
        hits = hits.where(F.col("score") <= max_distance)
    if max_best > 0:
        hits = hits.withColumn("__best", F.min("score").over(Window.partitionBy())).where(F.col("__best") <= max_best).drop("__best")
    return hits


def named(hits: DataFrame, chunks: DataFrame, documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """Hits with their chunk and document name; inner joins, so orphans fall out."""
    c = chunks.select(F.col("id").alias("chunk_id"), "parsed_document_id", "text", "contextualized_text", "token_count", "heading_path")
    d = documents.select(F.col("id").alias("parsed_document_id"), "uploaded_file_id")
    u = uploads.select(F.col("id").alias("uploaded_file_id"), F.col("original_filename").alias("document_name"))
    return hits.drop("parsed_document_id", "token_count").join(c, "chunk_id").join(d, "parsed_document_id").join(u, "uploaded_file_id")


def search(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, uploads: DataFrame, query: list[float], k: int, max_distance: float = 0.5, max_best: float = 0.4) -> DataFrame:
    """Thresholded results with rank. The limit counts joined rows: vectors whose chunk, document or upload is gone don't take a place.

    The nearest candidates alone are tested for that, more of them while fewer than k live; their ids prune the scans of the other
    tables. Only where ``MOST`` candidates aren't enough are all vectors joined before the limit."""
    spark, n = embeddings.sparkSession, 4 * k
    while n <= MOST:
        near = top_k(embeddings, query, n).drop("embedding", "preview")
        rows = near.collect()  # n rows without vectors or texts
        of = sorted({r["parsed_document_id"] for r in rows})
        mine = chunks.where(F.col("parsed_document_id").isin(of) & F.col("id").isin([r["chunk_id"] for r in rows]))
        alive = named(spark.createDataFrame(rows, near.schema), mine, documents.where(F.col("id").isin(of)), uploads)
        best = alive.orderBy("score", "id").limit(k)
        if len(rows) < n:  # there are no more
            return ranked(within(best, max_distance, max_best))
        best = stored(best, "hits")  # counted and used, made once
        if best.count() >= k:
            return ranked(within(best, max_distance, max_best))
        n *= WIDEN
    known = named(embeddings.drop("preview"), chunks, documents, uploads)
    return ranked(within(top_k(known, query, k), max_distance, max_best).drop("embedding"))


def ranked(hits: DataFrame, key: str = "id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))


def results(hits: DataFrame, length: int = 300) -> DataFrame:
    """Rank, name, place and cut texts of ranked hits."""
    return hits.select(
        "rank", "chunk_id", "document_name", "sequence_index", t.cut(F.coalesce("text", F.lit("")), length).alias("text"),
        t.cut(F.coalesce("contextualized_text", F.lit("")), length).alias("contextualized_text"), "token_count", F.round("score", 6).alias("score"))


def prompt_blocks(hits: DataFrame) -> DataFrame:
    """(rank, block) of ranked hits (rank, document_name, heading_path, page_numbers, texts). Numbers are those before noise is dropped."""
    text = t.first_nonempty(F.col("contextualized_text"), F.col("text"))
    heading, pages = F.array_join("heading_path", " > "), F.array_join(F.col("page_numbers").cast("array<string>"), ", ")
    source = F.concat_ws(" | ", "document_name", F.nullif(heading, F.lit("")), F.nullif(pages, F.lit("")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), source, F.lit("\n"), text, F.lit("\n"))
    return hits.where(~t.is_noise(text)).select("rank", block.alias("block"))


def prompt(hits: DataFrame, question: str) -> DataFrame:
    """Two messages (role, content), also where every block was noise."""
    blocks = prompt_blocks(hits).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))  # k rows at most
    context = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    user = F.format_string(USER_TEMPLATE, context, F.lit(question))
    messages = F.array(F.struct(F.lit(1).alias("position"), F.lit("system").alias("role"), F.lit(SYSTEM_RULES).alias("content")), F.struct(F.lit(2).alias("position"), F.lit("user").alias("role"), user.alias("content")))
    return blocks.select(F.explode(messages).alias("m")).select("m.*")


def grouped(results_: DataFrame) -> DataFrame:
    """Results by document in order of first appearance, with their ranks."""
    name = t.first_nonempty(F.col("document_name"))
    name = F.when(name == "", UNNAMED).otherwise(name)
    return results_.groupBy(name.alias("document_name")).agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_results"), F.array_sort(F.collect_list("rank")).alias("ranks"))


def score_bars(results_: DataFrame) -> DataFrame:
    """Bar width in percent and colour class by distance relative to the largest."""
    most = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(0.001))
    share = F.col("score") / most
    colour = F.when(share < 0.33, "near").when(share < 0.66, "middle").otherwise("far")
    return results_.select("rank", F.round(F.greatest(F.lit(0.0), (1 - share) * 100), 0).cast("int").alias("percent"), colour.alias("colour"))


def histogram(results_: DataFrame, bins: int = 8) -> DataFrame:
    """Equal-width bins of scores, at most as many as rows; edges are min + i * width. The last bin takes all from its edge
    up, so that no score is lost to rounding of the upper edge."""
    one = results_.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.collect_list("score").alias("s")).where("n > 0")
    one = one.withColumn("bins", F.least(F.lit(bins), F.col("n").cast("int")))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(0.001)
    one = one.withColumn("width", span / F.col("bins")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    low = F.col("low") + F.col("bin") * F.col("width")
    one = one.withColumn("from", low).withColumn("to", low + F.col("width"))
    inside = F.filter("s", lambda x: (x >= F.col("from")) & ((x < F.col("to")) | (F.col("bin") == F.col("bins") - 1)))
    return one.select("bin", F.round("from", 3).alias("label"), F.size(inside).cast("long").alias("n_results"))


def statistics(results_: DataFrame, embeddings: DataFrame) -> DataFrame:
    total = embeddings.agg(F.count("*").alias("n_embeddings"))
    found = results_.agg(F.count("*").alias("n_results"), F.count_distinct("document_name").alias("n_documents"), F.round(F.min("score"), 6).alias("best"))
    return found.withColumn("__k", F.lit(1)).join(total.withColumn("__k", F.lit(1)), "__k").drop("__k")


def response(results_: DataFrame, embeddings: DataFrame, query: str, vector: list[float], model: str, k: int) -> DataFrame:
    """The one nested row of a search: the query with the first components of its vector, totals, and results in order."""
    total = embeddings.agg(F.count("*").alias("total_searched"), F.count_distinct("parsed_document_id").alias("searched_document_count"))
    listed = results_.agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_name", "score"))).alias("results"))  # k rows at most
    one = total.withColumn("__k", F.lit(1)).join(listed.withColumn("__k", F.lit(1)), "__k")
    return one.select(
        F.lit(query).alias("query"), literal(vector[:5]).alias("query_embedding_preview"), F.lit(model).alias("embedding_model"), F.lit(len(vector)).alias("embedding_dimensions"), F.lit(k).alias("top_k"),
        "total_searched", "searched_document_count", "results")
