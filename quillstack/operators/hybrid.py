"""The best documents by keywords and vectors together, without scoring all of them.

A document's score is its BM25 score (millionths) and ``weight`` times the millionths of its cosine similarity, where it has either: a document without a vector, or without a term of the query, has nothing
there, and a negative similarity is nothing. Both lists are read to a depth, and every document that stands in one is scored in full by both. One that stands in neither scores at most what the
last of each list does: a query whose k-th document scores more is done. The others go deeper by ``DEEPER``, but lists no longer than ``LONGEST``; then that k-th score is a threshold: where a part of the index meets them and the vectors of its documents, both scores are
added up in place, and only documents that reach the threshold, k of a part or a few more, move on. The results are those of scoring everything.

Defined cases: of equal scores the smaller id comes first; documents that score nothing aren't found; a query with neither terms nor a sound vector finds nothing; ids are unique; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions.vectors import cosine_distance
from quillstack.operators import ann, search
from quillstack.operators import keywords as kw
from quillstack.sources.sinks import stored

DEPTH, DEEPER, LONGEST = 50, 4, 100


def _similar(a: str, b: str):
    """Millionths of the cosine similarity, none if it is negative."""
    return F.greatest(F.round(1e6 * (1 - cosine_distance(F.col(a), F.col(b)))), F.lit(0.0)).cast("long")


def _reaching(k: int, weight: int, mean: float) -> Callable:
    """query, doc, bm25 of a part's documents that may reach a query's threshold and be among its k best. Besides the part's rows there is a row for each of its vectors (doc, v). The similarity is
    within a millionth here; what passes is scored again."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("query", "doc", "bm25")}
        if rows.num_rows and asked.num_rows:
            g, of_part, held = kw._Group(asked), rows.filter(pc.is_null(rows["v"])), rows.filter(pc.is_valid(rows["v"]))
            p = kw._Part(of_part, g, mean) if of_part.num_rows else None
            known, own = p.docs if p else np.zeros(0, np.int64), held["doc"].to_numpy()
            ids = np.union1d(known, own)
            at_known, at_own = np.searchsorted(ids, known), np.searchsorted(ids, own)
            x = held["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 1))
            q = g.q.reshape(g.similar.sum(), -1) if g.similar.any() else np.zeros((0, 1))
            place = np.cumsum(g.similar) - 1
            step = max(1, min(kw.AT_ONCE, kw.CELLS // max(1, len(ids))))
            for low in range(0, g.n, step):
                high = min(g.n, low + step)
                least = np.zeros((high - low, len(ids)), np.int64)
                if p:
                    a, b = np.searchsorted(g.at, (low, high))
                    least[:, at_known] = np.maximum(kw._sums(g.at[a:b] - low, g.word[a:b], p.at, p.start, p.share, p.most, (high - low, p.n)), 0)
                bm25, most = least.copy(), least.copy()
                aimed = np.flatnonzero(g.similar[low:high])
                if len(aimed) and len(own):
                    similar = np.rint(1e6 * (q[place[low:high][aimed]] @ x.T)).astype(np.int64)
                    cells = np.ix_(aimed, at_own)
                    least[cells] += weight * np.maximum(similar - 1, 0)
                    most[cells] += weight * np.maximum(similar + 1, 0)
                for i in range(high - low):
                    enough = max(g.threshold[low + i], 1)
                    best = np.flatnonzero(most[i] >= enough)
                    if len(best) > k:
                        best = best[most[i][best] >= np.partition(least[i][best], len(best) - k)[len(best) - k]]
                    for c, v in (("query", np.full(len(best), g.query[low + i])), ("doc", ids[best]), ("bm25", bm25[i][best])):
                        out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in out.items()})

    return run


def top_k(index: kw.Index, vectors: DataFrame, queries: DataFrame, k: int, dims: int, weight: int = 5, depth: int = DEPTH) -> DataFrame:
    """query, rank, doc, score, depth for each of ``queries`` (query, words, vector); ``vectors`` has doc and vector, ``depth`` is how far the query's lists were read, null: to their ends."""
    units = stored(ann.unit(vectors, "doc", "vector", dims).select(F.col("key").alias("doc"), "v"), "units")
    asked = stored(queries.where("query IS NOT NULL").select(F.col("query").cast("long").alias("query"), "words", "vector"), "queries")
    aimed = stored(ann.unit(asked, "query", "vector", dims).select(F.col("key").alias("query"), "v"), "aimed")
    empty = F.array().cast("array<string>")
    done: list[DataFrame] = []

    def scored(found: DataFrame) -> DataFrame:
        """With ``score`` and ``similar``; ``found`` has query, doc and bm25."""
        similar = found.select("query", "doc").join(units, "doc").join(aimed.withColumnRenamed("v", "q"), "query").select("query", "doc", _similar("v", "q").alias("similar"))
        every = found.join(similar, ["query", "doc"], "left").withColumn("similar", F.coalesce("similar", F.lit(0)))
        return every.withColumn("score", F.col("bm25") + weight * F.col("similar"))

    def best(every: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
        return every.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "doc", "score")

    while True:
        words = asked.select("query", F.coalesce("words", empty).alias("words"))
        by_words = stored(kw.top_k(index, words, depth).select("query", "rank", "doc", "score"), "by_words")
        near = search.top_k_many(units.select("doc", F.col("v").alias("embedding")), aimed.join(asked.select("query"), "query", "left_semi").select("query", F.col("v").alias("vector")), depth, "doc")
        by_vectors = stored(near.select("query", "rank", "doc"), "by_vectors")
        pairs = stored(by_words.select("query", "doc").union(by_vectors.select("query", "doc")).distinct(), "pairs")
        both = pairs.join(kw.scores_of(index, pairs, words), ["query", "doc"], "left")
        both = stored(both.select("query", "doc", F.coalesce("score", F.lit(0)).alias("bm25")), "both")  # read twice
        every = stored(scored(both), "scored")
        # what the last of each full list scores in it; a list that has ended has nothing more
        last = lambda ranked, part: ranked.where(F.col("rank") == depth).join(every, ["query", "doc"]).select("query", F.col(part).alias(f"last_{part}"))
        limit = asked.select("query").join(last(by_words.select("query", "rank", "doc"), "bm25"), "query", "left").join(last(by_vectors, "similar"), "query", "left")
        early = stored(best(every), "best")
        kth = early.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        ended = F.col("last_bm25").isNull() & F.col("last_similar").isNull()
        sure = F.coalesce(F.col("kth") > F.coalesce("last_bm25", F.lit(0)) + weight * F.coalesce("last_similar", F.lit(0)), F.lit(False))
        limit = stored(limit.join(kth, "query", "left").select("query", (ended | sure).alias("sure"), F.coalesce("kth", F.lit(1)).alias("threshold")), "limit")
        done.append(early.join(limit.where("sure"), "query", "left_semi").withColumn("depth", F.lit(depth)))
        asked = stored(asked.join(limit.where("NOT sure"), "query", "left_semi"), "queries")
        depth *= DEEPER
        if depth > LONGEST:
            break
    open_ = limit.where("NOT sure").join(kw._asked(index, words), "query", "left").join(aimed.withColumnRenamed("v", "q"), "query", "left")
    open_ = stored(open_.select("query", F.coalesce("words", empty).alias("words"), F.coalesce("idfs", F.array().cast("array<double>")).alias("idfs"), "threshold", "q"), "open")
    of_vectors = units.join(index.places, "doc", "left").select(kw.part_of(index, F.coalesce("block", F.col("doc").cast("string"))).alias("part"), "doc", "v")
    found = kw._meet(index, open_, _reaching(k, weight, index.mean), "query long, doc long, bm25 long", more=of_vectors)
    late = best(scored(stored(found, "found"))).withColumn("depth", F.lit(None).cast("int"))
    for rows in done:
        late = late.unionByName(rows)
    return late
