"""From texts to searchable rows in one pass over all documents, and again with other settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators import chunk, embed, jobs
from quillstack.functions.text import first_nonempty, is_blank


def rechunked(documents: DataFrame, size: int, job: Column) -> DataFrame:
    """Chunks under a new job, by the job's own settings; texts without words give none."""
    c = chunk.word_chunks(documents, size)
    return c.withColumn("chunk_job_id", job).withColumn("id", F.concat_ws("/", job.cast("string"), F.col("parsed_document_id").cast("string"), F.col("sequence_index").cast("string")))


def job_rows(documents: DataFrame, chunks: DataFrame, job: Column, as_of: Column) -> DataFrame:
    """A job for each document: succeeded with its chunk count, failed where the document has no text."""
    n = chunks.groupBy("parsed_document_id").agg(F.count("*").alias("declared_count"))
    d = documents.select("parsed_document_id", is_blank(F.col("text")).alias("blank")).join(n, "parsed_document_id", "left")
    return d.select(
        F.concat_ws("/", job.cast("string"), F.col("parsed_document_id").cast("string")).alias("id"), F.col("parsed_document_id").alias("parent_id"),
        F.when(F.col("blank"), "failed").otherwise("succeeded").alias("status"), F.when(F.col("blank"), "chunking_failed").alias("error_code"),
        F.coalesce("declared_count", F.lit(0)).alias("declared_count"), as_of.alias("created_at"))


def with_new_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of jobs, the older successes of a parent superseded once it has a new one."""
    return jobs.superseded(old.unionByName(new, allowMissingColumns=True))


def reembedded(chunks: DataFrame, embedder: embed.Embedder, model: str, job: Column) -> DataFrame:
    """Vectors of chunks under a new job, with batch numbers; the contextualised text where there is one."""
    c = embed.embedded(chunks, embedder, first_nonempty(F.col("contextualized_text"), F.col("text")))
    return c.select(F.col("id").alias("chunk_id"), "parsed_document_id", "sequence_index", "embedding", "token_count", F.lit(model).alias("model"), F.lit(embedder.dimensions).alias("dimensions"), job.alias("embedding_job_id"))


def embedding_jobs(chunk_counts: DataFrame, vectors: DataFrame, job: Column, as_of: Column) -> DataFrame:
    """A job for each document with chunks (parent_id, n): succeeded if every chunk has a vector, else failed."""
    got = vectors.groupBy(F.col("parsed_document_id").alias("parent_id")).agg(F.count("embedding").alias("declared_count"))
    both = chunk_counts.join(got, "parent_id", "left").withColumn("declared_count", F.coalesce("declared_count", F.lit(0)))
    whole = F.col("declared_count") == F.col("n")
    return both.select(
        F.concat_ws("/", job.cast("string"), F.col("parent_id").cast("string")).alias("id"), "parent_id", F.when(whole, "succeeded").otherwise("failed").alias("status"),
        F.when(~whole, "invalid_response").alias("error_code"), "declared_count", as_of.alias("created_at"))
