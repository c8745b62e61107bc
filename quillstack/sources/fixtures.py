"""The engine's tables, derived from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.chunk import word_chunks

CHUNK_WORDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str | None], by) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))


EXTENSIONS = [".txt", ".md", ".PDF", ".docx", ".pptx", ""]
TYPES = [None, "text/plain", "text/markdown", "application/pdf", "application/vnd.ms-powerpoint", "application/octet-stream", ""]


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.col("doc_id") + 1704067200)
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("owner_user_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), pick(EXTENSIONS, F.col("doc_id"))).alias("original_filename"),
        pick(TYPES, F.col("doc_id")).alias("content_type"),
        F.octet_length("text").cast("long").alias("byte_size"),
        F.sha2("text", 256).alias("checksum_sha256"),
        F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("stored").alias("status"),
        F.when(F.col("doc_id") % 13 == 0, created).alias("deleted_at"),
        created.alias("created_at"),
    )


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("uploaded_file_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("parse_job_id"),
        F.col("source").alias("owner_user_id"), F.substring("text", 1, 20).alias("title"), F.col("text"), F.col("lang"),
        F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("created_at"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("parsed_document_id"), F.posexplode(F.split("text", "\n", -1)).alias("sequence_index", "text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-window chunks with the context ``source > lang``; ids are document * 1000000 + sequence."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("parsed_document_id"), F.col("source").alias("owner_user_id"), "text", F.array("source", "lang").alias("heading_path"))
    c = word_chunks(d, CHUNK_WORDS)
    return c.withColumn("id", F.col("parsed_document_id") * 1000000 + F.col("sequence_index")).withColumn(
        "token_count", F.when(F.col("id") % 29 == 0, F.lit(None).cast("int")).when(F.col("id") % 31 == 0, 0).otherwise(F.col("token_count")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors for each of the first documents, at sequences 0, 1 and 3."""
    e = table(spark, sf_dir, "embeddings")
    doc, k = F.floor(F.col("vec_id") / 3), F.col("vec_id") % 3
    seq = F.when(k == 2, 3).otherwise(k).cast("int")
    return e.select(
        F.col("vec_id").alias("id"), doc.alias("parsed_document_id"), seq.alias("sequence_index"), (doc * 1000000 + seq).alias("chunk_id"),
        F.when(F.col("vec_id") % 23 == 0, "model-b").otherwise("model-a").alias("model"),
        F.when(F.col("vec_id") % 17 == 0, 63).otherwise(64).alias("dimensions"),
        F.when(F.col("vec_id") % 19 == 0, F.lit(None).cast("int")).otherwise(F.col("label")).alias("token_count"), "embedding")


STATUSES = {"signup": "queued", "view": "running", "click": "succeeded", "error": "failed", "purchase": "superseded"}
LEVELS = {"view": "debug", "click": "info", "signup": "info", "purchase": "warn", "error": "error"}


def mapped(column: str, values: dict[str, str]) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("parent_id"), mapped("event_type", STATUSES).alias("status"), F.col("ts").alias("created_at"), F.floor("value").cast("long").alias("declared_count"))


def shared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs, each user's dealt to 64 parents of their own, so that parents have few jobs."""
    return jobs(spark, sf_dir).withColumn("parent_id", F.col("parent_id") * 64 + F.col("id") % 64)


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts"), mapped("event_type", LEVELS).alias("level"), F.sha2(F.col("user_id").cast("string"), 256).alias("trace_id"),
        F.concat(F.lit("events:"), F.col("event_type")).alias("module"), F.concat(F.lit("value "), F.floor("value").cast("long").cast("string")).alias("message"),
        F.octet_length("props").cast("long").alias("bytes"))
