"""Listings, pages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.chunk import text_source

MAX_PAGE = 200


def owned(rows: DataFrame, key: object, owner: str) -> DataFrame:
    return rows.where((F.col("id") == F.lit(key)) & (F.col("owner_user_id") == owner))


def live(rows: DataFrame, stored_only: bool = False) -> DataFrame:
    out = rows.where(F.col("deleted_at").isNull())
    return out.where(F.col("status") == "stored") if stored_only else out


def clamp(limit: int, offset: int) -> tuple[int, int]:
    return max(1, min(limit, MAX_PAGE)), max(0, offset)


def page(rows: DataFrame, order: list[Column | str], limit: int = 50, offset: int = 0) -> DataFrame:
    limit, offset = clamp(limit, offset)
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with their number of children, zero included. Children are counted before they move."""
    n = children.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias(name))
    return parents.join(n, parents.id == n["__k"], "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__k")


def documents_page(documents: DataFrame, children: DataFrame, key: str, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest documents first with their counts; only the page's documents are counted."""
    some = page(documents, [F.desc("created_at"), "id"], limit, offset)
    mine = children.join(F.broadcast(some.select(F.col("id").alias(key))), key, "left_semi")  # a page: MAX_PAGE rows at most
    return with_counts(some, mine, key, name)


def available(documents: DataFrame, uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose upload's file exists; ``files`` lists storage keys."""
    there = uploads.join(files, "storage_key", "left_semi").select(F.col("id").alias("uploaded_file_id"))
    return documents.join(there, "uploaded_file_id", "left_semi")


def paged(rows: DataFrame, order: list[Column | str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all rows; past the end it is empty."""
    total = rows.agg(F.count("*").alias("total")).withColumn("__k", F.lit(1))
    return page(rows, order, limit, offset).withColumn("__k", F.lit(1)).join(total, "__k").drop("__k")


def chunk_read(chunks: DataFrame) -> DataFrame:
    """Rows as they are shown: without storage keys; a source says where the text is."""
    hidden = [c for c in chunks.columns if c.endswith(("_storage_key", "_bytes"))]
    return chunks.withColumn("text_source", text_source(F.col("text"), F.col("text_storage_key"))).drop(*hidden)


def embedding_read(embeddings: DataFrame) -> DataFrame:
    """Rows as they are shown: without the vector."""
    return embeddings.drop("embedding", "embedding_json")


def document_read(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """A document with what is shown of its upload."""
    u = uploads.select(F.col("id").alias("uploaded_file_id"), F.struct("original_filename", "content_type", "byte_size", "status").alias("uploaded_file"))
    return documents.drop("text").join(u, "uploaded_file_id")
