"""Embedding in batches: batch numbers, token shares, validation, and a deterministic offline embedder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed counts of hashed words, scaled to unit norm: no model, the same on every machine."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for w in text.split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embedded(chunks: DataFrame, embedder: Embedder, text: Column) -> DataFrame:
    """Adds ``embedding``; the embedder is sent once and used batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed(texts.fillna("").tolist())), index=texts.index)

    return chunks.withColumn("embedding", run(text))


def batched(rows: DataFrame, size: int, by: str = "parsed_document_id", order: str = "sequence_index") -> DataFrame:
    """Batch number and place in it, within each document."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(i / size).cast("int")).withColumn("position", (i % size).cast("int"))


def apportioned(rows: DataFrame, total: Column, by: list[str], position: str = "position") -> DataFrame:
    """Shares of a batch's tokens: as even as whole numbers allow, the remainder to the first. Null totals give nulls."""
    n = F.count("*").over(Window.partitionBy(*by))
    base = F.floor(total / n).cast("long")
    return rows.withColumn("token_share", base + (F.col(position) < total % n).cast("long"))


def invalid(embeddings: DataFrame) -> DataFrame:
    """Vectors whose length isn't the declared one."""
    return embeddings.where(F.size("embedding") != F.col("dimensions"))


def zipped(chunks: DataFrame, results: DataFrame, by: str = "parsed_document_id") -> DataFrame:
    """Chunks and results (index, embedding) by place, with an error where a document's counts differ."""
    c = chunks.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("sequence_index")) - 1)
    both = c.join(results, [by, "index"], "full_outer")
    bad = F.count_if(F.col("sequence_index").isNull() | F.col("embedding").isNull()).over(Window.partitionBy(by))
    return both.withColumn("error_code", F.when(bad > 0, "invalid_response"))


def backfilled(rows: DataFrame, json_column: str, dimensions: int) -> DataFrame:
    """Vectors from their JSON text, with whether they have the wanted length; the whole table at once."""
    v = F.from_json(json_column, "array<float>")
    return rows.withColumn("embedding", v).withColumn("sound", F.coalesce(F.size(v) == dimensions, F.lit(False)))


def dual(rows: DataFrame) -> DataFrame:
    """The vector as it is and as JSON text, both from one array."""
    return rows.withColumn("embedding_json", F.to_json("embedding"))


def retry_delay(header: Column, attempt: Column, unit: Column) -> Column:
    """Seconds to wait: a given Retry-After within 0.5 to 60, else ``unit`` (0 to 1) of 2 ** attempt, 60 at most."""
    seconds = header.try_cast("double")
    given = F.when(seconds.isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(60.0), seconds)))
    return F.coalesce(given, unit * F.least(F.pow(F.lit(2.0), attempt), F.lit(60.0)))


def retried(status: Column, kind: Column, attempt: Column, max_retries: int) -> Column:
    """Timeouts, lost connections, 429 and 5xx are tried again while attempts are left."""
    again = kind.isin("timeout", "connection") | (status == 429) | status.between(500, 599)
    return F.coalesce(again, F.lit(False)) & (attempt < max_retries)
