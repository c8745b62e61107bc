"""Chunking, token counts and threshold storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import keys


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("int")


def word_chunks(documents: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` words of ``text``, numbered from 0, with contextualised text headed by ``heading_path``.

    A document's words stay in its row until the windows are generated, so nothing is shuffled."""
    w = documents.withColumn("__words", words(F.col("text"))).where(F.size("__words") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("__words") - 1) / size).cast("int"))
    out = w.withColumn("sequence_index", F.explode(starts))
    part = F.slice("__words", F.col("sequence_index") * size + 1, F.lit(size))
    out = out.withColumn("text", F.array_join(part, " ")).withColumn("token_count", F.size(part).cast("int"))
    return out.withColumn("contextualized_text", F.concat(F.array_join("heading_path", " > "), F.lit("\n"), F.col("text"))).drop("__words")


def hybrid_storage(chunks: DataFrame, limit: int, job: Column) -> DataFrame:
    """Each text is inline up to ``limit`` bytes, else only a storage key; the two texts are judged separately."""
    for name, kind in (("text", "text"), ("contextualized_text", "contextualized")):
        large = F.octet_length(name) > limit
        key = keys.chunk_key(F.col("owner_user_id"), F.col("parsed_document_id"), job, F.col("sequence_index"), kind)
        chunks = chunks.withColumn(f"{name}_storage_key", F.when(large, key)).withColumn(f"{name}_bytes", F.octet_length(name).cast("long"))
        chunks = chunks.withColumn(name, F.when(~large, F.col(name)))
    return chunks


def resolve_text(chunks: DataFrame, files: DataFrame, name: str = "text") -> DataFrame:
    """Fills an offloaded text from ``files`` (storage_key, content); adds ``{name}_source``: inline, file or unavailable."""
    key = f"{name}_storage_key"
    out = chunks.join(files.select(F.col("storage_key").alias(key), F.col("content").alias("__content")), key, "left")
    out = out.withColumn(f"{name}_source", text_source(F.col(name), F.col(key)))
    return out.withColumn(name, F.when(F.length(name) > 0, F.col(name)).otherwise(F.col("__content"))).drop("__content")


def text_source(inline: Column, key: Column) -> Column:
    return F.when(F.length(inline) > 0, "inline").when(F.length(key) > 0, "file").otherwise("unavailable")


def normalise_headings(v: Column) -> Column:
    out = F.transform(v, lambda x: x.cast("string"))
    return F.when(F.size(out) > 0, out)


def page_numbers(items: Column) -> Column:
    """Sorted distinct pages of nested provenance lists; null if there are none."""
    pages = F.array_sort(F.array_distinct(F.filter(F.flatten(items), lambda p: p.isNotNull())))
    return F.when(F.size(pages) > 0, pages)


def merge_metadata(first: Column, second: Column) -> Column:
    """Entries of both maps; the second wins."""
    mine = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(mine, second)
