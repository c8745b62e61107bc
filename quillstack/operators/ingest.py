"""Uploads: manifest rows and admission, with a reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import keys
from quillstack.functions import text as t

MAX_BYTES = 50 << 20


def manifest(uploads: DataFrame) -> DataFrame:
    name, kind = F.col("original_filename"), F.col("content_type")
    return uploads.select(
        "id", "owner_user_id", "original_filename", "byte_size", "checksum_sha256", t.safe_extension(name).alias("extension"),
        t.document_format(name, kind).alias("format"), keys.upload_key(F.col("owner_user_id"), F.col("id"), name).alias("storage_key"),
        t.file_size(F.col("byte_size")).alias("size_label"), t.utc_iso(F.col("created_at")).alias("created"))


def rejection(allowed_types: list[str], allowed_extensions: list[str], max_bytes: int = MAX_BYTES) -> Column:
    """Why an upload is not admitted; null if it is."""
    name, kind = F.col("original_filename"), F.col("content_type")
    listed = F.coalesce(kind.isin(*allowed_types), F.lit(False)) | t.extension(name).isin(*allowed_extensions)
    return (
        F.when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("status") != "stored", "not_stored")
        .when(F.col("byte_size") == 0, "empty_file")
        .when(F.col("byte_size") > max_bytes, "too_large")
        .when(~t.content_type_allowed(name, kind, allowed_types), "content_type")
        .when(t.document_format(name, kind).isNull() | ~listed, "format")
    )


def sniffed(files: DataFrame, sample: int = 8192) -> DataFrame:
    """What the first bytes of files (path, content) say: pdf, zip, text or binary."""
    head = F.substring("content", 1, sample)
    # X'00' does not occur in text; two hex digits at an even place
    has_nul = F.hex(head).rlike("^(..)*?00")
    kind = F.when(F.substring("content", 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), "zip")
    return files.withColumn("kind", kind.when(has_nul, "binary").otherwise("text"))


def parsed(uploads: DataFrame, texts: DataFrame, max_pages: int = 100) -> DataFrame:
    """The plain-text and Markdown parse: one whole-document segment; a row with an error code where there is no text.

    ``texts`` has id and text. Page count is null, so the segment has no page."""
    d = uploads.join(texts, "id")
    error = F.when(t.is_blank(F.col("text")), "parse_failed")
    segment = F.struct(F.lit(0).alias("sequence_index"), F.lit("document").alias("segment_type"), F.lit(None).cast("int").alias("page_no"), F.col("text"))
    return d.select("id", F.col("text").alias("markdown"), "text", F.to_json(F.struct(F.col("text").alias("content"))).alias("doc_json"), F.lit(None).cast("int").alias("page_count"), F.array(segment).alias("segments"), error.alias("error_code"))


# Elements that end a paragraph which has no closing tag.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = rf"(?is)</?(?:{'|'.join(BLOCKS)})(?:[\s/>].*|$)"


def paragraphs(html: Column) -> Column:
    """Texts of the paragraphs of a page, from an opening tag to the closing one, the next block or the end, without tags."""
    parts = F.split(F.coalesce(html, F.lit("")), PARAGRAPH, -1)
    whole = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(whole, lambda x: F.regexp_replace(F.regexp_replace(x, PARAGRAPH_END, ""), "<[^>]*>", ""))
