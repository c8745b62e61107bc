"""Chunks that follow a document's structure: within one heading path, of a bounded number of tokens, with the pages they come from.

Segments are Markdown. Their lines get the path of headings above them; neighbouring lines with the same path are a section, and sections are cut into windows
of ``max_tokens`` tokens. Tokens are words, counted natively. A document is bounded by the size of an upload, so its lines are one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.operators.chunk import words

LEVELS = 6
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"


def lines(segments: DataFrame) -> DataFrame:
    """Lines of ``segments`` (parsed_document_id, sequence_index, page_no, text) that aren't headings, with their heading path and section."""
    every = segments.select("parsed_document_id", F.col("sequence_index").alias("segment"), "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    every = every.withColumn("level", F.length(F.regexp_extract("text", HEADING, 1))).withColumn("title", F.regexp_extract("text", HEADING, 2))
    upto = Window.partitionBy("parsed_document_id").orderBy("segment", "line")
    # the last heading of a level, unless one above it came later
    at = [F.last(F.when(F.col("level") == n, F.col("title")).when((F.col("level") > 0) & (F.col("level") < n), ""), True).over(upto) for n in range(1, LEVELS + 1)]
    every = every.withColumn("heading_path", F.filter(F.array(*at), lambda x: x.isNotNull() & (x != "")))
    body = every.where("level = 0").withColumn("words", words(F.col("text"))).where("size(words) > 0")
    before = F.lag("heading_path").over(upto)
    new = F.when(before.isNull() | (before != F.col("heading_path")), 1).otherwise(0)
    return body.withColumn("new", new).withColumn("section", F.sum("new").over(upto) - 1).drop("new", "level", "title")


def section_chunks(segments: DataFrame, max_tokens: int) -> DataFrame:
    """parsed_document_id, sequence_index, text, contextualized_text, token_count, heading_path, page_numbers, source_segment_indices."""
    one = lines(segments).groupBy("parsed_document_id", "section").agg(F.array_sort(F.collect_list(F.struct("segment", "line", "page_no", "words", "heading_path"))).alias("l"))
    flat = F.flatten(F.transform("l", lambda x: F.transform(x["words"], lambda w: F.struct(w.alias("w"), x["page_no"].alias("p"), x["segment"].alias("s")))))
    one = one.select("parsed_document_id", "section", F.col("l")[0]["heading_path"].alias("heading_path"), flat.alias("t"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / max_tokens).cast("int"))).alias("part")
    out = one.select("*", part).withColumn("t", F.slice("t", F.col("part") * max_tokens + 1, F.lit(max_tokens)))
    place = F.row_number().over(Window.partitionBy("parsed_document_id").orderBy("section", "part")) - 1
    text = F.array_join(F.col("t")["w"], " ")
    pages = F.array_sort(F.array_distinct(F.array_compact(F.col("t")["p"])))
    return out.select(
        "parsed_document_id", place.alias("sequence_index"), text.alias("text"), F.concat_ws("\n", F.array_join("heading_path", "\n"), text).alias("contextualized_text"),
        F.size("t").alias("token_count"), "heading_path", F.when(F.size(pages) > 0, pages).alias("page_numbers"), F.array_sort(F.array_distinct(F.col("t")["s"])).alias("source_segment_indices"))
