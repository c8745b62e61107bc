"""Integrity report: chunks paired with embeddings, seven checks and totals, for all documents in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.operators.chunk import text_source

KEY = ["parsed_document_id", "sequence_index"]
# The names of the checks.
CHECKS = (
    "chunk_embedding_pairing", "dimension_consistency", "sequence_continuity", "chunk_text_availability",
    "contextualized_text_availability", "token_count_consistency", "model_consistency",
)


def first_of(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """The row with the smallest key for each place."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where("__n = 1").drop("__n")


def pairs(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Full outer pairing by place, one row for each side and place. Chunk and embedding are structs, null where missing."""
    c = first_of(chunks, KEY).select(*KEY, F.struct("id", "text", "text_storage_key", "contextualized_text", "contextualized_text_storage_key", "token_count").alias("chunk"))
    e = first_of(embeddings, KEY).select(*KEY, F.struct("id", "chunk_id", "model", "dimensions", "token_count", F.size("embedding").alias("size"), F.slice("embedding", 1, 5).alias("preview")).alias("embedding"))
    return c.join(e, KEY, "full_outer")


def _where(condition: Column) -> Column:
    """Sorted places for which a condition holds."""
    return F.array_sort(F.collect_list(F.when(condition, F.col("sequence_index"))))


def with_files(paired: DataFrame, files: DataFrame) -> DataFrame:
    """Adds text_there and context_there: whether the file of an offloaded text is among ``files`` (storage_key)."""
    for name, key in (("text_there", "text_storage_key"), ("context_there", "contextualized_text_storage_key")):
        have = files.select(F.col("storage_key").alias("__key")).distinct().withColumn("__there", F.lit(True))
        own = F.col("chunk")[key]
        # rows without a key, most of all, would meet in one task: each goes by its place instead
        paired = paired.withColumn("__own", F.coalesce(own, F.concat_ws("/", F.lit("\0"), *[F.col(c).cast("string") for c in KEY])))
        paired = paired.join(have, F.col("__own") == F.col("__key"), "left").withColumn(name, own.isNotNull() & F.coalesce("__there", F.lit(False))).drop("__own", "__key", "__there")
    return paired


def checks(paired: DataFrame, expected: Column, readable: Column | None = None, context_readable: Column | None = None) -> DataFrame:
    """One row for each document and check: passed, offenders (places, sorted), counts used by messages.

    ``expected`` is the dimension that the document's job declares; ``readable`` and ``context_readable`` say whether an offloaded text was read. Without
    them, the pairs' columns of ``with_files`` say so, and where there are none either, files are taken to be there."""
    known = lambda given, name: given if given is not None else F.col(name) if name in paired.columns else F.lit(True)
    context_readable = known(readable if context_readable is None else context_readable, "context_there")
    readable = known(readable, "text_there")
    c, e = F.col("chunk"), F.col("embedding")
    source = text_source(c["text"], c["text_storage_key"])
    context = text_source(c["contextualized_text"], c["contextualized_text_storage_key"])
    has_context = c["contextualized_text"].isNotNull() | c["contextualized_text_storage_key"].isNotNull()
    got = lambda s, read: (s == "inline") | ((s == "file") & read)
    bad_size = e.isNotNull() & ((e["dimensions"] != expected) | (e["size"] != expected))
    one = paired.groupBy("parsed_document_id").agg(
        F.count("*").alias("n_pairs"),
        _where(c.isNull() & e.isNotNull()).alias("orphan_embeddings"),
        _where(e.isNull() & c.isNotNull()).alias("orphan_chunks"),
        _where(bad_size).alias("bad_size"),
        F.array_sort(F.collect_set("sequence_index")).alias("places"),
        _where(c.isNotNull() & ~got(source, readable)).alias("no_text"),
        _where(c.isNotNull() & ~got(context, context_readable) & has_context).alias("no_context"),
        _where((c.isNotNull() & F.coalesce(c["token_count"] == 0, F.lit(True))) | (e.isNotNull() & F.coalesce(e["token_count"] == 0, F.lit(True)))).alias("bad_tokens"),
        F.array_sort(F.collect_set(e["model"])).alias("models"),
    )
    # a gap is missing from the span of the places themselves, not from 0
    span = F.sequence(F.array_min("places"), F.array_max("places"))
    one = one.withColumn("gaps", F.array_except(span, "places"))
    none = F.array().cast("array<int>")
    rows = [
        (CHECKS[0], (F.size("orphan_embeddings") == 0) & (F.size("orphan_chunks") == 0), F.array_sort(F.concat("orphan_embeddings", "orphan_chunks"))),
        (CHECKS[1], F.size("bad_size") == 0, F.col("bad_size")),
        (CHECKS[2], F.size("gaps") == 0, F.col("gaps")),
        (CHECKS[3], F.size("no_text") == 0, F.col("no_text")),
        (CHECKS[4], F.size("no_context") == 0, F.col("no_context")),
        (CHECKS[5], F.size("bad_tokens") == 0, F.array_distinct("bad_tokens")),
        (CHECKS[6], F.size("models") <= 1, none),
    ]
    found = F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), F.size(o).cast("long").alias("n_offenders"), o.alias("offenders")) for n, p, o in rows])
    return one.withColumn("__c", F.explode(found)).select("parsed_document_id", "n_pairs", "__c.*")


def preview(offenders: Column, n: int = 5) -> Column:
    """The first offenders, with an ellipsis if there are more."""
    return F.concat(F.array_join(F.slice(offenders, 1, n).cast("array<string>"), ", "), F.when(F.size(offenders) > n, "...").otherwise(""))


def passed_all(checked: DataFrame) -> DataFrame:
    return checked.groupBy("parsed_document_id").agg(F.bool_and("passed").alias("passed"), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_checks"))


def token_offenders(paired: DataFrame) -> DataFrame:
    """Four offender counts and their message; classes without offenders are left out."""
    c, e = F.col("chunk"), F.col("embedding")
    counts = {
        "null_chunks": c.isNotNull() & c["token_count"].isNull(), "null_embeddings": e.isNotNull() & e["token_count"].isNull(),
        "zero_chunks": F.coalesce(c["token_count"] == 0, F.lit(False)), "zero_embeddings": F.coalesce(e["token_count"] == 0, F.lit(False))}
    out = paired.groupBy("parsed_document_id").agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    return out.withColumn("message", F.concat_ws("; ", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k} "), F.col(k).cast("string"))) for k in counts]))


def stats(paired: DataFrame) -> DataFrame:
    c = F.col("chunk")
    source = F.when(c.isNotNull(), text_source(c["text"], c["text_storage_key"]))
    return paired.groupBy("parsed_document_id").agg(
        F.count("*").alias("total_pairs"),
        F.sum(F.coalesce(c["token_count"], F.lit(0))).alias("chunk_tokens"),
        F.sum(F.coalesce(F.col("embedding")["token_count"], F.lit(0))).alias("embedding_tokens"),
        F.count_if(source == "inline").alias("inline_texts"),
        F.count_if(source == "file").alias("file_texts"),
    )


def pair_rows(paired: DataFrame, length: int = 150) -> DataFrame:
    """Pairs with a cut text (null if empty) and the first components (empty if there is no vector)."""
    c, e = F.col("chunk"), F.col("embedding")
    text = F.nullif(c["text"], F.lit(""))
    return paired.select(
        *KEY, c["id"].alias("chunk_id"), F.substring(text, 1, length).alias("text_preview"),
        F.when(c.isNotNull(), text_source(c["text"], c["text_storage_key"])).alias("text_source"),
        e["id"].alias("embedding_id"), F.coalesce(e["preview"], F.array().cast("array<float>")).alias("vector_preview"))


def report(paired: DataFrame, checked: DataFrame, documents: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """One nested row for each document: verification, pairs and totals, and, where they are given, the document (id, title, original_filename,
    content_type, byte_size) and its pipeline (parsed_document_id, parse_job, chunk_job, embedding_job)."""
    order = {name: i for i, name in enumerate(CHECKS)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("check"))
    listed = checked.groupBy("parsed_document_id").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "check", "passed", "n_offenders", preview(F.col("offenders")).alias("offenders")))).alias("__c"),
        F.bool_and("passed").alias("__p"), F.count_if("passed").alias("__n"), F.count("*").alias("__t"))
    rows = pair_rows(paired)
    every = rows.groupBy("parsed_document_id").agg(F.array_sort(F.collect_list(F.struct("sequence_index", *[c for c in rows.columns if c not in KEY]))).alias("pairs"))
    total = stats(paired)
    out = listed.join(every, "parsed_document_id").join(total.select("parsed_document_id", F.struct(*total.columns[1:]).alias("stats")), "parsed_document_id")
    verification = F.struct(F.col("__p").alias("passed"), F.col("__t").alias("total_checks"), F.col("__n").alias("passed_checks"), F.transform("__c", lambda x: x.dropFields("place")).alias("checks"))
    parts = ["parsed_document_id", verification.alias("verification"), "pairs", "stats"]
    if documents is not None:
        d = documents.select(F.col("id").alias("parsed_document_id"), F.struct("title", "original_filename", "content_type", "byte_size").alias("document"))
        out, parts = out.join(d, "parsed_document_id"), [*parts, "document"]
    if stages is not None:
        s = stages.select("parsed_document_id", F.struct("parse_job", "chunk_job", "embedding_job").alias("pipeline"))
        out, parts = out.join(s, "parsed_document_id"), [*parts, "pipeline"]
    return out.select(*parts)
