"""The engine's queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions import keys, labels, vectors
from quillstack.functions import text as t
from quillstack import schema, settings
from quillstack.operators import catalog, chat, chunk, convo, embed, flow, ingest, jobs, logs, search, structure, verify
from quillstack.shipping import ensure_on_workers
from quillstack.sources import fixtures as fx
from quillstack.sources import sinks
from quillstack.sources.files import binary, shared_folder
from quillstack.sources.files import texts as file_texts
from quillstack.streaming import logs as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALLOWED_TYPES = [t.PDF, t.DOCX, t.PPTX, t.MARKDOWN, t.PLAIN]
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".pptx", ".md", ".markdown", ".txt"]
INLINE_LIMIT = 360
JOB = "job-1"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The mean of vectors 7 and 11."""
    rows = fx.table(spark, d, "embeddings").where(F.col("vec_id").isin(7, 11)).orderBy("vec_id").collect()
    return [(float(a) + float(b)) / 2 for a, b in zip(rows[0].embedding, rows[1].embedding)]


def hits(spark: SparkSession, d: str, k: int = 20, max_distance: float = 0.9, max_best: float = 0.8) -> DataFrame:
    return search.search(fx.embeddings(spark, d), fx.chunks(spark, d), fx.parsed_documents(spark, d), fx.uploads(spark, d), query_vector(spark, d), k, max_distance, max_best)


# search


@query
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    top = search.top_k(fx.table(spark, d, "embeddings"), query_vector(spark, d), 5, "vec_id")
    return top.select("vec_id", F.round("score", 6).alias("score"))


@query
def search_topk_many(spark: SparkSession, d: str) -> DataFrame:
    """The nearest three to every fiftieth vector."""
    e = fx.table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.top_k_many(e, queries, 3, "vec_id").select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def search_threshold_after_limit(spark: SparkSession, d: str) -> DataFrame:
    top = search.top_k(fx.table(spark, d, "embeddings"), query_vector(spark, d), 5, "vec_id")
    return search.within(top, 0.5, 0.4).select("vec_id", F.round("score", 6).alias("score"))


@query
def search_best_score_gate(spark: SparkSession, d: str) -> DataFrame:
    top = search.top_k(fx.table(spark, d, "embeddings"), query_vector(spark, d), 5, "vec_id")
    return search.within(top, 0, 0.2).select("vec_id", F.round("score", 6).alias("score"))


@query
def search_results(spark: SparkSession, d: str) -> DataFrame:
    return search.results(hits(spark, d))


@query
def search_result_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.statistics(hits(spark, d), fx.embeddings(spark, d))


@query
def search_doc_groups(spark: SparkSession, d: str) -> DataFrame:
    g = search.grouped(hits(spark, d))
    return g.select("document_name", "first_rank", "n_results", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


@query
def search_score_bars(spark: SparkSession, d: str) -> DataFrame:
    return search.score_bars(hits(spark, d))


@query
def search_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return search.histogram(hits(spark, d))


@query
def search_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).withColumn("page_numbers", F.array((F.col("sequence_index") + 1)))
    return search.prompt(rows, "What is said?")


@query
def search_self_distance(spark: SparkSession, d: str) -> DataFrame:
    """The nearest three to one stored vector."""
    e = fx.table(spark, d, "embeddings")
    sample = list(e.where("vec_id = 3").first().embedding)
    return search.top_k(e, sample, 3, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


# vectors


@query
def vector_profile(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.size(v).cast("int").alias("dims"), F.round(F.sqrt(vectors.dot(v, v)), 5).alias("norm"), vectors.preview_text(v).alias("preview"))


@query
def vector_backfill(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("j"))
    out = embed.backfilled(e, "j", 64)
    return out.groupBy("sound").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("n_null"))


@query
def vector_invalid(spark: SparkSession, d: str) -> DataFrame:
    return embed.invalid(fx.embeddings(spark, d)).select("id", "dimensions", F.size("embedding").cast("int").alias("size"))


# verification


def paired(spark: SparkSession, d: str) -> DataFrame:
    stored = chunk.hybrid_storage(fx.chunks(spark, d), INLINE_LIMIT, F.lit(JOB))
    return verify.pairs(stored, fx.embeddings(spark, d))


@query
def verify_pairing(spark: SparkSession, d: str) -> DataFrame:
    p = paired(spark, d)
    return p.select("parsed_document_id", "sequence_index", F.col("chunk").isNull().alias("orphan_embedding"), F.col("embedding").isNull().alias("orphan_chunk"))


@query
def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    c = verify.checks(paired(spark, d), F.lit(64))
    return c.select("parsed_document_id", "n_pairs", "check", "passed", "n_offenders", verify.preview(F.col("offenders")).alias("offenders"))


@query
def verify_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verify.passed_all(verify.checks(paired(spark, d), F.lit(64)))


@query
def verify_token_offenders(spark: SparkSession, d: str) -> DataFrame:
    return verify.token_offenders(paired(spark, d))


@query
def verify_stats(spark: SparkSession, d: str) -> DataFrame:
    return verify.stats(paired(spark, d))


@query
def verify_pairs_preview(spark: SparkSession, d: str) -> DataFrame:
    p = verify.pair_rows(paired(spark, d))
    return p.withColumn("vector_preview", F.size("vector_preview").cast("int"))


# chunks and segments


@query
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d)
    return c.select("id", "parsed_document_id", "sequence_index", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query
def chunk_hybrid_storage(spark: SparkSession, d: str) -> DataFrame:
    c = chunk.hybrid_storage(fx.chunks(spark, d), INLINE_LIMIT, F.lit(JOB))
    return c.select("id", "text_storage_key", "contextualized_text_storage_key", "text_bytes", F.length("text").cast("int").alias("inline_chars"), chunk.text_source(F.col("text"), F.col("text_storage_key")).alias("source"))


@query
def chunk_resolved_text(spark: SparkSession, d: str) -> DataFrame:
    all_ = fx.chunks(spark, d)
    stored = chunk.hybrid_storage(all_, INLINE_LIMIT, F.lit(JOB))
    key = keys.chunk_key(F.col("owner_user_id"), F.col("parsed_document_id"), F.lit(JOB), F.col("sequence_index"), "text")
    files = all_.where("id % 3 <> 0").select(key.alias("storage_key"), F.col("text").alias("content"))
    r = chunk.resolve_text(stored, files)
    return r.select("id", "text_source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def chunk_token_stats(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d)
    return c.groupBy("owner_user_id").agg(F.count("*").alias("n_chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"), F.max("token_count").alias("most"), F.count_if(F.col("token_count").isNull()).alias("n_null"))


@query
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Headings, page lists and metadata in their normal forms."""
    c = fx.table(spark, d, "documents")
    pages = F.array(F.array((F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 2).cast("int")), F.array(F.lit(1), F.when(F.col("doc_id") % 4 == 0, 5)))
    pages = F.when(F.col("doc_id") % 7 != 0, pages).otherwise(F.array().cast("array<array<int>>"))
    meta = chunk.merge_metadata(F.create_map(F.lit("lang"), "lang", F.lit("kind"), F.lit("origin")), F.create_map(F.lit("kind"), F.lit("model"), F.lit("source"), "source"))
    heads = chunk.normalise_headings(F.filter(F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source"))), lambda x: x.isNotNull() & (x != "en")))
    return c.select(
        "doc_id", F.array_join(chunk.page_numbers(pages).cast("array<string>"), ",").alias("pages"), F.array_join(heads, " > ").alias("headings"),
        F.array_join(F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("meta"))


@query
def segment_counts_per_document(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.parsed_documents(spark, d)
    out = catalog.with_counts(docs, fx.segments(spark, d).where(t.strip(F.col("text")) != ""), "parsed_document_id", "n_segments")
    return out.select("id", "n_segments")


@query
def segments_page(spark: SparkSession, d: str) -> DataFrame:
    s = fx.segments(spark, d).where("parsed_document_id = 3")
    return catalog.page(s, ["sequence_index"], 5, 2).select("parsed_document_id", "sequence_index", "text")


@query
def noise_chunks(spark: SparkSession, d: str) -> DataFrame:
    texts = ["", "   ", "\t\n", "[TOC]", "[toc]", "[TOC] [TOC]", "[目录]", "[[TOC]]", "[toc] [TOC][目录]", "[Toc]", "[Toc] [Toc]", "[Toc]  [Toc]", "　", "words", "[TOC] words", None]
    fixed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select((-F.col("id") - 1).alias("id"), "text")
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fixed.unionByName(docs).select("id", t.is_noise(F.col("text")).alias("is_noise"))


# embedding


@query
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    b = embed.batched(fx.chunks(spark, d), 10)
    return b.groupBy("parsed_document_id", "batch").agg(F.count("*").alias("n"), F.max("position").alias("last"))


@query
def embed_token_apportion(spark: SparkSession, d: str) -> DataFrame:
    b = embed.batched(fx.chunks(spark, d), 10)
    a = embed.apportioned(b, F.col("parsed_document_id") + 17, ["parsed_document_id", "batch"])
    return a.select("id", "batch", "position", "token_share")


@query
def embed_zip_strict(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose result counts differ from their chunk counts."""
    results = fx.embeddings(spark, d).select("parsed_document_id", (F.col("id") % 3).cast("int").alias("index"), "embedding")
    z = embed.zipped(fx.chunks(spark, d), results)
    return z.groupBy("parsed_document_id").agg(F.count("*").alias("n"), F.max("error_code").alias("error_code"))


@query
def embed_hash_udf(spark: SparkSession, d: str) -> DataFrame:
    c = embed.embedded(fx.chunks(spark, d), embed.HashEmbedder(), t.first_nonempty(F.col("contextualized_text"), F.col("text")))
    v = F.col("embedding")
    return c.select("id", F.size(v).alias("dims"), F.round(F.sqrt(vectors.dot(v, v)), 4).alias("norm"))


@query
def embed_retry_rules(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 400, 429, 500, 503, 599, 600)]), (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 5 == 0, "timeout").when(F.col("event_id") % 5 == 1, "connection").otherwise("http")
    attempt = (F.col("event_id") % 4).cast("int")
    header = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))
    return e.select("event_id", embed.retried(status, kind, attempt, 3).alias("again"), embed.retry_delay(header, attempt.cast("double"), F.lit(0.5)).alias("delay"))


# uploads


@query
def upload_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest(fx.uploads(spark, d))


@query
def upload_rejections(spark: SparkSession, d: str) -> DataFrame:
    u = fx.uploads(spark, d).withColumn("reason", ingest.rejection(ALLOWED_TYPES, ALLOWED_EXTENSIONS, 20_000))
    return u.select("id", F.coalesce("reason", F.lit("admitted")).alias("reason"))


#: File names with odd extensions; ``upload_names`` has them behind each document's source.
NAMES = ["a.txt", ".bashrc", "x.", "a.b.PDF", "dir/x.tar.gz", "no", "", None, "x.é1", "x.a-b", "x.aaaaaaaaaaaaaaaa", "a/.b.c", "..a", "x. y", "trail.txt/"]


@query
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("doc_id")
    folder = fx.pick(["", "a/", "d.x/"], F.floor(id_ / len(NAMES)))
    n = fx.table(spark, d, "documents").select(id_.alias("id"), F.concat(folder, F.when(id_ % 2 == 0, F.col("source")).otherwise(""), fx.pick(NAMES, id_)).alias("name"))
    return n.select("id", t.extension(F.col("name")).alias("ext"), t.safe_extension(F.col("name")).alias("safe"), t.initials(F.coalesce("name", F.lit(""))).alias("initials"))


@query
def storage_key_guard(spark: SparkSession, d: str) -> DataFrame:
    made = ["", ".", "..", "a/../b", "a//b", "./a", "/a", "a/..b", None, "uploads/u/1/original.txt"]
    k = spark.createDataFrame(list(enumerate(made)), "id long, key string").select((-F.col("id") - 1).alias("id"), "key")
    own = ingest.manifest(fx.uploads(spark, d)).select("id", F.col("storage_key").alias("key"))
    return k.unionByName(own).select("id", t.safe_path(F.col("key")).alias("is_safe"))


@query
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 40 == 0, " \n").otherwise(F.col("text")).alias("text"))
    p = ingest.parsed(fx.uploads(spark, d), texts)
    return p.select("id", "error_code", F.size("segments").cast("int").alias("n_segments"), F.sha2("markdown", 256).alias("sha256"))


@query
def file_sniffing(spark: SparkSession, d: str) -> DataFrame:
    text = F.encode(F.col("text"), "UTF-8")
    docs = fx.table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(b"%PDF-1.4"), text)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(b"PK\x03\x04"), text)).when(F.col("doc_id") % 4 == 2, F.concat(text, F.lit(b"\x00"))).otherwise(text)
    return ingest.sniffed(docs.select("doc_id", content.alias("content"))).groupBy("kind").agg(F.count("*").alias("n"))


# jobs


@query
def jobs_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest(fx.jobs(spark, d)).select("parent_id", "id", "status", t.utc_iso(F.col("created_at")).alias("created"))


@query
def jobs_active(spark: SparkSession, d: str) -> DataFrame:
    return jobs.active(fx.jobs(spark, d)).select("parent_id", "id", "declared_count")


@query
def jobs_supersede(spark: SparkSession, d: str) -> DataFrame:
    return jobs.superseded(fx.jobs(spark, d)).select("id", "parent_id", "status")


@query
def jobs_supersede_siblings(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.supersede_siblings(fx.jobs(spark, d), F.lit(7), F.lit(100))
    return out.groupBy("parent_id", "status").agg(F.count("*").alias("n"))


@query
def jobs_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reconciled(fx.jobs(spark, d), "restarted").select("id", "status", "error_code", "error_message")


@query
def jobs_reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a reconciliation would change, by kind of job."""
    j = fx.jobs(spark, d).withColumn("kind", fx.pick(["parse", "chunk", "embedding"], F.col("id")))
    return j.groupBy("kind").agg(F.count_if(F.col("status").isin(*jobs.OPEN)).alias("n_changed"), F.count("*").alias("n_jobs"))


@query
def jobs_conflicts(spark: SparkSession, d: str) -> DataFrame:
    j = fx.shared_jobs(spark, d)
    return jobs.conflicts(j.select("parent_id").distinct(), j)


@query
def jobs_admissible(spark: SparkSession, d: str) -> DataFrame:
    j = fx.shared_jobs(spark, d)
    return jobs.admissible(j.select("parent_id").distinct(), j)


@query
def jobs_fold(spark: SparkSession, d: str) -> DataFrame:
    f = jobs.folded(fx.jobs(spark, d))
    return f.select("parent_id", "status", "attempt_count", t.utc_iso(F.col("started_at")).alias("started"), t.utc_iso(F.col("finished_at")).alias("finished"), "count")


@query
def jobs_status_report(spark: SparkSession, d: str) -> DataFrame:
    return jobs.by_status(fx.jobs(spark, d)).select("status", "n_jobs", t.utc_iso(F.col("newest")).alias("newest"))


@query
def jobs_declared_counts(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.table(spark, d, "events").select(F.col("user_id").alias("parent_id"))
    return jobs.declared_against_stored(jobs.active(fx.jobs(spark, d)), stored)


@query
def jobs_stale(spark: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(spark, d)
    return jobs.stale(j.where("id % 2 = 0"), j.where("id % 2 = 1")).select("parent_id", "chunk_job", "embedding_job")


@query
def jobs_history(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rank_in_parent(fx.jobs(spark, d)).where("age <= 3").select("parent_id", "age", "id", "status")


@query
def jobs_create(spark: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(spark, d)
    new = jobs.queued(j.select("parent_id").distinct(), {"max_tokens": 512, "api_key": "hidden"}, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return new.select("parent_id", "status", "config_json", "count", "attempt_count")


# catalogue


@query
def documents_list(spark: SparkSession, d: str) -> DataFrame:
    docs = catalog.with_counts(fx.parsed_documents(spark, d), fx.segments(spark, d), "parsed_document_id", "n_segments")
    return docs.select("id", "owner_user_id", "title", "n_segments", t.utc_iso(F.col("created_at")).alias("created"))


@query
def documents_page(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.documents_page(fx.parsed_documents(spark, d), fx.segments(spark, d), "parsed_document_id", "n_segments", 20, 40)
    return p.select("id", "title", "n_segments")


@query
def chunks_page(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d).where("parsed_document_id = 4")
    return catalog.page(c, ["sequence_index"], 1000, -3).select("id", "sequence_index", "token_count")


@query
def uploads_live(spark: SparkSession, d: str) -> DataFrame:
    u = catalog.live(fx.uploads(spark, d), stored_only=True)
    return u.groupBy("owner_user_id").agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


@query
def upload_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.owned(fx.uploads(spark, d), 5, "src5").select("id", "owner_user_id", "original_filename")


@query
def documents_with_file(spark: SparkSession, d: str) -> DataFrame:
    u = ingest.manifest(fx.uploads(spark, d))
    files = u.where("id % 3 = 0").select("storage_key")
    return catalog.available(fx.parsed_documents(spark, d), u, files).select("id", "uploaded_file_id")


@query
def documents_with_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their parse job, which may be missing."""
    docs = fx.parsed_documents(spark, d)
    j = fx.jobs(spark, d).select(F.col("id").alias("parse_job_id"), F.col("status").alias("job_status"))
    return docs.join(j, "parse_job_id", "left").select("id", "parse_job_id", F.coalesce("job_status", F.lit("missing")).alias("job_status"))


@query
def active_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of documents whose newest job succeeded."""
    a = jobs.active(fx.jobs(spark, d)).select(F.col("parent_id").alias("parsed_document_id"), F.col("id").alias("job_id"))
    return fx.embeddings(spark, d).join(a, "parsed_document_id").select("id", "parsed_document_id", "job_id", "model")


# conversations


@query
def conversation_titles(spark: SparkSession, d: str) -> DataFrame:
    return convo.titles(fx.table(spark, d, "conversations"))


#: Openings of questions; ``title_prefixes`` puts them before each turn.
OPENINGS = ["请帮我总结这篇文章。", "如何 使用  它？？", "帮我请解释", "什么是向量数据库", "我想知道天气", "想知道我要查", "关于合同", "请搜索合同", "告诉我答案！", "  ", "？？", "What is this, exactly: a very long question", "为什么", "能不能你来", "😀😀 question"]


@query
def title_prefixes(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "conversations")
    text = F.concat(fx.pick(OPENINGS, F.col("conv_id") + F.col("turn")), F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise(""))
    return m.select("conv_id", "turn", t.title(text).alias("title"))


@query
def conversation_fold(spark: SparkSession, d: str) -> DataFrame:
    f = convo.folded(fx.table(spark, d, "conversations"))
    return f.select("conv_id", F.sha2(F.coalesce("first_question", F.lit("")), 256).alias("first_sha"), F.sha2(F.coalesce("last_answer", F.lit("")), 256).alias("last_sha"), "n_messages", "n_chars")


@query
def conversation_history(spark: SparkSession, d: str) -> DataFrame:
    return convo.history(convo.titles(fx.table(spark, d, "conversations")), 5)


@query
def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """State written as JSON, damaged in places, read again, one conversation renamed and one deleted."""
    m = fx.table(spark, d, "conversations")
    msg = F.struct(F.col("turn").cast("string").alias("id"), "role", F.col("text").alias("content"), F.lit("t").alias("createdAt"))
    one = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(msg)).alias("messages"))
    talk = F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("old").alias("title"), "messages")
    blob = F.to_json(F.struct(F.array(talk).alias("conversations"), F.col("conv_id").cast("string").alias("activeConversationId")))
    blobs = one.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 10 == 3, "{broken").when(F.col("conv_id") % 10 == 4, '{"conversations":7}').otherwise(blob).alias("value"))
    s = convo.deleted(convo.renamed(convo.load_state(blobs), "1", " new "), "2")
    s = convo.load_state(convo.save_state(s))
    c = F.col("state.conversations")
    return s.select("id", F.size(c).cast("int").alias("n"), F.array_join(F.transform(c, lambda x: x["title"]), ",").alias("titles"), F.col("state.activeConversationId").alias("active"), F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x["messages"]) + F.size(x["bubbles"])), F.lit(0)).alias("n_messages"))


@query
def answer_states(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "conversations")
    error = F.when(F.col("turn") % 3 == 0, convo.DISABLED).when(F.col("turn") % 3 == 1, "timeout")
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    return m.groupBy("role").agg(F.count_if(convo.is_degraded(answer, error)).alias("n_degraded"), F.count("*").alias("n"))


@query
def prompt_char_totals(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "conversations")
    part = F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))
    content = convo.content_text(F.array(part, F.struct(F.lit("x").alias("text"))), F.when(F.col("turn") % 5 == 0, F.col("text")))
    return m.groupBy("conv_id").agg(F.sum(F.length(content)).alias("n_chars"))


# logs


@query
def log_level_filter(spark: SparkSession, d: str) -> DataFrame:
    return logs.at_least(fx.log_records(spark, d), "info").groupBy("level").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query
def log_ring_last_n(spark: SparkSession, d: str) -> DataFrame:
    return logs.ring(fx.log_records(spark, d), 500).select("id", "level", "message")


@query
def log_flush_batches(spark: SparkSession, d: str) -> DataFrame:
    b = logs.flush_batches(fx.log_records(spark, d))
    return b.select("batch", "n_records", "bytes", t.utc_iso(F.col("created_at")).alias("created"), "first_id")


@query
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(logs.flush_batches(fx.log_records(spark, d)), 60_000).select("batch", "bytes", "suffix_bytes")


@query
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.formatted(fx.log_records(spark, d)).select("id", "line")


@query
def log_read_order(spark: SparkSession, d: str) -> DataFrame:
    n = logs.numbered(fx.log_records(spark, d))
    return n.select("id", "number")


@query
def log_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream of updates over the events file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    records = raw.select("ts", fx.mapped("event_type", fx.LEVELS).alias("level"), F.octet_length("props").cast("long").alias("bytes"))
    out = stream.drain(stream.counts(records), "log-counts", ["start", "level"])
    return out.select(t.utc_iso(F.col("start")).alias("start"), "level", "n_records", "bytes")


# pages


@query
def parse_html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph segments of pages, tags removed, numbered from 0."""
    p = fx.table(spark, d, "pages")
    s = p.select("page_id", F.posexplode(ingest.paragraphs(F.col("html"))).alias("sequence_index", "text"))
    return s.select("page_id", "sequence_index", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


# scalars


@query
def scalar_labels(spark: SparkSession, d: str) -> DataFrame:
    u = fx.uploads(spark, d)
    return u.select(
        "id", t.file_size(F.col("byte_size") * (F.col("id") + 1) * 37).alias("size"), t.duration(F.col("id") * 7).alias("took"),
        convo.timestamp_title(F.col("created_at")).alias("stamp"), F.array_join(t.csv_list(F.concat_ws(",", F.lit(" a "), "owner_user_id", F.lit(""), F.lit("b"))), "|").alias("csv"),
        t.mask_password(F.concat(F.lit("db://user:pw"), F.col("id").cast("string"), F.lit("@host/x"))).alias("url"), t.cut(F.col("checksum_sha256"), 18, "…").alias("short"))


@query
def duplicate_places(spark: SparkSession, d: str) -> DataFrame:
    """Places with more than one row before the first wins."""
    s = fx.segments(spark, d).select("parsed_document_id", (F.col("sequence_index") % 7).alias("sequence_index"))
    return s.groupBy("parsed_document_id", "sequence_index").agg(F.count("*").alias("n")).where("n > 1")


# answers, readiness, schema and whole flows


@query
def chat_responses(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "conversations")
    body = F.to_json(F.struct(F.when(F.col("turn") % 3 > 0, F.lit("m-1")).alias("model"), F.when(F.col("turn") % 5 > 0, F.array(F.struct(F.struct("role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("content")).alias("message")))).alias("choices"), F.when(F.col("turn") % 4 > 0, F.struct(F.col("turn").alias("prompt_tokens"))).alias("usage")))
    raw = m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") == 7, "<html>").otherwise(body).alias("body"))
    p = chat.parsed(raw)
    return p.select("id", F.length("content").alias("n_chars"), "model", "prompt_tokens", "total_tokens", "error_code")


@query
def readiness_states(spark: SparkSession, d: str) -> DataFrame:
    """What the states of two components come to, for each event that brings some."""
    names = ["ready", "skipped", "loading", "unavailable", "shutting_down", "odd"]
    id_ = F.col("event_id")
    e = fx.table(spark, d, "events").select(id_.alias("id"), fx.pick(names, id_).alias("a"), fx.pick(names, F.floor(id_ / 6)).alias("b"), (id_ % 72 >= 36).alias("stopping"))
    s = e.withColumn("status", chat.readiness(F.col("a"), F.col("b"), F.col("stopping")))
    return s.select("id", "status", chat.gate(F.col("status")).alias("gate"), chat.gate(F.col("status"), fx.pick(["txt", "pdf"], F.col("id"))).alias("admission"))


@query
def schema_faults(spark: SparkSession, d: str) -> DataFrame:
    """Upload rows with overlong names, and how many."""
    u = fx.uploads(spark, d).withColumn("original_filename", F.when(F.col("id") % 50 == 0, F.repeat(F.lit("x"), 600)).otherwise(F.col("original_filename")))
    return u.select("id", F.array_join(schema.faults(u, job=True), ",").alias("faults"))


@query
def ids_by_time(spark: SparkSession, d: str) -> DataFrame:
    u = fx.uploads(spark, d).select("id", schema.uuid7(F.col("created_at"), F.col("id")).alias("uuid"))
    return u.select("id", F.substring("uuid", 1, 15).alias("head"), F.length("uuid").alias("n"), F.substring("uuid", 20, 1).isin(*"89ab").alias("variant"))


@query
def artifact_keys(spark: SparkSession, d: str) -> DataFrame:
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    p = ingest.parsed(fx.uploads(spark, d), texts).join(fx.uploads(spark, d).select("id", "owner_user_id"), "id")
    a = sinks.artifacts(p.withColumn("uploaded_file_id", F.col("id")).withColumn("parse_job_id", F.lit("j")))
    return a.select("storage_key", F.length("content").alias("n_chars"))


@query
def offloaded_files(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d)
    f = sinks.offloaded(chunk.hybrid_storage(c, INLINE_LIMIT, F.lit(JOB)), c)
    return f.select("storage_key", F.octet_length("content").cast("long").alias("n_bytes"))


@query
def rechunk_all(spark: SparkSession, d: str) -> DataFrame:
    """Two chunking jobs in a row: the second supersedes the first, except where it fails."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("parsed_document_id"), "text", F.array("source").alias("heading_path"))
    later = docs.withColumn("text", F.when(F.col("parsed_document_id") % 9 == 0, " ").otherwise(F.col("text")))
    first = flow.job_rows(docs, flow.rechunked(docs, 64, F.lit("j1")), F.lit("j1"), F.lit("2024-01-01").cast("timestamp"))
    second = flow.job_rows(later, flow.rechunked(later, 32, F.lit("j2")), F.lit("j2"), F.lit("2024-01-02").cast("timestamp"))
    return flow.with_new_jobs(first, second).select("id", "parent_id", "status", "declared_count", "error_code")


@query
def reembed_all(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d)
    e = flow.reembedded(c, embed.HashEmbedder(32), "hash-32", F.lit("e1"))
    return e.groupBy("parsed_document_id", "model", "dimensions").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 32).alias("n_wrong"))


@query
def runnable_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.runnable(fx.jobs(spark, d)).select("parent_id", "id")


@query
def fail_one_job(spark: SparkSession, d: str) -> DataFrame:
    j = jobs.failed(fx.jobs(spark, d), F.lit(8), "process_shutdown", "stopped")
    return j.groupBy("status", "error_code").agg(F.count("*").alias("n"))


# files, structure, settings and responses


def marked_segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown segments, a page each of eight lines: every fifth line is a heading of level 1 to 3."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("parsed_document_id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 5).cast("int") % 3), F.lit(" H"), F.floor(i / 5).cast("string"))).otherwise(x)
    docs = docs.withColumn("l", F.transform("l", line))
    at = F.posexplode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 8).cast("int"))).alias("sequence_index", "p")
    return docs.select("parsed_document_id", "l", at).select("parsed_document_id", "sequence_index", (F.col("p") + 1).alias("page_no"), F.array_join(F.slice("l", F.col("p") * 8 + 1, F.lit(8)), "\n").alias("text"))


@query
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within one heading path, 24 tokens at most, with their pages."""
    c = structure.section_chunks(marked_segments(spark, d), 24)
    listed = lambda n: F.array_join(F.col(n).cast("array<string>"), ",").alias(n)
    return c.select("parsed_document_id", "sequence_index", "token_count", F.array_join("heading_path", " > ").alias("heading_path"), listed("page_numbers"), listed("source_segment_indices"), F.sha2("contextualized_text", 256).alias("sha256"))


@query
def verify_checks_with_files(spark: SparkSession, d: str) -> DataFrame:
    """The checks where the files of every third chunk have been deleted."""
    all_ = fx.chunks(spark, d)
    files = sinks.offloaded(chunk.hybrid_storage(all_, INLINE_LIMIT, F.lit(JOB)).where("id % 3 <> 0"), all_).select("storage_key")
    c = verify.checks(verify.with_files(paired(spark, d), files), F.lit(64))
    return c.select("parsed_document_id", "check", "passed", "n_offenders", verify.preview(F.col("offenders")).alias("offenders"))


@query
def verify_report(spark: SparkSession, d: str) -> DataFrame:
    """The nested report, flattened to be compared."""
    p = paired(spark, d)
    u = fx.uploads(spark, d)
    docs = fx.parsed_documents(spark, d).select("id", "title", "uploaded_file_id").join(u.select(F.col("id").alias("uploaded_file_id"), "original_filename", "content_type", "byte_size"), "uploaded_file_id")
    j = fx.jobs(spark, d)
    newest = jobs.active(j).select(F.col("parent_id").alias("parsed_document_id"), F.struct("id", "declared_count").alias("embedding_job"))
    stages = fx.parsed_documents(spark, d).select(F.col("id").alias("parsed_document_id"), F.col("parse_job_id").alias("parse_job")).withColumn("chunk_job", F.lit(JOB)).join(newest, "parsed_document_id", "left")
    r = verify.report(p, verify.checks(p, F.lit(64)), docs, stages)
    v = F.col("verification")
    return r.select(
        "parsed_document_id", "document.title", "document.original_filename", "document.byte_size", "pipeline.parse_job", "pipeline.chunk_job", F.col("pipeline.embedding_job.id").alias("embedding_job"),
        v["passed"].alias("passed"), v["total_checks"].alias("total_checks"), v["passed_checks"].alias("passed_checks"), F.array_join(F.transform(v["checks"], lambda x: F.concat(x["check"], F.lit("="), x["passed"].cast("string"))), ";").alias("checks"),
        F.size("pairs").cast("int").alias("n_pairs"), F.array_join(F.transform(F.slice("pairs", 1, 5), lambda x: x["sequence_index"].cast("string")), ",").alias("first_places"), "stats.chunk_tokens", "stats.embedding_tokens")


@query
def search_response(spark: SparkSession, d: str) -> DataFrame:
    r = search.response(hits(spark, d), fx.embeddings(spark, d), "What is said?", query_vector(spark, d), "model-a", 20)
    preview = F.array_join(F.transform("query_embedding_preview", lambda x: F.format_string("%.5f", x)), ",")
    ranks = F.array_join(F.transform("results", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["chunk_id"].cast("string"))), ",")
    return r.select("query", preview.alias("preview"), "embedding_model", "embedding_dimensions", "top_k", "total_searched", "searched_document_count", ranks.alias("results"))


@query
def chunks_page_total(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d).where("parsed_document_id = 4")
    return catalog.paged(c, ["sequence_index"], 2, 1).select("id", "sequence_index", "total")


@query
def chunk_read_rows(spark: SparkSession, d: str) -> DataFrame:
    stored = chunk.hybrid_storage(fx.chunks(spark, d), INLINE_LIMIT, F.lit(JOB))
    r = catalog.chunk_read(stored)
    return r.select("id", "text_source", F.length("text").cast("int").alias("n_chars"), F.lit(any(c.endswith("storage_key") for c in r.columns)).alias("shows_keys"))


@query
def document_read_rows(spark: SparkSession, d: str) -> DataFrame:
    r = catalog.document_read(fx.parsed_documents(spark, d), fx.uploads(spark, d))
    return r.select("id", "title", "uploaded_file.original_filename", "uploaded_file.byte_size", "uploaded_file.status", F.lit("text" in r.columns).alias("shows_text"))


@query
def embedding_read_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.embedding_read(embed.dual(fx.embeddings(spark, d)))


@query
def embed_dual(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON and read again are the vectors."""
    e = embed.dual(fx.embeddings(spark, d)).withColumn("again", vectors.from_json(F.col("embedding_json")))
    return e.select("id", F.size("embedding").cast("int").alias("dims"), (F.col("again") == F.col("embedding")).alias("same"))


@query
def reembed_supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Two embedding jobs for all chunks: the second supersedes the first, except where it left vectors out."""
    c = fx.chunks(spark, d)
    counts = c.groupBy(F.col("parsed_document_id").alias("parent_id")).agg(F.count("*").alias("n"))
    vectors_ = flow.reembedded(c, embed.HashEmbedder(8), "hash-8", F.lit("e1"))
    partial = vectors_.withColumn("embedding", F.when((F.col("parsed_document_id") % 7 != 0) | (F.col("sequence_index") > 0), F.col("embedding")))
    first = flow.embedding_jobs(counts, vectors_, F.lit("e1"), F.lit("2024-01-01").cast("timestamp"))
    second = flow.embedding_jobs(counts, partial, F.lit("e2"), F.lit("2024-01-02").cast("timestamp"))
    return flow.with_new_jobs(first, second).select("id", "parent_id", "status", "error_code", "declared_count")


@query
def chunk_jobs_with_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Each chunking job (even ids) with the newest succeeded embedding job (odd ids) that names it."""
    j = fx.jobs(spark, d)
    children = j.where("id % 2 = 1").withColumn("chunk_job_id", F.floor(F.col("id") / 6) * 2)
    return jobs.latest_of(j.where("id % 2 = 0").select("id", "status"), children, "chunk_job_id").select("id", "status", "child_id")


@query
def job_self_distance(spark: SparkSession, d: str) -> DataFrame:
    """For each model's vectors, the nearest three to the first of them."""
    e = fx.embeddings(spark, d)
    first = e.groupBy("model").agg(F.min_by("embedding", "id").alias("sample"))  # a row for each job
    scored = e.join(F.broadcast(first), "model").withColumn("score", vectors.cosine_distance(F.col("embedding"), F.col("sample")))
    rank = F.row_number().over(Window.partitionBy("model").orderBy("score", "id"))
    return scored.select("model", rank.alias("rank"), "id", F.round("score", 6).alias("score")).where("rank <= 3")


@query
def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers and their fixed texts where there is nothing to ground them on."""
    m = fx.table(spark, d, "conversations")
    n, model = F.col("turn") % 4, F.when(F.col("conv_id") % 3 > 0, "m-1")
    state = chat.answer_state(F.col("conv_id") % 5, n, model, F.col("text"), F.when(F.col("conv_id") % 7 == 0, "down"))
    s = m.select("conv_id", "turn", state.alias("a"))
    return s.select("conv_id", "turn", "a.status", F.sha2(F.coalesce("a.text", F.lit("")), 256).alias("sha256"), "a.model", "a.error")


@query
def request_faults(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "conversations")
    return m.select("conv_id", "turn", chat.request_fault(F.when(F.col("turn") % 6 != 5, F.col("text")), F.col("conv_id") % 60, F.col("turn") - 1).alias("fault"))


@query
def missing_models(spark: SparkSession, d: str) -> DataFrame:
    """Gates with the models that aren't there."""
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"))
    have = F.filter(F.array(F.when(F.col("id") % 2 == 0, "layout"), F.when(F.col("id") % 4 < 2, "tables"), F.when(F.col("id") % 8 < 4, "extra")), lambda x: x.isNotNull())
    gone = chat.missing_models(F.array(F.lit("tables"), F.lit("layout")), have)
    status = F.when(F.col("id") % 32 >= 24, "loading").when(F.size(gone) > 0, "unavailable").otherwise("ready")
    return e.select("id", F.array_join(gone, ",").alias("missing"), chat.gate_message(status, gone).alias("message"))


@query
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    kind, status = fx.pick(["status", "timeout", "connection"], F.col("event_id")), (F.col("event_id") % 200 + 400).cast("int")
    return e.select("event_id", chat.error_row(kind, status, F.when(F.col("event_id") % 4 > 0, F.col("event_type"))).alias("e")).select("event_id", "e.*")


@query
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(spark, d).select(F.col("status").alias("name"), labels.label(F.col("status"), labels.STATUS).alias("label"), labels.status_colour(F.col("status")).alias("colour"))
    c = spark.createDataFrame([(x,) for x in (*verify.CHECKS, "other")], "name string").select("name", labels.label(F.col("name"), labels.CHECK).alias("label"), F.lit("check").alias("colour"))
    r = fx.table(spark, d, "conversations").select(F.col("role").alias("name"), labels.label(F.col("role"), labels.ROLE).alias("label"), F.lit("role").alias("colour"))
    s = spark.createDataFrame([(x,) for x in ("inline", "file", "unavailable")], "name string").select("name", labels.label(F.col("name"), labels.SOURCE, labels.SOURCE_UNKNOWN).alias("label"), F.lit("source").alias("colour"))
    return j.unionByName(c).unionByName(r).unionByName(s).groupBy("name", "label", "colour").agg(F.count("*").alias("n"))


#: What events name as parameters, of which two are unknown, and odd values.
OVERRIDDEN, ODD_VALUES = ["max_tokens", "inline_bytes", "api_key", "max_tokens", "other"], [None, "many", "", "1e3", " 7 "]


@query
def config_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What each user's job keeps of chunking parameters that events override; nothing else, as a key, is kept."""
    id_ = F.col("event_id")
    value = F.when(id_ % 4 == 0, fx.pick(ODD_VALUES, F.floor(id_ / 4))).otherwise(F.floor("value").cast("long").cast("string"))
    o = fx.table(spark, d, "events").select(F.col("user_id").alias("job_id"), fx.pick(OVERRIDDEN, id_).alias("name"), value.alias("value"), F.col("ts").alias("at"), id_.alias("id"))
    return settings.snapshots(o, settings.CHUNK)


@query
def uploads_written(spark: SparkSession, d: str) -> DataFrame:
    """Uploads appended in two commits, a folder for each status, and read back."""
    path, u = shared_folder(spark, "uploads"), fx.uploads(spark, d)
    sinks.append(u.where("id % 2 = 0"), path, ["status"])
    sinks.append(u.where("id % 2 = 1"), path, ["status"])
    return spark.read.schema(u.schema).parquet(path).select("id", "status", "original_filename", "byte_size", "checksum_sha256")


@query
def parsed_written(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their segments written as two tables that an id ties, and joined again."""
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    p = ingest.parsed(fx.uploads(spark, d), texts).withColumn("uploaded_file_id", F.col("id")).withColumn("parse_job_id", F.lit("j"))
    path = shared_folder(spark, "parsed")
    for name, rows in zip(("documents", "segments"), sinks.documents_and_segments(p)):
        sinks.replace(rows, f"{path}/{name}")
    documents, segments = (spark.read.parquet(f"{path}/{n}") for n in ("documents", "segments"))
    both = documents.select("document_id", "uploaded_file_id").join(segments, F.col("document_id") == F.col("parsed_document_id"))
    return both.select("uploaded_file_id", "sequence_index", "segment_type", "page_no", F.sha2("text", 256).alias("sha256"))


@query
def artifacts_exported(spark: SparkSession, d: str) -> DataFrame:
    """A summary of the documents of each source and language written as a file of its own, scanned as binary files and read as texts under their storage keys."""
    docs = fx.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    name = F.concat(F.coalesce("lang", F.lit("und")), F.lit(".txt"))
    path = shared_folder(spark, "files")
    sinks.write_files(docs.select(F.concat(F.lit("parsed/"), F.coalesce("source", F.lit("none")), F.lit("/"), name).alias("storage_key"), F.concat_ws(" é ", F.col("n").cast("string"), F.col("bytes").cast("string")).alias("content")), path)
    scanned = binary(spark, path, 9).select(F.regexp_extract("path", "(parsed/.*)$", 1).alias("storage_key"), "byte_size", "too_large", "checksum_sha256")
    return scanned.join(file_texts(spark, path).withColumnRenamed("content", "t"), "storage_key").select("storage_key", "byte_size", "too_large", "checksum_sha256", F.length("t").alias("n_chars"))


@query
def active_users(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: who may act."""
    c = fx.table(spark, d, "customer")
    gone = F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-01-01").cast("timestamp"))
    u = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.when(F.col("c_custkey") % 3 == 0, "disabled").otherwise("active").alias("status"), gone.alias("deleted_at"))
    return schema.acting(u).select("id", "display_name")


@query
def default_user(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users with the default user put in where it isn't there; who of them acts under that id, and how many may act in all."""
    at = F.lit("2024-01-01").cast("timestamp")
    c = fx.table(spark, d, "customer")
    u = c.select(F.when(F.col("c_custkey") == 1, schema.DEFAULT_USER).otherwise(F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("display_name"), F.when(F.col("c_custkey") % 3 == 0, "disabled").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), at.alias("created_at"))
    rows = schema.seeded(u, spark, at).unionByName(schema.seeded(u.where("id <> '" + schema.DEFAULT_USER + "'"), spark, at).where(F.col("id") == schema.DEFAULT_USER))
    users = schema.current_user(rows).select("id", "display_name", "status", t.utc_iso(F.col("created_at")).alias("created"))
    n = schema.acting(rows).agg(F.count("*").alias("n_acting"))  # one row
    return users.crossJoin(F.broadcast(n))


@query
def schema_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What tables of the engine lack and have beyond their schema; an upgrade leaves no gap."""
    u, s = fx.uploads(spark, d), fx.segments(spark, d)
    again = schema.gaps(schema.upgraded(s, "document_segments", spark), "document_segments", spark)
    rows = schema.gaps(u, "uploaded_files", spark).unionByName(schema.gaps(s, "document_segments", spark)).unionByName(again.withColumn("gap", F.lit("left")))
    return rows.select("table", "column", "gap")


@query
def conversation_edits(spark: SparkSession, d: str) -> DataFrame:
    """A conversation added to each state, two bubbles in it, one answered, another state's cleared."""
    ids = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    s = convo.load_state(ids.withColumn("value", F.lit('{"conversations":[{"id":"o","title":"old","messages":[],"bubbles":[{"id":"z"}]}]}')))
    s = convo.bubble_added(convo.bubble_added(convo.added(s, "n", "new", "t"), "n", "x", "why?", 5), "n", "y", "how?", 3)
    s = convo.bubbles_cleared(convo.bubble_answered(s, "n", "x", "because", None), "o")
    s = convo.activated(s, "o")
    talk = lambda c: F.concat(c["id"], F.lit("/"), c["title"], F.lit("/"), F.array_join(F.transform(c["bubbles"], lambda b: F.concat(b["id"], F.lit("="), F.coalesce(b["response"], F.lit("?")))), ","))
    return s.select("id", F.array_join(F.transform("state.conversations", talk), ";").alias("talks"), F.col("state.activeConversationId").alias("active"))


def shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_on_workers(spark)
        return f(spark, sf_dir)

    return run


for name in ("embed_hash_udf", "reembed_all", "reembed_supersedes", "search_topk_many", "artifacts_exported"):
    QUERIES[name] = shipped(QUERIES[name])
