"""Queries of packed artefacts, versioned tables and archives, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import keys
from quillstack.operators import chunk, jobs
from quillstack.plans.oracles import CHUNKS, SQL, mapped
from quillstack.plans.queries import INLINE_LIMIT, JOB, query
from quillstack.sources import fixtures as fx
from quillstack.sources import packed, sinks
from quillstack.sources.files import shared_folder
from quillstack.sources.versioned import VersionedTable
from quillstack.streaming import logs as stream

JOBS = "parent_id long, id long, status string, created_at timestamp, bucket int"
BUCKETS = 8


@query
def files_written(spark: SparkSession, d: str) -> DataFrame:
    """Artefacts of documents written to packed containers and read back under their storage keys; those over 20,000 bytes are marked and have no checksum."""
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    path = shared_folder(spark, "packed")
    packed.write(texts.select(keys.parsed_key(F.lit("u"), F.col("id"), F.lit("j"), "content.txt").alias("storage_key"), F.col("text").alias("content")), path)
    large = F.col("n_bytes") > 20_000
    sound = F.when(packed.sound(F.col("content"), F.col("sha256")), F.col("sha256"))
    return packed.scan(spark, path).select("storage_key", F.col("n_bytes").alias("byte_size"), large.alias("too_large"), F.when(~large, sound).alias("checksum_sha256"), F.length(F.col("content").cast("string")).alias("n_chars"))


@query
def packed_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Offloaded chunk texts packed in two writes, the second of which has every fifth again; texts are then resolved by key for the chunks of every third document."""
    all_ = fx.chunks(spark, d)
    stored = chunk.hybrid_storage(all_, INLINE_LIMIT, F.lit(JOB))
    whole = all_.withColumns({"__text": F.col("text"), "__context": F.col("contextualized_text")})
    files = sinks.offloaded_rows(chunk.hybrid_storage(whole, INLINE_LIMIT, F.lit(JOB)), "__text", "__context")
    path = shared_folder(spark, "packed")
    packed.write(files, path, 0)
    packed.write(files.where(F.octet_length("content") % 5 == 0).withColumn("content", F.concat("content", F.lit("!"))), path, 1)
    wanted = stored.where("parsed_document_id % 3 = 0 AND text_storage_key IS NOT NULL").select("id", F.col("text_storage_key").alias("storage_key"))
    found = packed.get(spark, path, wanted, digest=F.sha2("content", 256)).select("storage_key", "n_bytes", "digest")
    return wanted.join(found, "storage_key").select("id", "n_bytes", F.col("digest").alias("sha256"))


SQL["packed_by_key"] = f"""
WITH {CHUNKS}
SELECT id, strlen(u) AS n_bytes, sha256(u) AS sha256 FROM (SELECT id, parsed_document_id, text, CASE WHEN strlen(text) % 5 = 0 THEN text || '!' ELSE text END AS u FROM chunks)
WHERE parsed_document_id % 3 = 0 AND strlen(text) > {INLINE_LIMIT}"""


def _job_table(spark: SparkSession, d: str) -> tuple[VersionedTable, DataFrame]:
    j = fx.jobs(spark, d).select("parent_id", "id", "status", F.col("created_at").cast("timestamp").alias("created_at"), (F.col("parent_id") % BUCKETS).cast("int").alias("bucket"))
    return VersionedTable(spark, shared_folder(spark, "versions"), "bucket", JOBS), j


@query
def versioned_supersede(spark: SparkSession, d: str) -> DataFrame:
    """Jobs committed, those of even buckets superseded by an upsert; states before and after, by version."""
    table, j = _job_table(spark, d)
    first = table.append(j)
    old = jobs.superseded(j).where("bucket % 2 = 0 AND status = 'superseded'")
    second = table.upsert(old, "id")
    both = [table.read(v).groupBy("bucket", "status").agg(F.count("*").alias("n")).withColumn("version", F.lit(v)) for v in (first, second)]
    return both[0].unionByName(both[1])


SQL["versioned_supersede"] = f"""
WITH j AS (SELECT event_id AS id, user_id AS parent_id, CAST(user_id % {BUCKETS} AS INTEGER) AS bucket, {mapped('event_type', fx.STATUSES)} AS status, ts FROM events),
a AS (SELECT parent_id, arg_max(id, (ts, id)) AS keep FROM j WHERE status = 'succeeded' GROUP BY 1),
s AS (SELECT j.*, CASE WHEN status = 'succeeded' AND id <> keep AND bucket % 2 = 0 THEN 'superseded' ELSE status END AS later FROM j LEFT JOIN a USING (parent_id))
SELECT bucket, status, count(*) AS n, 1 AS version FROM s GROUP BY ALL UNION ALL SELECT bucket, later, count(*), 2 FROM s GROUP BY ALL"""


@query
def versioned_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A backfill by partition that stops after three and goes on from the table's own state: each partition is one commit, none is done twice."""
    table = VersionedTable(spark, shared_folder(spark, "versions"), "bucket", "id long, bucket int, embedding_json string, dims int")
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % BUCKETS).cast("int").alias("bucket"), F.to_json("embedding").alias("embedding_json"), F.lit(None).cast("int").alias("dims"))
    table.append(e)
    for stop in (3, BUCKETS):
        done = 0
        for bucket in [r.bucket for r in table.read().where("dims IS NULL").select("bucket").distinct().orderBy("bucket").collect()]:
            if done == stop:
                break
            open_ = table.read().where((F.col("bucket") == bucket) & F.col("dims").isNull())
            table.upsert(open_.withColumn("dims", F.size(F.from_json("embedding_json", "array<float>"))), "id")
            done += 1
    return table.read().groupBy("bucket", "dims").agg(F.count("*").alias("n")).withColumn("n_versions", F.lit(len(table.versions())))


SQL["versioned_backfill"] = f"SELECT CAST(vec_id % {BUCKETS} AS INTEGER) AS bucket, CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n, (SELECT CAST(1 + count(DISTINCT vec_id % {BUCKETS}) AS INTEGER) FROM embeddings) AS n_versions FROM embeddings GROUP BY ALL"


@query
def log_archive(spark: SparkSession, d: str) -> DataFrame:
    """Log records archived as JSON lines by a stream, a folder for each day, and read back."""
    path = shared_folder(spark, "archive")
    logs = fx.log_records(spark, d).select("id", F.col("ts").cast("timestamp").alias("ts"), "level", "module", "message", "bytes")
    logs.write.parquet(f"{path}/in")
    stream.archive(stream.read(spark, f"{path}/in", "parquet"), f"{path}/out", f"{path}/state")
    back = spark.read.schema(f"{stream.SCHEMA}, day string").json(f"{path}/out")
    return back.select("id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "message", "bytes")


SQL["log_archive"] = f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, {mapped('event_type', fx.LEVELS)} AS level, 'value ' || CAST(floor(value) AS BIGINT) AS message, strlen(props) AS bytes FROM events"""


@query
def chunk_rows_written(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows stored with their job in a versioned table, a partition for each owner, then those of one document chunked anew; what is read back."""
    rows = chunk.hybrid_storage(fx.chunks(spark, d), INLINE_LIMIT, F.lit(JOB)).select("id", "parsed_document_id", "owner_user_id", "sequence_index", "text", "text_storage_key", "text_bytes")
    table = VersionedTable(spark, shared_folder(spark, "chunks"), "owner_user_id", ", ".join(f"{c} {k}" for c, k in rows.dtypes))
    table.append(rows)
    table.upsert(rows.where("parsed_document_id = 4").withColumn("text", F.lit("again")), "id")
    back = table.read()
    return back.select("id", "parsed_document_id", "sequence_index", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), F.col("text_storage_key").isNotNull().alias("is_file"))


SQL["chunk_rows_written"] = f"""
WITH {CHUNKS}
SELECT id, parsed_document_id, sequence_index, CASE WHEN parsed_document_id = 4 THEN 5 WHEN strlen(text) > {INLINE_LIMIT} THEN -1 ELSE CAST(length(text) AS INTEGER) END AS n_chars, strlen(text) > {INLINE_LIMIT} AS is_file FROM chunks"""
