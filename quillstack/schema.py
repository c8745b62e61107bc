"""Schemas of the nine tables, and checks of rows against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "users": "id string, display_name string, email string, avatar_url string, status string, deleted_at timestamp, created_at timestamp, updated_at timestamp",
    "uploaded_files": "id string, owner_user_id string, original_filename string, content_type string, byte_size int, storage_key string, checksum_sha256 string, status string, error_message string, deleted_at timestamp, created_at timestamp, updated_at timestamp",
    "document_parse_jobs": "id string, uploaded_file_id string, owner_user_id string, status string, attempt_count int, started_at timestamp, finished_at timestamp, error_code string, error_message string, created_at timestamp, updated_at timestamp",
    "parsed_documents": "id string, uploaded_file_id string, parse_job_id string, owner_user_id string, source_checksum_sha256 string, title string, page_count int, metadata map<string,string>, created_at timestamp",
    "document_segments": "id string, parsed_document_id string, owner_user_id string, sequence_index int, segment_type string, page_no int, heading_path array<string>, text string, metadata map<string,string>",
    "document_chunk_jobs": "id string, parsed_document_id string, owner_user_id string, status string, chunker_name string, chunk_config_json string, chunk_count int, attempt_count int, started_at timestamp, finished_at timestamp, error_code string, error_message string, created_at timestamp, updated_at timestamp",
    "document_chunks": "id string, chunk_job_id string, parsed_document_id string, owner_user_id string, sequence_index int, text string, text_storage_key string, contextualized_text string, contextualized_text_storage_key string, token_count int, heading_path array<string>, page_numbers array<int>, chunk_type string, source_segment_indices array<int>, metadata map<string,string>, created_at timestamp",
    "document_embedding_jobs": "id string, chunk_job_id string, parsed_document_id string, owner_user_id string, status string, embedder_name string, model string, dimensions int, embedding_count int, attempt_count int, started_at timestamp, finished_at timestamp, error_code string, error_message string, config_json string, created_at timestamp, updated_at timestamp",
    "document_embeddings": "id string, embedding_job_id string, chunk_id string, parsed_document_id string, owner_user_id string, sequence_index int, model string, dimensions int, embedding array<float>, token_count int, created_at timestamp",
}
LONGEST = {"display_name": 128, "email": 255, "original_filename": 512, "content_type": 255, "storage_key": 1024, "status": 32, "model": 255, "title": 512}
STATUSES = ("queued", "running", "succeeded", "failed", "superseded")
DEFAULT_USER = "00000000-0000-0000-0000-000000000001"


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def missing(df: DataFrame, name: str, spark: SparkSession) -> list[str]:
    """Columns of a table that ``df`` lacks; extra ones don't matter."""
    return sorted(set(empty(spark, name).columns) - set(df.columns))


def faults(df: DataFrame, job: bool = False) -> Column:
    """Names of columns whose text is too long or, in job tables, whose status is unknown."""
    found = [F.when(F.length(c) > LONGEST[c], c) for c in df.columns if c in LONGEST]
    if job and "status" in df.columns:
        found.append(F.when(~F.col("status").isin(*STATUSES), "status"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def seed_user(spark: SparkSession, as_of: Column) -> DataFrame:
    return spark.range(1).select(
        F.lit(DEFAULT_USER).alias("id"), F.lit("Default user").alias("display_name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("avatar_url"),
        F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), as_of.alias("created_at"), as_of.alias("updated_at"))


def seeded(users: DataFrame, spark: SparkSession, as_of: Column) -> DataFrame:
    """``users`` with the default user, whose own row stays where there is one; the same again if repeated."""
    default = seed_user(spark, as_of).select(*users.columns)
    return users.unionByName(default.join(users.select("id"), "id", "left_anti").select(*users.columns))


def current_user(users: DataFrame, user: str = DEFAULT_USER) -> DataFrame:
    return acting(users.where(F.col("id") == user))


def acting(users: DataFrame) -> DataFrame:
    """Users who may act: active and not deleted."""
    return users.where((F.col("status") == "active") & F.col("deleted_at").isNull())


def uuid7(ts: Column, seed: Column) -> Column:
    """Version-7 identifiers from a time and a seed, the same on every run."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    h = F.sha2(seed.cast("string"), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def gaps(df: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """The columns that ``df`` lacks of a table, and those it has beyond it, a row each."""
    want, have = empty(spark, name).dtypes, {c.lower() for c in df.columns}
    rows = [(name, c, kind, "missing") for c, kind in want if c.lower() not in have]
    rows += [(name, c, kind, "extra") for c, kind in df.dtypes if c.lower() not in {w for w, _ in want}]
    return spark.createDataFrame(rows, "table string, column string, type string, gap string")


def upgraded(df: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """``df`` with every column of a table, new ones null, in the table's order and types; extra columns come last."""
    want = empty(spark, name).schema.fields
    have = {c.lower() for c in df.columns}
    rest = [c for c in df.columns if c.lower() not in {f.name for f in want}]
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], *rest)


def downgraded(df: DataFrame, added: list[str]) -> DataFrame:
    """``df`` without the columns that an upgrade added."""
    return df.drop(*added)
