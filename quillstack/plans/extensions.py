"""Queries through registered table functions and data sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import table_functions
from quillstack.plans.oracles import SQL, mapped
from quillstack.plans.queries import marked_segments, query
from quillstack.sources import fixtures as fx
from quillstack.sources import log_files
from quillstack.sources.files import shared_folder
from quillstack.streaming import logs as stream


@query
def sections_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_sections`` as SQL text: a table function over the partitioned segments."""
    table_functions.register(spark)
    text = """
        SELECT parsed_document_id, sequence_index, token_count, array_join(heading_path, ' > ') AS heading_path, array_join(page_numbers, ',') AS page_numbers,
               array_join(source_segment_indices, ',') AS source_segment_indices, sha2(contextualized_text, 256) AS sha256
        FROM sections(TABLE({segments}), max_tokens => 24)"""
    return spark.sql(text, segments=marked_segments(spark, d))


SQL["sections_in_sql"] = SQL["chunk_sections"]


@query
def windows_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Word windows of every turn by a table function used laterally."""
    table_functions.register(spark)
    text = "SELECT conv_id, turn, w.place, w.words, sha2(w.text, 256) AS sha256 FROM {turns}, LATERAL windows(text, 16) AS w"
    return spark.sql(text, turns=fx.table(spark, d, "conversations"))


SQL["windows_lateral"] = r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS l FROM conversations),
p AS (SELECT conv_id, turn, l, unnest(range((len(l) + 15) // 16)) AS place FROM w)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, CAST(len(l[place * 16 + 1 : place * 16 + 16]) AS INTEGER) AS words, sha256(array_to_string(l[place * 16 + 1 : place * 16 + 16], ' ')) AS sha256 FROM p"""


def _archived(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark, "archive")
    rows = fx.log_records(spark, d).select("id", F.col("ts").cast("timestamp").alias("ts"), "level", "module", "message", "bytes")
    rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).repartition("day").write.partitionBy("day").json(path)
    return path


@query
def log_source_days(spark: SparkSession, d: str) -> DataFrame:
    """Archived logs of ten days through the data source; files of other days aren't opened."""
    log_files.register(spark)
    logs = spark.read.format("quillstack_logs").load(_archived(spark, d))
    some = logs.where("day >= '2024-01-05' AND day < '2024-01-15' AND level = 'error'")
    return some.groupBy("day").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("id").alias("first_id"))


SQL["log_source_days"] = f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes, min(event_id) AS first_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' AND {mapped('event_type', fx.LEVELS)} = 'error' GROUP BY 1"""


@query
def log_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream through the data source: records by day and level."""
    log_files.register(spark)
    rows = spark.readStream.format("quillstack_logs").load(_archived(spark, d))
    counts = rows.groupBy("day", "level").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"))
    return stream.drain(counts, "log-source", ["day", "level"])


SQL["log_source_stream"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, {mapped('event_type', fx.LEVELS)} AS level, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL"
