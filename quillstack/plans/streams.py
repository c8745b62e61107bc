"""Queries that run streams over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.plans.oracles import SQL, mapped
from quillstack.plans.queries import QUERIES, query, shipped
from quillstack.sources import fixtures as fx
from quillstack.sources.files import shared_folder
from quillstack.streaming import lifecycle, sessions

GAP, LATE, PARTS = "3 hours", "1 day", 4
EPOCH = 1704067200  # where the events' month begins
DAYS = 30


def arriving(rows: DataFrame, part: Column, parts: int, name: str) -> DataFrame:
    """A stream of ``rows`` in ``parts`` micro-batches: parts are written one after the other, those of lower ``part`` first, each by all cores and as the same number of files."""
    spark = rows.sparkSession
    path, files = shared_folder(spark, name), min(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    nothing = spark.createDataFrame([], rows.schema).coalesce(1)
    for p in range(parts):
        rows.where(part == p).coalesce(files).write.parquet(f"{path}/part={p}")
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(f"{path}/part={p}").inputFiles())):  # tasks without rows write no file
            nothing.write.mode("append").parquet(f"{path}/part={p}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")


def by_time(ts: Column, parts: int) -> Column:
    return F.least(F.floor((F.unix_seconds(ts.cast("timestamp")) - EPOCH) / (DAYS * 86400 / parts)).cast("int"), F.lit(parts - 1))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "value", "event_id")


@query
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users from a stream in four batches, rows out of order within a batch."""
    rows = clicks(spark, d).drop("event_id")
    s = sessions.Sessions(spark, shared_folder(spark, "sessions"), GAP, LATE)
    s.run(arriving(rows, by_time(F.col("ts"), PARTS), PARTS, "clicks"))
    return s.all().select("key", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n", F.round("value", 2).alias("value"))


SQL["session_stream"] = f"""
WITH o AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL {GAP}, true) AS new FROM events),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id AS key, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts) + INTERVAL {GAP})) AS BIGINT) AS end_s, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, s"""


@query
def session_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every seventeenth event is delivered in the last batch; what of it came too late for its session."""
    part = F.when(F.col("event_id") % 17 == 0, PARTS - 1).otherwise(by_time(F.col("ts"), PARTS))
    rows = clicks(spark, d).withColumn("__part", part)
    s = sessions.Sessions(spark, shared_folder(spark, "sessions"), GAP, LATE)
    s.run(arriving(rows, F.col("__part"), PARTS, "clicks").drop("event_id", "__part"))
    return s.late_rows().select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value")


SQL["session_late_rows"] = f"""
WITH p AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN {PARTS - 1} ELSE least(CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH}) / {DAYS * 86400 / PARTS}) AS INTEGER), {PARTS - 1}) END AS part FROM events),
w AS (SELECT p.*, (SELECT max(ts) FROM p b WHERE b.part < {PARTS - 1}) AS seen FROM p WHERE part = {PARTS - 1})
SELECT user_id AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM w WHERE ts + INTERVAL {GAP} < seen - INTERVAL {LATE}"""


@query
def job_lifecycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """Jobs from a stream of their events in four batches; a last event of another parent, a year later, lets open jobs fail by time."""
    rows = fx.jobs(spark, d).select("parent_id", "id", "status", F.col("created_at").cast("timestamp").alias("created_at"), "declared_count")
    end = rows.agg(F.lit(-1).cast("long").alias("parent_id"), F.lit(-1).cast("long").alias("id"), F.lit("superseded").alias("status"), (F.max("created_at") + F.expr("INTERVAL 400 DAYS")).alias("created_at"), F.lit(None).cast("long").alias("declared_count"))
    part = F.when(F.col("parent_id") == -1, PARTS).otherwise(by_time(F.col("created_at"), PARTS))
    stream = arriving(rows.unionByName(end), part, PARTS + 1, "jobs")
    parents = rows.agg(F.approx_count_distinct("parent_id")).first()[0]
    out = lifecycle.run(stream, shared_folder(spark, "lifecycle"), stale="2 days", late="1 day", keep="500 days", buckets=max(512, parents // 128))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.where("parent_id >= 0").select("parent_id", "status", "attempt_count", iso("started_at"), iso("finished_at"), "count", "error_code")


SQL["job_lifecycle_stream"] = f"""
WITH j AS (SELECT event_id AS id, user_id AS parent_id, {mapped('event_type', fx.STATUSES)} AS status, ts, CAST(floor(value) AS BIGINT) AS declared FROM events),
f AS (
  SELECT parent_id, arg_max(status, (ts, id)) AS status, count(*) FILTER (status = 'running') AS attempt_count, min(ts) FILTER (status = 'running') AS started, max(ts) FILTER (status IN ('succeeded', 'failed')) AS finished,
         arg_max(declared, (ts, id)) FILTER (status = 'succeeded') AS count FROM j GROUP BY 1)
SELECT parent_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, attempt_count, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(finished, '%Y-%m-%d %H:%M:%S.%f') AS finished_at, count,
       CASE WHEN status IN ('queued', 'running') THEN 'process_shutdown' END AS error_code FROM f"""

QUERIES["job_lifecycle_stream"] = shipped(QUERIES["job_lifecycle_stream"])
