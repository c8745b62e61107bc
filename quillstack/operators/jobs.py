"""Job states: latest and active jobs, superseding, reconciliation, conflicts, and the fold of job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN = ("queued", "running")
DONE = "succeeded"


def newest(jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The newest job of each parent, by time and then id. One row per parent is kept by a partial aggregate before the shuffle."""
    rest = [c for c in jobs.columns if c not in (parent, "created_at", "id")]
    best = F.max(F.struct("created_at", "id", *rest)).alias("__b")
    return jobs.groupBy(parent).agg(best).select(parent, "__b.*").select(*jobs.columns)


def active(jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The newest succeeded job of each parent."""
    return newest(jobs.where(F.col("status") == DONE), parent)


def superseded(jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """All succeeded jobs but the newest of each parent become superseded. Running it again changes nothing."""
    keep = active(jobs, parent).select(F.col("id").alias("__keep"))
    out = jobs.join(keep, jobs.id == keep["__keep"], "left")
    old = (F.col("status") == DONE) & F.col("__keep").isNull()
    return out.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("__keep")


def supersede_siblings(jobs: DataFrame, parent: Column, keep: Column) -> DataFrame:
    """The succeeded siblings of one job."""
    old = (F.col("parent_id") == parent) & (F.col("id") != keep) & (F.col("status") == DONE)
    return jobs.withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))


def runnable(jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Parents' newest jobs that still wait: a job that has run or failed meanwhile is not run again."""
    return newest(jobs, parent).where(F.col("status") == "queued")


def failed(jobs: DataFrame, job: Column, code: str, reason: str) -> DataFrame:
    """One job, if it is open, fails."""
    hit = (F.col("id") == job) & F.col("status").isin(*OPEN)
    out = jobs.withColumn("error_code", F.when(hit, code)).withColumn("error_message", F.when(hit, reason))
    return out.withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def reconciled(jobs: DataFrame, reason: str, code: str = "process_shutdown") -> DataFrame:
    """Open jobs fail with a code and a reason."""
    open_ = F.col("status").isin(*OPEN)
    out = jobs.withColumn("error_code", F.when(open_, code)).withColumn("error_message", F.when(open_, reason))
    return out.withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def conflicts(parents: DataFrame, jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Parents with an open job."""
    return parents.join(jobs.where(F.col("status").isin(*OPEN)), parent, "left_semi")


def admissible(parents: DataFrame, jobs: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Parents without one."""
    return parents.join(jobs.where(F.col("status").isin(*OPEN)), parent, "left_anti")


def queued(parents: DataFrame, config: dict[str, object], as_of: Column, parent: str = "parent_id") -> DataFrame:
    """A new queued job for each parent, with a snapshot of its settings; ids follow from parent and time."""
    import json

    snapshot = json.dumps({k: v for k, v in sorted(config.items()) if k != "api_key"})
    return parents.select(
        F.sha2(F.concat_ws("|", F.col(parent).cast("string"), as_of.cast("string")), 256).alias("id"), parent, F.lit("queued").alias("status"),
        F.lit(snapshot).alias("config_json"), F.lit(0).alias("count"), F.lit(0).alias("attempt_count"), as_of.alias("created_at"), as_of.alias("updated_at"))


def folded(events: DataFrame, parent: str = "parent_id") -> DataFrame:
    """A parent's log as one job: last status, attempts (times it ran), first start, last end, the last success's count."""
    end = F.col("status").isin("succeeded", "failed")
    order = F.struct("created_at", "id")
    return events.groupBy(parent).agg(
        F.max_by("status", order).alias("status"),
        F.count_if(F.col("status") == "running").alias("attempt_count"),
        F.min(F.when(F.col("status") == "running", F.col("created_at"))).alias("started_at"),
        F.max(F.when(end, F.col("created_at"))).alias("finished_at"),
        F.max_by(F.when(F.col("status") == DONE, F.col("declared_count")), F.when(F.col("status") == DONE, order)).alias("count"),
    )


def by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"), F.max("created_at").alias("newest"))


def declared_against_stored(active_jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Declared and stored counts of active jobs, with ``stored`` (parent_id, ...) rows."""
    n = stored.groupBy("parent_id").agg(F.count("*").alias("stored_count"))
    out = active_jobs.join(n, "parent_id", "left").withColumn("stored_count", F.coalesce("stored_count", F.lit(0)))
    return out.select("parent_id", "id", "declared_count", "stored_count", (F.col("declared_count") == F.col("stored_count")).alias("equal"))


def stale(chunk_jobs: DataFrame, embedding_jobs: DataFrame) -> DataFrame:
    """Parents whose active chunk job is newer than their active embedding job, or that have none."""
    c = active(chunk_jobs).select("parent_id", F.col("id").alias("chunk_job"), F.col("created_at").alias("chunked_at"))
    e = active(embedding_jobs).select("parent_id", F.col("id").alias("embedding_job"), F.col("created_at").alias("embedded_at"))
    return c.join(e, "parent_id", "left").where(F.col("embedded_at").isNull() | (F.col("embedded_at") < F.col("chunked_at")))


def rank_in_parent(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("age", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.desc("created_at"), F.desc("id"))))


def latest_of(parents: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """Each row of ``parents`` (id) with its newest succeeded child's id (null without one); ``children`` name it in ``parent``."""
    best = children.where(F.col("status") == DONE).groupBy(F.col(parent).alias("id")).agg(F.max(F.struct("created_at", F.col("id").alias("child"))).alias("__b"))
    return parents.join(best, "id", "left").withColumn("child_id", F.col("__b.child")).drop("__b")
