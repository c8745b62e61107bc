"""Jobs from a stream of their events: keyed state with timers.

For each parent the state holds what ``jobs.folded`` holds of its events so far. An open job has a timer: if event time passes ``stale`` after its newest event, it fails with a code, as by
``jobs.reconciled``. A job that has ended has a time too, after which its state is dropped. Each change is a row of an update; the newest row of each parent is the table.

Each call of a state or timer is a message to the JVM, and there are several for each key of a batch. So the key is a bucket of parents, not a parent: its state is the list of its jobs, its timer
goes off at the first of their times. A batch reads and writes a bucket's list once. ``buckets`` should leave some hundred parents in each; a bucket is what a call holds. It is fixed for a ``path``.

Defined cases: events of one instant are in order of their ids; an event that comes after its job failed by time brings the job back, as it would be in a fold; events older than the
watermark are dropped by Spark; a null parent is a parent; a null status counts as neither open nor ended.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstack.operators.jobs import DONE, OPEN

STATE = "status string, at long, id long, attempts long, started long, finished long, done_at long, done_id long, count long, error_code string"
CHANGES = "parent_id long, status string, attempt_count long, started_us long, finished_us long, count long, error_code string, at long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_LONGS = {c.split()[0]: "Int64" for c in CHANGES.split(", ") if c.endswith(" long")}
# what a bucket is sent, without nulls in numbers: pandas would make them floats
_EVENT = ["parent_id", "no_parent", "id", "status", "at_us", "declared_count", "no_count"]
BUCKETS = 4096

Job = dict[str, object]


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Lifecycle(StatefulProcessor):
    """Folds events (``_EVENT``) of a bucket's parents."""

    def __init__(self, stale_ms: int, keep_ms: int, code: str):
        self.stale_ms, self.keep_ms, self.code = stale_ms, keep_ms, code

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", f"parent_id long, {STATE}")

    def _kept(self) -> dict[int | None, Job]:
        return {parent: dict(zip(_FIELDS, state)) for parent, *state in self.jobs.get()}

    def _row(self, parent: int | None, s: Job) -> tuple:
        return (parent, s["status"], s["attempts"], s["started"], s["finished"], s["count"], s["error_code"], s["at"])

    def _due(self, s: Job) -> int:
        """When an open job fails, or the state of another is dropped."""
        if s["status"] in OPEN:
            return s["at"] // 1000 + self.stale_ms
        return s["at"] // 1000 + self.keep_ms + (self.stale_ms if s["error_code"] else 0)

    def _first(self, jobs: dict[int | None, Job]) -> int | None:
        return min(map(self._due, jobs.values()), default=None)

    def _settle(self, jobs: dict[int | None, Job], changed: set[int | None], timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """What is due by ``now`` happens, the rest is kept; ``timer`` is set. Yields the jobs that have changed."""
        gone = []
        for parent, s in jobs.items():
            if s["status"] in OPEN and self._due(s) <= now:
                s |= {"status": "failed", "error_code": self.code}
                changed.add(parent)
            if s["status"] not in OPEN and self._due(s) <= now:
                gone.append(parent)
        out = [self._row(parent, jobs[parent]) for parent in changed]
        for parent in gone:
            del jobs[parent]
        if jobs:
            self.jobs.put([(parent, *(s[f] for f in _FIELDS)) for parent, s in jobs.items()])
        else:
            self.jobs.clear()
        first = self._first(jobs)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object).astype(_LONGS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        jobs = self._kept()
        timer, changed = self._first(jobs), set()
        for frame in rows:
            for parent, no_parent, id_, status, at, count, no_count in zip(*(frame[c].tolist() for c in _EVENT)):
                parent, at = None if no_parent else parent, int(at)
                s = jobs.get(parent)
                if s is None:
                    s = jobs[parent] = {f: 0 if f == "attempts" else None for f in _FIELDS}
                changed.add(parent)
                if s["at"] is None or (at, id_) > (s["at"], s["id"]):
                    s |= {"status": None if pd.isna(status) else status, "at": at, "id": id_, "error_code": None}
                if status == "running":
                    s["attempts"] += 1
                    s["started"] = _least(s["started"], at)
                if status in (DONE, "failed"):
                    s["finished"] = at if s["finished"] is None else max(s["finished"], at)
                if status == DONE and (s["done_at"] is None or (at, id_) > (s["done_at"], s["done_id"])):
                    s |= {"done_at": at, "done_id": id_, "count": None if no_count else count}
        yield from self._settle(jobs, changed, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Spark deletes the timer that has gone off
        yield from self._settle(self._kept(), set(), None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def changes(events: DataFrame, stale: str = "1 hour", late: str = "10 minutes", keep: str = "30 days", code: str = "process_shutdown", buckets: int = BUCKETS) -> DataFrame:
    """Updates of jobs from a stream of ``events`` (parent_id, id, status, created_at, declared_count)."""
    spark = events.sparkSession
    # the driver's worker that asks a processor for its state has no archives of the application, so the class itself is sent
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ms = [r * 1000 for r in spark.sql(f"SELECT unix_seconds(timestamp'1970-01-01 00:00:00Z' + INTERVAL {stale}) AS a, unix_seconds(timestamp'1970-01-01 00:00:00Z' + INTERVAL {keep}) AS b").first()]
    parent, count = F.col("parent_id").cast("long"), F.col("declared_count").cast("long")
    keyed = events.select(
        F.pmod(F.xxhash64(parent), F.lit(buckets)).alias("bucket"), F.coalesce(parent, F.lit(0)).alias("parent_id"), parent.isNull().alias("no_parent"),
        F.coalesce(F.col("id").cast("long"), F.lit(-1 << 63)).alias("id"), "status", F.col("created_at").cast("timestamp").alias("created_at"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us"),
        F.coalesce(count, F.lit(0)).alias("declared_count"), count.isNull().alias("no_count"))
    return keyed.withWatermark("created_at", late).groupBy("bucket").transformWithStateInPandas(Lifecycle(*ms, code), CHANGES, "Update", "EventTime")


def run(events: DataFrame, path: str, **settings: str | int) -> DataFrame:
    """Takes what the stream has, from where an earlier run with this ``path`` stopped; the newest row of each parent so far."""
    spark = events.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    try:
        query = changes(events, **settings).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{path}/rows")
    rest = [c.split()[0] for c in CHANGES.split(", ")][1:]
    newest = rows.groupBy("parent_id").agg(F.max_by(F.struct(*rest), F.struct("batch", F.col("error_code").isNotNull())).alias("__r"))
    times = [F.timestamp_micros("__r.started_us").alias("started_at"), F.timestamp_micros("__r.finished_us").alias("finished_at")]
    return newest.select("parent_id", "__r.status", "__r.attempt_count", *times, "__r.count", "__r.error_code")
