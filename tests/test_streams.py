"""Sessions and job states from streams: out of order, late, and after restarts."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstack.operators import jobs
from quillstack.plans import streams
from quillstack.streaming import lifecycle, sessions

START = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "key long, ts timestamp, value double"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def utc(t):
    return t.astimezone(datetime.timezone.utc)


def plain_sessions(rows, gap):
    out, by = [], {}
    for key, minute, value in rows:
        by.setdefault(key, []).append((minute, value))
    for key, mine in by.items():
        group = []
        for minute, value in sorted(mine):
            if group and minute - group[-1][0] > gap:
                out.append((key, group))
                group = []
            group.append((minute, value))
        out.append((key, group))
    return sorted(((k, at(g[0][0]), at(g[-1][0] + gap), len(g), sum(v for _, v in g)) for k, g in out), key=repr)


def listed(df):
    return sorted(((r.key, utc(r.start), utc(r.end), r.n, r.value) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if m is None else at(m), float(v)) for k, m, v in rows], SCHEMA)


def test_batches_in_any_order_within_the_watermark(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice([1, 2, None]), m + r.randint(-20, 20), r.randint(0, 9)) for m in range(0, 900, 7)]
    s = sessions.Sessions(spark, str(tmp_path / "s"), "15 minutes", "60 minutes")
    for n, low in enumerate(range(0, len(rows), 40)):
        s.take(frame(spark, rows[low : low + 40]), n)
        if n == 1:  # the batch is run again
            s.take(frame(spark, rows[low : low + 40]), n)
    assert listed(s.all()) == plain_sessions(rows, 15) == listed(sessions.batch_sessions(frame(spark, rows), "15 minutes"))
    assert s.late_rows().count() == 0
    closed = listed(s.closed())
    assert 0 < len(closed) < len(plain_sessions(rows, 15)) and set(closed) <= set(plain_sessions(rows, 15))
    assert sorted(p.name for p in (tmp_path / "s/open").iterdir()) == ["batch=2", "batch=3"]  # older open sessions are gone


def test_late_rows_go_aside(spark, tmp_path):
    s = sessions.Sessions(spark, str(tmp_path / "s"), "10 minutes", "30 minutes")
    s.take(frame(spark, [(1, 0, 1), (1, 100, 1), (2, None, 5)]), 0)
    # the watermark is minute 70: a row of minute 59 could only belong to a session that has ended, one of minute 60 not
    s.take(frame(spark, [(1, 59, 7), (1, 60, 2), (1, 95, 3)]), 1)
    assert sorted(((r.key, r.value) for r in s.late_rows().collect())) == [(1, 7.0), (2, 5.0)]
    assert listed(s.all()) == plain_sessions([(1, 0, 1), (1, 60, 2), (1, 95, 3), (1, 100, 1)], 10)


def test_sessions_of_nothing(spark, tmp_path):
    s = sessions.Sessions(spark, str(tmp_path / "s"), "10 minutes", "30 minutes")
    assert s.all().collect() == [] and s.late_rows().collect() == []
    s.take(frame(spark, []), 0)
    s.take(frame(spark, [(1, 5, 1)]), 1)
    assert listed(s.all()) == plain_sessions([(1, 5, 1)], 10)


def test_a_restarted_stream_loses_and_doubles_nothing(spark, tmp_path):
    rows = [(m % 3, m, 1) for m in range(0, 400, 3)]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in range(2):
        frame(spark, rows[60 * part : 60 * part + 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second run finds nothing new
            sessions.Sessions(spark, str(tmp_path / "s"), "8 minutes", "20 minutes").run(stream())
    s = sessions.Sessions(spark, str(tmp_path / "s"), "8 minutes", "20 minutes")
    assert listed(s.all()) == plain_sessions(rows[:120], 8)


JOBS = "parent_id long, id long, status string, created_at timestamp, declared_count long"


@pytest.fixture(scope="module")
def job_events():
    r = random.Random(6)
    rows = [(r.randint(0, 6), i, r.choice(["queued", "running", "succeeded", "failed", "superseded", None]), at(10 * (i // 2)), r.randint(0, 9)) for i in range(90)]
    return [*rows, (40, 1000, "running", at(0), 3), (41, 1001, "succeeded", at(1), None)]


def wanted(spark, rows):
    folded = jobs.folded(spark.createDataFrame(rows, JOBS)).withColumn("id", F.col("parent_id"))
    done = jobs.reconciled(folded, "stopped")
    return sorted(((r.parent_id, r.status, r.attempt_count, r.started_at, r.finished_at, r["count"], r.error_code) for r in done.collect()), key=repr)


def test_job_states_are_those_of_a_fold_after_a_restart(spark, tmp_path, job_events):
    from quillstack.shipping import ensure_on_workers

    ensure_on_workers(spark)
    last = [(-1, -1, "superseded", at(10 * 24 * 60), None)]
    stream = lambda: spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for rows in (job_events[:50], [*job_events[50:], *last[:0]], last):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = lifecycle.run(stream(), str(tmp_path / "s"), stale="1 day", late="2 days", keep="90 days")
        if rows is not last:
            continue
        got = sorted((tuple(r) for r in out.where("parent_id >= 0").collect()), key=repr)
        assert got == wanted(spark, job_events)
        stale = {r.parent_id: (r.status, r.error_code) for r in out.collect()}
        assert stale[40] == ("failed", "process_shutdown") and stale[41] == ("succeeded", None)


class Handle:
    """A bucket's state and timers, and how often they are asked."""

    def __init__(self):
        self.calls, self.jobs, self.timers = 0, [], set()

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.jobs)

    def put(self, jobs):
        self.calls, self.jobs = self.calls + 1, jobs

    def clear(self):
        self.calls, self.jobs = self.calls + 1, []

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_is_called_as_often_for_many_parents_as_for_one():
    handle, bucket = Handle(), lifecycle.Lifecycle(stale_ms=1000, keep_ms=5000, code="stopped")
    bucket.init(handle)
    batch = lambda parents, status, ms: pd.DataFrame([(p, False, p, status, 1000 * (ms + p), 0, True) for p in parents], columns=lifecycle._EVENT)
    rows = lambda frames: sorted((r.parent_id, r.status, r.error_code) for f in frames for r in f.itertuples())
    assert len(rows(bucket.handleInputRows((7,), iter([batch(range(500), "running", 0)]), Now(0)))) == 500
    assert handle.timers == {1000} and handle.calls <= 4
    # all but the first have ended by the next batch; nothing of the first arrives, and it fails by time
    got = rows(bucket.handleInputRows((7,), iter([batch(range(1, 500), "succeeded", 2000)]), Now(2000)))
    assert got[0] == (0, "failed", "stopped") and [r[1] for r in got[1:]] == ["succeeded"] * 499
    assert handle.timers == {6000} and handle.calls <= 8
    handle.timers.remove(6000)  # as Spark does
    assert rows(bucket.handleExpiredTimer((7,), Now(7100), None)) == []
    assert len(handle.jobs) == 399 and handle.timers == {7101} and handle.calls <= 12


def test_jobs_of_many_parents_in_few_buckets_are_those_of_a_fold(spark, tmp_path):
    from quillstack.shipping import ensure_on_workers

    ensure_on_workers(spark)
    r = random.Random(8)
    big = (1 << 53) + 1  # no double
    rows = [(r.choice([None, *range(40)]), i, r.choice(["queued", "running", "succeeded", "failed", None]), at(i // 2), r.choice([None, big, big + 2])) for i in range(400)]
    stream = lambda: spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (rows[:150], rows[150:], [(-1, -1, "superseded", at(10 * 24 * 60), None)]):
        spark.createDataFrame(part, JOBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = lifecycle.run(stream(), str(tmp_path / "s"), stale="1 day", late="2 days", keep="90 days", buckets=3)
    got = sorted((tuple(r) for r in out.where("parent_id IS NULL OR parent_id >= 0").collect()), key=repr)
    assert len(got) == 41 and {g[5] for g in got} >= {None, big, big + 2}
    assert got == wanted(spark, rows)


def test_parts_arrive_whole_and_in_order_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).withColumn("part", F.when(F.col("id") == 7, 2).otherwise(1 - F.col("id") % 2))
    batches = {}

    def take(df, n):
        got = df.collect()
        batches[n] = (len({x.file for x in got}), {x.part for x in got}, len(got))

    stream = streams.arriving(rows, F.col("part"), 4, "parts").withColumn("file", F.col("_metadata.file_path"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert batches == {0: (4, {0}, 499), 1: (4, {1}, 500), 2: (1, {2}, 1), 3: (0, set(), 0)}
