"""Packed containers and versioned tables: whole or not at all, by key, by version, with two writers."""

from __future__ import annotations

import hashlib

import os
import time

import pytest
from pyspark.sql import functions as F

from quillstack.sources import packed
from quillstack.sources.versioned import Conflict, VersionedTable

ROWS = "id long, part string, v long"


def files_of(spark, rows):
    return spark.createDataFrame(rows, "storage_key string, content string")


def test_containers_follow_bytes_and_answer_by_key(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    packed.write(files_of(spark, [(f"a/{i:04}.txt", "é" * (i % 50)) for i in range(400)]), root, size=5000)
    assert 3 <= packed.containers(spark, root).count() <= 6  # 20 kB in all
    spans = sorted((r.first_key, r.last_key) for r in packed.containers(spark, root).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    got = packed.get(spark, root, ["a/0007.txt", "a/0399.txt", "nothing"])
    assert {r.storage_key: r.content.decode() for r in got.collect()} == {"a/0007.txt": "é" * 7, "a/0399.txt": "é" * 49}
    assert "storage_key" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert packed.between(spark, root, "a/0010", "a/0020").count() == 10
    wanted = files_of(spark, [("a/0001.txt", ""), ("a/0001.txt", ""), (None, "")])
    assert packed.get(spark, root, wanted).count() == 1
    assert packed.scan(spark, root).where(packed.sound(F.col("content"), F.col("sha256"))).count() == 400


def test_a_later_write_wins_and_repeated_writes_replace(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    packed.write(files_of(spark, [("a", "1"), ("b", None), ("c", "")]), root)
    for content in ("2", "3"):
        packed.write(files_of(spark, [("a", content)]), root, 1)
    assert {r.storage_key: bytes(r.content) for r in packed.scan(spark, root).collect()} == {"a": b"3", "b": b"", "c": b""}
    for bad in ("../x", None, "/x"):
        with pytest.raises(ValueError):
            packed.write(files_of(spark, [(bad, "1")]), root, 2)
    packed.write(files_of(spark, []), f"file://{tmp_path}/none")
    assert packed.scan(spark, f"file://{tmp_path}/none").count() == 0


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "part", ROWS)
    t.append(spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (None, None, 1)], ROWS))
    return t


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_and_time_travel(spark, table):
    assert table.upsert(spark.createDataFrame([(2, "a", 9), (2, "a", 9), (4, "a", 9), (None, None, 7)], ROWS), "id") == 2
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([(1, "a", 1), (2, "a", 9), (4, "a", 9), (3, "b", 1), (None, None, 7)], ROWS))
    assert rows_of(table.read(1)) == rows_of(spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (None, None, 1)], ROWS))
    assert table.read(0).count() == 0 and table.as_of(time.time()) == 2 and table.as_of(0.0) == 0
    assert table.as_of(table.manifest(1)["at"]) == 1
    with pytest.raises(ValueError):
        table.read(7)
    b = "b".encode()  # a partition that wasn't touched keeps its folder
    key = (b"=" + b).hex().upper()
    assert table.manifest(1)["partitions"][key] == table.manifest(2)["partitions"][key]


def test_a_writer_that_dies_after_staging_changes_nothing(spark, table, tmp_path):
    before = rows_of(table.read())

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(1, "a", 5)], ROWS), "id", before_commit=die)
    assert rows_of(table.read()) == before and table.versions() == [1] and len(os.listdir(tmp_path / "t/data")) == 2
    assert table.vacuum() == []  # it might still be at work
    assert len(table.vacuum(older=0.0)) == 1 and rows_of(table.read()) == before and len(os.listdir(tmp_path / "t/data")) == 1


def test_of_two_writers_to_one_partition_one_is_refused_and_tries_again(spark, table):
    other = lambda: table.upsert(spark.createDataFrame([(1, "a", 50)], ROWS), "id")
    mine = spark.createDataFrame([(2, "a", 60)], ROWS)
    with pytest.raises(Conflict):
        table.upsert(mine, "id", before_commit=other)
    calls = []

    def write():
        calls.append(1)
        return table.upsert(mine, "id", before_commit=other if len(calls) == 1 else None)

    assert table.retried(write) == 4 and len(calls) == 2
    assert {r.id: r.v for r in table.read().where("part = 'a'").collect()} == {1: 50, 2: 60}


def test_writers_to_different_partitions_and_appends_both_succeed(spark, table):
    other = lambda: table.upsert(spark.createDataFrame([(3, "b", 70)], ROWS), "id")
    assert table.upsert(spark.createDataFrame([(1, "a", 80)], ROWS), "id", before_commit=other) == 3
    assert {r.id: r.v for r in table.read().collect()} == {1: 80, 2: 1, 3: 70, None: 1}
    staged = table.stage(spark.createDataFrame([(9, "a", 90)], ROWS))
    other()
    assert table.commit(staged, 1, replace=False) == 5 and table.read().where("id = 9").count() == 1


def test_manifests_are_created_once(table):
    assert not table._create({"version": 1, "partitions": {}, "touched": [], "at": 0.0}) and table.read().count() == 4
    assert table.append(table.read().limit(0)) == 2 and table.read().count() == 4
    assert len(table.vacuum(keep=1, older=0.0)) == 1 and table.versions() == [2] and table.read().count() == 4


def test_only_digests_of_contents_move(spark, tmp_path):
    """contents were joined and hashed afterwards; a column made where artefacts are read leaves them there."""
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"a/{i}.txt", "x" * i) for i in range(20)], "storage_key string, content string")
    packed.write(rows, root), packed.write(rows.where("storage_key = 'a/3.txt'").withColumn("content", F.lit("new")), root, 1)
    wanted = spark.createDataFrame([("a/3.txt",), ("a/5.txt",), ("no",)], "storage_key string")
    found = packed.get(spark, root, wanted, digest=F.md5("content")).select("storage_key", "digest")
    assert {tuple(r) for r in found.collect()} == {("a/3.txt", hashlib.md5(b"new").hexdigest()), ("a/5.txt", hashlib.md5(b"xxxxx").hexdigest())}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan[plan.rindex("Join") :]  # below the joins
