"""Table functions in SQL and the data source over log files."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillstack.operators import structure, table_functions
from quillstack.sources import log_files

SEGMENTS = "parsed_document_id string, sequence_index int, page_no int, text string"


@pytest.fixture(scope="module")
def segments(spark):
    table_functions.register(spark)
    rows = [("a", 0, 1, "intro a b\n# One\nc d e"), ("a", 1, 2, "f\n## Sub\ng\n# Two\n\n# Two\nh"), ("b", 0, None, "# only"), ("c", 0, None, ""), ("d", 0, 3, None), (None, 1, 4, "x y\nz"), (None, 0, None, "##  Sub \nw " + "v " * 40)]
    return spark.createDataFrame(rows, SEGMENTS)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sections_are_those_of_the_frame_form(spark, segments):
    names = ["parsed_document_id", *table_functions.CHUNK.names]
    for n in (1, 3, 100):
        got = spark.sql(f"SELECT * FROM sections(TABLE({{s}}), max_tokens => {n})", s=segments)
        want = structure.section_chunks(segments, n)
        assert got.columns == names and got.schema["parsed_document_id"].dataType.simpleString() == "string"
        assert listed(got) == listed(want.select(*names))
    assert spark.sql("SELECT * FROM sections(TABLE({s}), max_tokens => 2)", s=segments.limit(0)).collect() == []


@pytest.mark.parametrize("call", ["sections(TABLE(SELECT 1 AS parsed_document_id), max_tokens => 2)", "sections(TABLE({s}), max_tokens => 0)", "sections(1, max_tokens => 2)", "windows('a b', -1)"])
def test_wrong_calls_are_errors_of_the_query(spark, segments, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}", s=segments)


def test_lateral_windows(spark, segments):
    got = spark.sql("SELECT t.i, w.place, w.words, w.text FROM VALUES (1, 'a b c'), (2, NULL), (3, '') AS t(i, x), LATERAL windows(x, 2) AS w")
    assert listed(got) == [(1, 0, 2, "a b"), (1, 1, 1, "c")]


@pytest.fixture
def archive(tmp_path):
    def put(day, name, *lines):
        (tmp_path / f"logs/day={day}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"logs/day={day}/{name}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    put("2024-01-01", "part-0", {"id": 1, "level": "info", "bytes": 5}, "not json", {"id": 2, "message": "é"}, "[1]")
    put("2024-01-02", "part-0", {"id": 3, "level": "error"})
    put("2024-01-03", "part-0")
    put("2024-01-01", "_SUCCESS")
    return tmp_path / "logs", put


def test_files_of_other_days_are_not_opened(spark, archive):
    root, put = archive
    log_files.register(spark)
    logs = spark.read.format("quillstack_logs").load(f"file://{root}")
    assert sorted((r.day, r.id, r.message) for r in logs.where("id IS NOT NULL").collect()) == [("2024-01-01", 1, None), ("2024-01-01", 2, "é"), ("2024-01-02", 3, None)]
    assert logs.count() == 5
    some = logs.where("day = '2024-01-02' AND level = 'error'")
    assert some.select("id").collect() == [(3,)] and some.rdd.getNumPartitions() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "level" in plan.split("Filter")[1] and "2024-01-02" not in plan.split("BatchScan")[0]  # Spark filters by level only
    assert logs.where("day IN ('2024-01-01', '2024-01-02')").rdd.getNumPartitions() == 2
    assert spark.read.format("quillstack_logs").load(f"file://{root}/none").count() == 0


def test_a_stream_takes_each_file_once(spark, archive, tmp_path):
    root, put = archive
    log_files.register(spark)

    def run():
        rows = spark.readStream.format("quillstack_logs").load(str(root)).where("id IS NOT NULL").select("id", "day")
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long, day string").parquet(str(tmp_path / "out")).collect())

    assert run() == run() == [1, 2, 3]
    put("2024-01-04", "part-0", {"id": 4}, {"id": 5})
    assert run() == [1, 2, 3, 4, 5]
