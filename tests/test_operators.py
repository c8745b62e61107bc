"""Quirks and properties on small frames."""

from __future__ import annotations

import math
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import keys, vectors
from quillstack.functions import text as t
from quillstack import schema
from quillstack.operators import catalog, chat, chunk, convo, embed, ingest, jobs, logs, search, verify
from quillstack.sources import files, sinks
from quillstack.streaming import logs as stream


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_zero_vector_is_nan_and_sorts_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "id long, embedding array<float>")
    top = search.top_k(df, [1.0, 0.0], 3).collect()
    assert [r.id for r in top] == [3, 2, 1] and math.isnan(top[2].score)
    assert [r.id for r in search.within(search.top_k(df, [1.0, 0.0], 3), 0.5, 0.4).collect()] == [3]


def test_ties_go_to_the_smaller_id_and_the_limit_comes_first(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(10)], "id long, embedding array<float>")
    assert values(search.top_k(df, [1.0, 0.0], 3), "id") == [0, 2, 4]
    near = search.within(search.top_k(df, [1.0, 0.0], 7), 0.1, 0)
    assert sorted(values(near, "id")) == [0, 2, 4, 6, 8]
    assert search.within(search.top_k(df, [0.0, 1.0], 3), 0.9, 0.1).count() == 0


def test_many_queries_agree_with_single_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, [math.sin(i), math.cos(i * 3), 0.5]) for i in range(60)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0]), (2, [1.0, 0.0])], "query long, vector array<double>")
    many = search.top_k_many(df, asked, 4).collect()
    monkeypatch.setattr(search, "BLOCK_BYTES", 500)
    assert sorted(search.top_k_many(df, asked, 4).collect()) == sorted(many) and all(r["query"] < 2 for r in many)
    for k, v in ((0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0])):
        assert [r.id for r in sorted((r for r in many if r["query"] == k), key=lambda r: r["rank"])] == values(search.top_k(df, v, 4), "id")


def test_prompt_numbers_keep_gaps_and_an_empty_context_still_has_messages(spark):
    rows = [(1, "a", ["h"], [1, 2], "text a", ""), (2, "b", [], [], "[TOC]", None), (3, "c", None, None, None, "full c")]
    df = spark.createDataFrame(rows, "rank int, document_name string, heading_path array<string>, page_numbers array<int>, text string, contextualized_text string")
    got = search.prompt(df, "why?").orderBy("position").collect()
    assert got[1].content == "Context:\n[1] a | h | 1, 2\ntext a\n\n[3] c\nfull c\n\nQuestion: why?"
    assert search.prompt(df.where("rank = 2"), "why?").where("role = 'user'").first().content == "Context:\n\nQuestion: why?"


def test_histogram_counts_all_rows(spark):
    df = spark.createDataFrame([(0.1 * i,) for i in range(11)], "score double")
    assert sum(values(search.histogram(df), "n_results")) == 11
    assert [tuple(r) for r in search.histogram(df.where("score = 0")).collect()] == [(0, 0.0, 1)]
    assert search.histogram(df.where("score > 9")).count() == 0


def test_noise(spark):
    texts = {"": True, None: True, "　\t": True, "[toc] [TOC][目录]": True, "[Toc] [Toc]": True, "[Toc]  [Toc]": False, "[Toc]": True, "x": False}
    df = spark.createDataFrame([(k,) for k in texts], "s string").withColumn("x", t.is_noise(F.col("s")))
    assert {r.s: r.x for r in df.collect()} == texts


def test_verification(spark):
    c = spark.createDataFrame(
        [(1, 1, 0, "a", None, None, None, 5), (2, 1, 2, None, "k", "", None, 0), (3, 1, 2, "later", None, None, None, 1), (4, 2, 0, None, None, None, None, None)],
        "id long, parsed_document_id long, sequence_index int, text string, text_storage_key string, contextualized_text string, contextualized_text_storage_key string, token_count int")
    e = spark.createDataFrame([(1, 1, 0, 1, "m", 2, 3, [0.0, 1.0]), (2, 1, 4, 9, "n", 2, None, [0.0])], "id long, parsed_document_id long, sequence_index int, chunk_id long, model string, dimensions int, token_count int, embedding array<float>")
    p = verify.pairs(c, e)
    got = {(r.parsed_document_id, r.check): (r.passed, r.offenders) for r in verify.checks(p, F.lit(2)).collect()}
    assert got[1, "chunk_embedding_pairing"] == (False, [2, 4])
    assert got[1, "dimension_consistency"] == (False, [4])
    assert got[1, "sequence_continuity"] == (False, [1, 3])
    assert got[1, "chunk_text_availability"] == (True, [])
    assert got[1, "contextualized_text_availability"] == (False, [2])  # an empty text counts as missing
    assert got[1, "token_count_consistency"] == (False, [2, 4])
    assert got[1, "model_consistency"] == (False, [])
    assert got[2, "chunk_text_availability"] == (False, [0]) and got[2, "contextualized_text_availability"] == (True, [])
    unread = verify.checks(p, F.lit(2), F.lit(False)).where("parsed_document_id = 1 AND check = 'chunk_text_availability'").first()
    assert unread.offenders == [2]
    rep = {r.parsed_document_id: r for r in verify.report(p, verify.checks(p, F.lit(2))).collect()}
    assert rep[1].verification.passed_checks == 1 and rep[1].stats.total_pairs == 3 and rep[1].stats.chunk_tokens == 5
    assert [x.check for x in rep[1].verification.checks] == list(verify.CHECKS) and [x.sequence_index for x in rep[1].pairs] == [0, 2, 4]
    there = verify.with_files(p, spark.createDataFrame([("other",)], "storage_key string"))
    assert verify.checks(there, F.lit(2)).where("parsed_document_id = 1 AND check = 'chunk_text_availability'").first().offenders == [2]
    there = verify.with_files(p, spark.createDataFrame([("k",), ("k",)], "storage_key string"))
    assert there.count() == p.count() and verify.checks(there, F.lit(2)).where("parsed_document_id = 1 AND check = 'chunk_text_availability'").first().passed


def test_pairs_without_keys_are_spread(spark):
    """pairs without a storage key met in one task of the join with the files."""
    p = spark.range(400).select((F.col("id") % 40).alias("parsed_document_id"), F.col("id").cast("int").alias("sequence_index"), F.expr("CASE WHEN id % 2 = 0 THEN struct(string(null) AS text_storage_key, string(null) AS contextualized_text_storage_key) END").alias("chunk"))
    files = spark.createDataFrame([("\0/0/0",), ("k",)], "storage_key string")  # a key like that of a place is none of theirs
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"), spark.conf.set("spark.sql.adaptive.enabled", "false")
        there = verify.with_files(p, files)
        each = [r["count"] for r in there.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(each) == 400 and max(each) < 200 and there.where("text_there OR context_there").count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_supersede_twice_is_once(spark):
    rows = [(i, i % 4, ["succeeded", "failed", "queued"][i % 3], i // 2) for i in range(40)]
    j = spark.createDataFrame(rows, "id long, parent_id long, status string, n long").withColumn("created_at", F.timestamp_seconds("n")).withColumn("declared_count", F.lit(1))
    once = jobs.superseded(j)
    assert once.exceptAll(jobs.superseded(once)).count() == 0
    assert once.where("status = 'succeeded'").groupBy("parent_id").count().where("count <> 1").count() == 0
    assert jobs.reconciled(j, "r").where("status IN ('queued', 'running')").count() == 0


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 12), st.integers(0, 300))
def test_shares_add_up(spark, n, total):
    df = spark.range(n).select(F.lit(1).alias("b"), F.col("id").cast("int").alias("position"))
    got = values(embed.apportioned(df, F.lit(total), ["b"]).orderBy("position"), "token_share")
    assert sum(got) == total and got == sorted(got, reverse=True) and got[0] - got[-1] <= 1


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=60), st.integers(1, 5))
def test_chunks_hold_all_words(spark, text, size):
    d = spark.createDataFrame([(1, text, ["h"])], "parsed_document_id long, text string, heading_path array<string>")
    got = chunk.word_chunks(d, size).orderBy("sequence_index").collect()
    assert " ".join(r.text for r in got).split() == text.split()
    assert all(r.token_count <= size for r in got) and [r.sequence_index for r in got] == list(range(len(got)))


def test_retention_keeps_a_suffix(spark):
    b = spark.createDataFrame([(i, 10 * (i % 5 + 1), i * 1800) for i in range(40)], "batch long, bytes long, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = logs.retained(b, 200).orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(40 - len(got), 40)) and sum(r.bytes for r in got) <= 200
    more = sum(r.bytes for r in got) + 10 * ((39 - len(got)) % 5 + 1)
    assert more > 200 and logs.retained(b, 0).count() == 0


def test_ring_and_level(spark):
    r = spark.createDataFrame([(i, i, ["debug", "info", "error", "odd"][i % 4]) for i in range(20)], "id long, ts long, level string")
    assert values(logs.ring(r, 3), "id") == [14, 17, 18]
    assert set(values(logs.at_least(r, "warn"), "level")) == {"error"}


def test_stream_and_batch_agree_and_late_rows_go(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:30:00", ["info", "warn"][i % 2], i) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, ts string, level string, bytes long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.json(str(tmp_path / "in"))
    got = stream.drain(stream.counts(stream.read(spark, str(tmp_path / "in"))), "t_counts", ["start", "level"])
    want = df.groupBy(F.date_trunc("hour", "ts").alias("start"), "level").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_records_are_dropped_and_earlier_updates_replaced(spark, tmp_path):
    write = lambda name, rows: spark.createDataFrame(rows, "id long, ts string, level string, bytes long").coalesce(1).write.json(str(tmp_path / "in" / name))
    write("a", [(1, "2024-01-01 00:10:00", "info", 1), (2, "2024-01-01 05:00:00", "info", 2)])
    write("b", [(3, "2024-01-01 05:10:00", "info", 8)])
    write("c", [(4, "2024-01-01 00:20:00", "info", 4)])  # the watermark has passed its window
    for age, name in enumerate("cba"):
        for f in (tmp_path / "in" / name).glob("*.json"):
            os.utime(f, (time.time() - 100 * age - 100,) * 2)
    raw = spark.readStream.schema(stream.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    got = {r.start.hour: (r.n_records, r.bytes) for r in stream.drain(stream.counts(raw), "late", ["start", "level"]).collect()}
    assert got == {0: (1, 1), 5: (2, 10)}


def test_archive_of_records(spark, tmp_path):
    rows = [(i, f"2024-01-0{i % 3 + 1} 00:00:00", "info", "m", "x", i) for i in range(30)]
    spark.createDataFrame(rows, "id long, ts string, level string, module string, message string, bytes long").write.json(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream.archive(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    back = spark.read.schema(stream.SCHEMA).json(str(tmp_path / "out"))
    assert back.count() == 30 and sorted(x.name for x in (tmp_path / "out").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"]


def test_search_looks_further_where_the_nearest_are_gone(spark, monkeypatch):
    e = spark.createDataFrame([(i, i, i, [1.0, i / 100.0], 1) for i in range(200)], "id long, chunk_id long, parsed_document_id long, embedding array<double>, token_count int")
    c = spark.createDataFrame([(i, i, "t", "c", 1, ["h"], 0) for i in range(200) if i >= 90], "id long, parsed_document_id long, text string, contextualized_text string, token_count int, heading_path array<string>, sequence_index int")
    d = spark.createDataFrame([(i, i) for i in range(200) if i != 95], "id long, uploaded_file_id long")
    u = spark.createDataFrame([(i, f"f{i}") for i in range(200)], "id long, original_filename string")
    want = [90, 91, 92, 93, 94, 96]
    assert [r.id for r in search.search(e, c, d, u, [1.0, 0.0], 6, 0, 0).orderBy("rank").collect()] == want
    monkeypatch.setattr(search, "MOST", 30)
    assert [r.id for r in search.search(e, c, d, u, [1.0, 0.0], 6, 0, 0).orderBy("rank").collect()] == want


def test_paragraphs(spark):
    html = "<P class=a>one <b>two</b></p><pre>x</pre><param><p>three<p>four<br/>4<div>no</div><p>five"
    assert values(spark.range(1).select(ingest.paragraphs(F.lit(html)).alias("x"))) == [["one two", "three", "four4", "five"]]
    assert values(spark.range(1).select(ingest.paragraphs(F.lit(None).cast("string")).alias("x"))) == [[]]


def test_a_busy_hour_is_numbered_in_parts(spark):
    rows = [(i, (i * 7919) % 5000) for i in range(5000)]
    r = spark.createDataFrame(rows, "id long, ms long").withColumn("ts", F.timestamp_millis(F.col("ms") * 500))
    got = {x.id: x.number for x in logs.numbered(r).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}


def test_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "up" / "big.txt").write_bytes(b"x" * 100)
    (tmp_path / "up" / "nul.bin").write_bytes(b"ab\x00")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.sniffed(files.binary(spark, str(tmp_path / "up"), 50)).collect()}
    assert got["a.pdf"].kind == "pdf" and got["big.txt"].too_large and got["big.txt"].content is None and got["nul.bin"].kind == "binary"
    (tmp_path / "root" / "chunks").mkdir(parents=True)
    (tmp_path / "root" / "chunks" / "1.txt").write_text("one\ntwo")
    assert [tuple(r) for r in files.texts(spark, str(tmp_path / "root")).collect()] == [("chunks/1.txt", "one\ntwo")]


def test_pages_and_lookup(spark):
    df = spark.range(500).withColumn("owner_user_id", F.lit("u"))
    assert len(values(catalog.page(df, ["id"], 999, -5), "id")) == 200 and catalog.clamp(0, 3) == (1, 3)
    assert catalog.owned(df, 3, "u").count() == 1 and catalog.owned(df, 3, "v").count() == 0


def test_keys_and_labels(spark):
    one = spark.range(1)
    assert values(one.select(keys.parsed_key(F.lit("u"), F.lit("f"), F.lit("j"), "content.md").alias("x"))) == ["parsed/u/f/j/content.md"]
    assert values(one.select(t.utc_iso(F.lit("2024-01-02 03:04:05.000006").cast("timestamp")).alias("x"))) == ["2024-01-02T03:04:05.000006Z"]
    assert values(one.select(vectors.from_json(F.lit("[1, 2.5]")).alias("x"))) == [[1.0, 2.5]]
    assert values(one.select(logs.pairs_text(F.create_map(F.lit("a"), F.lit("1"))).alias("x"))) == ["a=1"]


def test_state_of_conversations(spark):
    good = '{"conversations":[{"id":"1","title":"t","messages":[]},{"id":"2","title":"u","messages":[],"bubbles":[{"id":"b"}]}],"activeConversationId":"1"}'
    df = convo.load_state(spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, '{"conversations":{}}')], "id long, value string"))
    got = {r.id: r.state for r in df.collect()}
    assert [len(c.bubbles) for c in got[1].conversations] == [0, 1]
    assert all(got[i].conversations == [] for i in (2, 3, 4))
    kept = convo.deleted(convo.renamed(df, "2", "  "), "1").where("id = 1").first().state
    assert [c.title for c in kept.conversations] == ["u"] and kept.activeConversationId is None


@pytest.mark.parametrize("text, title", [("请帮我总结这篇文章。", "总结这篇文章"), ("想知道我要查", "想知道我要查"), ("？？", "")])
def test_titles(spark, text, title):
    assert values(spark.range(1).select(t.title(F.lit(text)).alias("x"))) == [title]


def test_conversation_edits(spark):
    df = convo.load_state(spark.createDataFrame([(1, '{"conversations":[]}')], "id long, value string"))
    df = convo.added(convo.added(df, "a", "A", "t1"), "b", "B", "t2")
    df = convo.bubble_answered(convo.bubble_added(convo.bubble_added(df, "a", "x", "why?", 5), "a", "y", "how?", 3), "a", "x", "because", None)
    s = convo.activated(df, "a").first().state
    assert [c.id for c in s.conversations] == ["b", "a"] and s.activeConversationId == "a"
    assert [(b.id, b.response) for b in s.conversations[1].bubbles] == [("x", "because"), ("y", None)] and s.conversations[0].bubbles == []
    assert convo.bubbles_cleared(df, "a").first().state.conversations[1].bubbles == []


def test_answers_degrade():
    class Broken:
        name = "broken"

        def generate(self, messages):
            raise RuntimeError("down")

    class First:
        name = "first"

        def generate(self, messages):
            return messages[-1]["content"].split("\n")[1]

    said = [{"role": "user", "content": "Context:\n[1] a\ntext"}]
    assert chat.answer(0, 0, said, First()).status == "no_data"
    assert chat.answer(5, 0, said, First()).status == "no_match"
    assert chat.answer(5, 1, said, None).status == "disabled"
    assert chat.answer(5, 1, said, First()).text == "[1] a"
    failed = chat.answer(5, 1, said, Broken())
    assert (failed.status, failed.error) == ("failed", "down")
    for bad in (("", 5), ("x" * 2001, 5), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            chat.validate(*bad)


def test_schema_and_users(spark):
    users = schema.seed_user(spark, F.lit("2024-01-01").cast("timestamp"))
    assert schema.missing(users, "users", spark) == [] and schema.missing(users.drop("email"), "users", spark) == ["email"]
    assert schema.current_user(users).count() == 1 and schema.current_user(users.withColumn("status", F.lit("off"))).count() == 0
    once = schema.seeded(users.limit(0), spark, F.lit("2024-01-01").cast("timestamp"))
    assert once.collect() == users.collect() == schema.seeded(once, spark, F.lit("2025-01-01").cast("timestamp")).collect()
    assert all(schema.empty(spark, n).count() == 0 for n in schema.TABLES) and len(schema.TABLES) == 9


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "j", "t", "t", "{}", [(0, "document", None, "t")])], "uploaded_file_id long, parse_job_id string, markdown string, text string, doc_json string, segments array<struct<sequence_index int, segment_type string, page_no int, text string>>")
    documents, segments = sinks.documents_and_segments(rows)
    sinks.append(segments, str(tmp_path / "s"))
    sinks.append(segments, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.replace(documents, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).join(segments, F.col("document_id") == F.col("parsed_document_id")).count() == 1
