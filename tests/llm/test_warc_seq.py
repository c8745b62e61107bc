import base64
import gzip
import hashlib
import io

import duckdb
import pytest

from quillstack.llm import warc_seq as w
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of

SCHEMA = "page_id long, url string, html string, digest string"


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = QUERIES["op6_warc_sequential"](spark, SF)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op6_warc_sequential']})").fetchall(), key=repr) == rows_of(df)


def test_odd_pages(spark):
    rows = [(1, "http://a\r\nX: y", "same", None), (2, None, "same", "z"), (2, "u", "same", "z"), (3, "u", None, None), (4, "u", "", None), (None, "u", "same", None), (None, "u", "own", None), (7, "u", "é\r\n\r\n" * 200_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    got = rows_of(w.round_trip(df))
    want = [(1, 4, sha("same"), "revisit", 2), (2, 4, sha("same"), "response", None), (2, 4, sha("same"), "response", None), (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", None), (None, 4, sha("same"), "revisit", 2), (None, 3, sha("own"), "response", None), (7, 1_200_000, sha("é\r\n\r\n" * 200_000), "response", None)]
    assert got == sorted(want, key=repr)
    assert w.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in w.round_trip(df.where("page_id < 5"), min_revisit=5).collect()} == {"response"}


def test_archives_are_gzip_members_and_payloads_survive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE", 2000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * i, None) for i in range(60)], SCHEMA).coalesce(1)
    manifest = w.write_archives(pages, f"file://{tmp_path}")
    assert manifest.count() > 3
    whole = b"".join(gzip.decompress(open(r.path, "rb").read()) for r in manifest.collect())
    assert whole.count(b"WARC/1.1\r\n") == 60
    read = {r.page_id: r.payload for r in w.read_archives(manifest, f"file://{tmp_path}", with_payload=True).collect()}
    assert all(bytes(read[i]) == (f"<p>{i}</p>" * i).encode() for i in range(1, 60))


def test_reader_takes_any_step_and_finds_damage():
    data = b"".join(w.record(i, "u", b"x" * i, None, False) for i in range(5))
    for step in (1, 7, 1 << 16):
        assert [w.parse(m)["payload_bytes"] for m in w.members(io.BytesIO(data).read, step)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        list(w.members(io.BytesIO(data[:-9]).read))
    member = next(w.members(io.BytesIO(w.record(1, "u", b"payload", None, False)).read))
    for bad in (member.replace(b"payload\r\n", b"Payload\r\n"), member[:-1], member.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(ValueError):
            w.parse(bad)


def test_a_hot_payload_is_met_in_parts(spark):
    """Without broadcasts, as for very many repeated payloads."""
    rows = [(i, f"u{i}", "" if i % 3 else f"own {i // 6}") for i in range(300)] + [(None, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r.page_id is None, r.page_id, r.revisit, r.refers_to) for r in w.with_targets(pages).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = w.with_targets(pages)
        assert sorted((r.page_id is None, r.page_id, r.revisit, r.refers_to) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(x[2], x[3]) for x in want if x[1] is not None and x[1] % 3 and x[1] != 299} == {(True, 299)} and (True, None, True, 299) in want
