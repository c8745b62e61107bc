"""Structure, settings, calls of models and files."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack import schema, settings
from quillstack.operators import catalog, chat, embed, structure
from quillstack.plans.queries import QUERIES
from quillstack.sources import sinks

SF = "/root/testdata/sf0.001"


def test_sections_follow_headings_and_pages(spark):
    rows = [(1, 0, 1, "intro a b\n# One\nc d e"), (1, 1, 2, "f\n## Sub\ng\n# Two\n\n# Two\nh"), (2, 0, None, "# only"), (3, 0, None, "")]
    got = structure.section_chunks(spark.createDataFrame(rows, "parsed_document_id long, sequence_index int, page_no int, text string"), 3).orderBy("parsed_document_id", "sequence_index").collect()
    assert [(r.sequence_index, r.text, r.heading_path, r.page_numbers, r.source_segment_indices) for r in got] == [
        (0, "intro a b", [], [1], [0]), (1, "c d e", ["One"], [1], [0]), (2, "f", ["One"], [2], [1]), (3, "g", ["One", "Sub"], [2], [1]), (4, "h", ["Two"], [2], [1])]
    assert got[3].contextualized_text == "One\nSub\ng" and got[0].contextualized_text == "\nintro a b"


def test_settings(spark):
    rows = [(1, "max_tokens", " 9 ", 1, 1), (1, "max_tokens", "many", 1, 0), (1, "api_key", "hidden", 2, 2), (2, "max_tokens", "7", 1, 1), (2, "max_tokens", "many", 2, 2), (2, "inline_bytes", None, 3, 3), (3, None, None, 1, 1), (None, "inline_bytes", "-4", 1, 1)]
    o = spark.createDataFrame(rows, "job_id long, name string, value string, at long, id long")
    got = {tuple(r) for r in settings.snapshots(o, settings.CHUNK).collect()}
    assert got == {(1, 9, 2048, ""), (2, 512, 2048, "max_tokens"), (3, 512, 2048, ""), (None, 512, -4, "")}
    reals = [(1, "max_distance", "0.25", 1, 1), (1, "max_best", "1e3", 1, 1), (1, "k", "2.5", 1, 1)]
    assert tuple(settings.snapshots(spark.createDataFrame(reals, o.schema), settings.SEARCH).first()) == (1, 5, 0.25, 0.4, "k,max_best")
    assert settings.snapshots(o.limit(0), settings.EMBED).collect() == []


def test_calls_are_tried_again():
    class Flaky:
        name = "flaky"

        def __init__(self, *errors):
            self.errors, self.calls = list(errors), 0

        def generate(self, messages):
            self.calls += 1
            if self.errors:
                raise self.errors.pop(0)
            return "said"

    waits: list[float] = []
    model = Flaky(chat.Lost(), chat.Refused(429, 0.1), chat.Refused(503, 900))
    assert chat.generate(model, [], wait=waits.append) == "said" and waits == [1.0, 0.5, 60.0]
    for errors, calls in (([chat.Refused(400)], 1), ([chat.Lost()] * 4, 4), ([ValueError("x")], 1)):
        model = Flaky(*errors)
        with pytest.raises(type(errors[0])):
            chat.generate(model, [], wait=waits.append)
        assert model.calls == calls
    with pytest.raises(NotImplementedError):
        chat.generate(model, [], stream=True)


def test_hash_embeddings_are_those_of_plain_python(spark):
    chunks = spark.createDataFrame([(1, "b a a c"), (2, ""), (3, None), (4, "Straße x x x x")], "id long, text string")
    got = {r.id: r.embedding for r in embed.embedded(chunks, embed.HashEmbedder(16), F.col("text")).collect()}
    for i, text in ((1, "b a a c"), (2, ""), (3, ""), (4, "Straße x x x x")):
        want = [0.0] * 16
        for w in text.split():
            h = zlib.crc32(w.encode())
            want[h % 16] += 1 if h >> 31 else -1
        size = sum(x * x for x in want) ** 0.5 or 1.0
        assert np.allclose(got[i], [x / size for x in want], atol=1e-7)


def test_embed_hash_udf_against_brute_force(spark):
    from quillstack.sources import fixtures as fx

    texts = {r.id: r.contextualized_text or r.text or "" for r in fx.chunks(spark, SF).collect()}
    got = QUERIES["embed_hash_udf"](spark, SF).collect()
    assert {r.id for r in got} == set(texts)
    for r in got:
        sums = np.zeros(64)
        for w in texts[r.id].split():
            h = zlib.crc32(w.encode())
            sums[h % 64] += 1 if h >> 31 else -1
        assert r.dims == 64 and r.norm == (1.0 if sums.any() else 0.0)


def test_schemas_up_and_down(spark):
    old = spark.createDataFrame([(1, "t", "x")], "id long, title string, beyond string")
    new = schema.upgraded(old, "parsed_documents", spark)
    assert new.columns[:-1] == schema.empty(spark, "parsed_documents").columns and new.columns[-1] == "beyond"
    assert new.first().id == "1" and new.first().page_count is None
    added = [c for c in new.columns if c not in old.columns]
    assert sorted(schema.downgraded(new, added).columns) == sorted(old.columns)
    gaps = {(r.column, r.gap) for r in schema.gaps(old, "parsed_documents", spark).collect()}
    assert ("beyond", "extra") in gaps and ("page_count", "missing") in gaps and ("id", "extra") not in gaps


def test_pages_with_totals(spark):
    df = spark.range(7)
    assert [tuple(r) for r in catalog.paged(df, ["id"], 2, 4).orderBy("id").collect()] == [(4, 7), (5, 7)]
    assert catalog.paged(df, ["id"], 2, 40).count() == 0


def test_files_stay_below_their_root(spark, tmp_path):
    bad = spark.createDataFrame([("../x", "y")], "storage_key string, content string")
    with pytest.raises(ValueError):
        sinks.write_files(bad, f"file://{tmp_path}/r")
    good = spark.createDataFrame([("a/b.txt", "é"), ("a/c.txt", None)], "storage_key string, content string")
    for _ in range(2):
        sinks.write_files(good, f"file://{tmp_path}/r")
    assert {p.relative_to(tmp_path / "r").as_posix(): p.read_text() for p in (tmp_path / "r").rglob("*") if p.is_file() and not p.name.startswith(".")} == {"a/b.txt": "é", "a/c.txt": ""}
