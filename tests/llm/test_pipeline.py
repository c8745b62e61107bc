"""The pipeline's rows against a brute-force version of every stage."""

from __future__ import annotations

import hashlib
import itertools
import re

import corpus_pipeline
import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstack.llm import quality_ngram as q
from quillstack.llm import secret_links, source_mix
from quillstack.llm.oracles import SQL

from .conftest import SF
from .test_byte_bpe import LIB
from .test_quality_ngram import base, brute_model, folded
from .test_secret_links import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(docs):
    """Base rules and bands, a model for each language."""
    out = []
    for lang in {d["lang"] for d in docs}:
        mine = [d for d in docs if d["lang"] == lang]
        score = brute_model([d["text"] for d in mine])
        counts = {d["doc_id"]: base(d["text"]) for d in mine}
        good = [d for d in mine if counts[d["doc_id"]][0] >= 10 and 100 * counts[d["doc_id"]][4] <= 20 * counts[d["doc_id"]][0]]
        logp = {d["doc_id"]: score(d["text"]) for d in good}
        steps = {i: round(x / q.STEP) for i, x in logp.items()}
        middle = lambda x: sorted(x)[-(-len(x) // 2) - 1]
        mid = middle(steps.values())
        low, high = middle([mid - x for x in steps.values() if x <= mid]), middle([x - mid for x in steps.values() if x >= mid])
        for d in good:
            more = q.SHORT / len(folded(d["text"])) ** 0.5 + q.FEW / len(good) ** 0.5
            if mid * q.STEP - q.LOW_WIDTH * 1.4826 * low * q.STEP - more <= logp[d["doc_id"]] <= mid * q.STEP + q.HIGH_WIDTH * 1.4826 * high * q.STEP + more:
                out.append(d)
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def dedup(docs):
    """Every pair of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more is linked."""
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def redact(d):
    text, at, out = d["text"], 0, []
    for start, _, end in brute(text)[1]:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    text = "".join(out) + text[at:]
    return d | {"text": text, "n_chars": len(text)}


def test_run_against_brute_force(spark, tmp_path):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [redact(d) for d in dedup(keep_good(docs))]
    spark.createDataFrame([[d[c] for c in COLUMNS] for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    times = con.execute(f"SELECT doc_id FROM ({SQL['op4_temperature_mix']})").fetchall()
    by = {d["doc_id"]: d for d in docs}
    want = []
    for (doc_id,) in times:
        d = by[doc_id]
        ids = LIB.encode_ordinary(d["text"])
        want.append((doc_id, d["lang"], d["source"], len(ids), ids, hashlib.sha256(d["text"].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def with_clashes(docs):
    """Columns whose names operators use for results and steps."""
    names = ["model", "kept", "left", "epoch", "place", "ids", "fp", "id", "name", "base", "spans", "n_words", "log_perplexity", "size", "set", "decoded"]
    return docs.select("*", *[F.lit(f"my {n}").alias(n) for n in names if n not in docs.columns])


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_odd_rows_and_any_column(spark, odd_docs, k, clash):
    docs = with_clashes(odd_docs) if clash else odd_docs.select(*COLUMNS)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    rows = out.collect()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0
    ids = {r.doc_id for r in docs.collect()}
    if k == 4:
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
        assert len(rows) == docs.count() and {r.doc_id for r in rows} == ids
        for r in rows:
            assert r.n_tokens == len(r.ids) and (r.doc_id != 3 or r.n_tokens == 0)
        return
    assert out.dtypes == docs.dtypes
    odd = {"a.b": "dot", "back`tick": 1, "N_Tokens": "upper"}
    if clash:
        for c in docs.columns[6:]:
            assert {r[c] for r in rows} == {odd.get(c, f"my {c}")}, c
        assert {(r.doc_id, r.ids) for r in rows} <= {(r.doc_id, r.ids) for r in docs.collect()}
    if k in (2, 3):
        assert {r.doc_id for r in rows} == ids


def test_mixture_is_written_in_the_order_of_reading(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "m"))
    got = [i for f in sorted((tmp_path / "m").glob("*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    want = [r.doc_id for r in source_mix.mixed(docs, max_epochs=2.0).orderBy("epoch", "place").collect()]
    assert got == want and len(got) > len(set(got)) == docs.count()


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert 0 < good.count() < docs.count()
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert one.select("text").distinct().count() == one.count() < docs.count()
    clean = corpus_pipeline.secret_scan(spark, docs, SF)
    left = lambda d: secret_links.report(d).selectExpr("sum(n_assign + n_access + n_hex)").first()[0]
    assert clean.count() == docs.count() and left(clean) == 0 < left(docs)
