import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstack.llm import prefix_tokens as p

from .conftest import SF

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SPECIAL = "<|endoftext|>"


def size(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


def check_prefixes(text):
    got = p.Counter.of(PATH, P.PATTERN).prefix_counts(text)
    inside = {k + j for k in range(len(text)) if text.startswith(SPECIAL, k) for j in range(1, len(SPECIAL))}
    for i in range(len(text) + 1):
        if i not in inside:
            assert got[len(text[:i].encode())] == size(text[:i]), text[:i]


def test_every_prefix_of_odd_texts():
    for text in ["", "a" * 90, "é" * 40, " " * 70 + "x", "😀" * 9, "x" * 33, f"a{SPECIAL}b  {SPECIAL}  c <|endof", "'ll'LL don't we're they've", "\r\n\t\n  a", "0" * 50, "中文" * 9, "a   b \n\n  c　  d", "==========  ----- !!!??"]:
        check_prefixes(text)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab'rel v<|endoftext|> \n!st", max_size=60)))
def test_every_prefix_of_any_text(text):
    check_prefixes(text)


def test_documents_and_truncation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in p.with_counts(docs, PATH, P.PATTERN, 100, keep=["doc_id", "text"]).collect():
        n = size(r.text)
        raw = r.text.encode()
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(raw), n, n > 100)
        if n > 100:
            assert size(raw[: r.fit_bytes].decode()) <= 100
            longer = raw[: r.fit_bytes + 4].decode(errors="ignore")
            assert size(longer) > 100 or len(longer.encode()) <= r.fit_bytes
        else:
            assert r.fit_bytes == len(raw)


def test_stored_prefixes_answer_other_limits(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "")], "doc_id long, text string")
    stored = p.with_counts(docs, PATH, P.PATTERN, 1024, prefixes=True)
    got = {r.doc_id: r.fit_bytes for r in p.longest_within(stored, 3).collect()}
    assert got == {1: len("one two three"), 2: 0}


def test_stored_steps_are_the_counts_at_every_prefix(spark):
    texts = ["one  two", f"a{SPECIAL}b   c", "a   b \n\n  c　  d", "", None, "é" * 40 + "  x", "don't  we're"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in p.with_counts(docs, PATH, P.PATTERN, 1024, steps=True).collect():
        counts = p.counts_of(r.prefix_steps)
        text = r.text or ""
        inside = {k + j for k in range(len(text)) if text.startswith(SPECIAL, k) for j in range(1, len(SPECIAL))}
        assert len(counts) == r.n_bytes + 1 and counts[-1] == r.n_tokens
        for i in set(range(len(text) + 1)) - inside:
            assert counts[len(text[:i].encode())] == size(text[:i]), text[:i]


def test_steps_that_need_more_than_a_byte_are_refused():
    assert p._byte_steps(np.array([127, -128, 0])) == b"\x7f\x80\x00" and p._byte_steps(np.zeros(0, np.int64)) == b""
    with pytest.raises(ValueError):
        p._byte_steps(np.array([128]))


def test_odd_rows_and_cache(spark, odd_docs, monkeypatch):
    for r in p.with_counts(odd_docs, PATH, P.PATTERN, 1024).collect():
        assert r.n_tokens == size(r.text or "") and r.n_bytes == len((r.text or "").encode())
    assert p.with_counts(odd_docs.limit(0), PATH, P.PATTERN, 9).count() == 0
    monkeypatch.setattr(p, "CACHE", 3)
    monkeypatch.setattr(p, "PAIRS", 16)
    texts = [f"word{i} number {i * 7} " * 3 for i in range(2100)]
    counter = p.Counter(PATH, P.PATTERN)
    assert [sum(x - 256 if x > 127 else x for x in s) for s in counter.steps(texts)] == [size(t) for t in texts]
