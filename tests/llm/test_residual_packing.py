import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import residual_packing as p

from .conftest import SF

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def want_pieces(text, size=1024):
    ids = [*LIB.encode(text or "", add_special_tokens=False).ids, 2]
    first = (len(ids) - 1) % size + 1
    cuts = [0, *range(first, len(ids) + 1, size)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_sequences(rows, size):
    """Places are gapless from 0, nothing is over the size; gives the number of sequences and the least number possible."""
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held), -(-sum(length for *_, length in rows) // size)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = p.packed_documents(docs, PATH, P.PATTERN).collect()
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in docs.select("doc_id", "text").collect():
        assert sorted(of[doc_id]) == want_pieces(text)
    n, least = check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert n <= least * 1.02 + 1


def test_odd_rows(spark, odd_docs):
    got = p.packed_documents(odd_docs, PATH, P.PATTERN, size=64).collect()
    want = sorted((repr(d), *x) for d, t in odd_docs.select("doc_id", "text").collect() for x in want_pieces(t, 64))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 64)
    assert p.packed_documents(odd_docs.limit(0), PATH, P.PATTERN).collect() == []


@pytest.mark.parametrize("text", [" " * 400_000 + "x", "a<|endoftext|>b <|endoftext|>", "\n" * 300_000, "é😀中文 don't we'LL 'll  x\t\n y" * 9])
def test_ids_are_the_librarys(text):
    assert p.Encoder.of(PATH, P.PATTERN)(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert p.Encoder.of(PATH, P.PATTERN)(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_leaves_least_room(lengths):
    bins, places = p.best_fit(lengths, 20)
    rooms = []
    for length, bin_, place in zip(lengths, bins, places):
        fits = [r for r in rooms if r >= length]
        if not fits:
            rooms.append(20)
            assert bin_ == len(rooms) - 1
        else:
            assert rooms[bin_] == min(fits)
        assert place == 20 - rooms[bin_]
        rooms[bin_] -= length


@pytest.mark.parametrize("kind", ["mixed", "large", "hot", "small"])
def test_tree_of_nodes(spark, monkeypatch, kind):
    monkeypatch.setattr(p, "ITEMS", 8)
    monkeypatch.setattr(p, "FAN", 2)
    lengths = {"mixed": F.expr("1 + pmod(hash(id), 100)"), "large": F.when(F.col("id") % 40 == 0, 30).otherwise(60), "hot": F.when(F.col("id") % 3 == 0, 51).otherwise(F.expr("1 + pmod(hash(id), 99)")), "small": F.lit(3)}[kind]
    items = spark.range(400).select(F.col("id").alias("item"), lengths.cast("long").alias("length"))
    rows = p.pack(items, 100).collect()
    assert sorted(r.item for r in rows) == list(range(400))
    n, least = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 100)
    whole = len(set(p.best_fit(sorted((r.length for r in rows), reverse=True), 100)[0]))
    alone = sum(len(set(p.best_fit(sorted((r.length for r in rows if r.item % 50 == k), reverse=True), 100)[0])) for k in range(50))
    assert least <= n <= alone and n <= whole * 1.12 + 1
