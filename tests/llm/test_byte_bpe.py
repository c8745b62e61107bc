import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import byte_bpe as b

from .conftest import SF

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIB = library()


def mine(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in b.Codec.of(PATH, P.PATTERN).encode(texts)]


def test_odd_texts():
    odd = ["", None, "a" * 3000, "ab" * 700, "é" * 900, " " * 3000 + "x", "😀" * 300, "x" * 256, "y" * 257, "<|endoftext|>", "'ll'LL don't", "\r\n\t\n  a", "0" * 1000, "中文" * 400, "\x00\x01"]
    assert mine(odd) == [LIB.encode_ordinary(t or "") for t in odd]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text_round_trips(texts):
    codec = b.Codec.of(PATH, P.PATTERN)
    ids = mine(texts)
    assert ids == [LIB.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(i, np.int32)).tobytes().decode() for i in ids] == texts


def one_by_one(codec, raw):
    """The leftmost pair of minimum rank, again and again."""
    ids = codec.byte[np.frombuffer(raw, np.uint8)].tolist()
    while len(ids) > 1:
        ranks = codec.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        at = int(ranks.argmin())
        if ranks[at] == b._NONE:
            break
        ids[at : at + 2] = [int(ranks[at])]
    return ids


def test_matrix_and_long_rows_merge_alike():
    codec = b.Codec.of(PATH, P.PATTERN)
    r = np.random.default_rng(1)
    for letters in (b"aeiou nstr", b"a", b"ab", b"=-", b"aA=0 \n", bytes(range(256))):
        for size in (1, 2, 3, 7, 60, 200):
            for _ in range(10):
                raw = bytes(r.choice(list(letters), size).astype(np.uint8))
                want = one_by_one(codec, raw)
                row = codec.encode_rows(codec.byte[np.frombuffer(raw, np.uint8)][None, :])[0]
                assert row[row >= 0].tolist() == want
                assert codec.encode_long(raw).tolist() == want


def lower_pairs(codec, piece):
    """How often a merge makes a pair of lower rank."""
    ids, n, last = codec.byte[np.frombuffer(piece, np.uint8)].tolist(), 0, -1
    while len(ids) > 1:
        ranks = codec.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        at = int(ranks.argmin())
        if ranks[at] == b._NONE:
            break
        n, last = n + (ranks[at] < last), int(ranks[at])
        ids[at : at + 2] = [last]
    return n


def test_long_pieces_as_the_library():
    r = np.random.default_rng(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(r.choice(list(letters), n)) for n in (257, 1000, 5000)]
    texts += ["".join(r.choice(list("=-*#"), n)) for n in (300, 4000)]
    texts += [" " * 999 + "\n" * 999, "ab" * 4001, "aab" * 2001, "the" * 900 + "re" * 900, "日本語" * 777]
    assert mine(texts) == [LIB.encode_ordinary(t) for t in texts]


def test_a_merge_that_makes_a_lower_pair_is_followed_by_it():
    """Ranks where (ab, c) comes before (a, b), as trained vocabularies seldom have."""
    codec = b.Codec.__new__(b.Codec)
    tokens = [bytes([i]) for i in range(97, 101)] + [b"abc", b"dab", b"ab", b"abcab"]
    rank = {t: i for i, t in enumerate(tokens)}
    codec.byte = np.full(256, -1, np.int32)
    codec.byte[97:101] = range(4)
    pairs = [(rank[t[:i]], rank[t[i:]], k) for t, k in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
    codec.table = b.IntTable(len(pairs))
    codec.table.put(np.array([(x << 32) | y for x, y, _ in pairs], np.int64), np.array([k for *_, k in pairs], np.int32))
    r = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        raw = bytes(r.choice([97, 98, 99, 100], 40).astype(np.uint8))
        met += lower_pairs(codec, raw)
        assert codec.encode_long(raw).tolist() == one_by_one(codec, raw)
    assert met


def test_cache_may_be_dropped(monkeypatch):
    monkeypatch.setattr(b, "CACHE", 3)
    texts = [f"word{i} number {i * 7}" for i in range(600)]
    assert mine(texts) == [LIB.encode_ordinary(t) for t in texts]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in b.digests(docs, PATH, P.PATTERN).collect():
        ids = LIB.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd_docs):
    got = b.encode(odd_docs, PATH, P.PATTERN)
    assert sorted(got.columns) == sorted(odd_docs.columns)
    assert dict(got.dtypes)["ids"] == "array<int>"
    for r in got.collect():
        assert r.ids == LIB.encode_ordinary(r.text or "")
    apart = b.decode(b.encode(odd_docs, PATH, P.PATTERN, keep=["text"]), PATH, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in apart.collect())
    digests = b.digests(odd_docs, PATH, P.PATTERN)
    assert digests.where((F.col("doc_id") == 3) & (F.col("n_tokens") == 0)).count() == 1
    assert b.digests(odd_docs.limit(0), PATH, P.PATTERN).count() == 0
