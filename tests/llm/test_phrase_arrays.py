import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import phrase_arrays as p
from quillstack.llm.oracles import SQL

from .conftest import SF, rows_of

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(rb"[^ \t]+", x) for x in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().translate(FOLD))]


def gram_counts(docs, longest=5):
    out = Counter()
    for lang, text in docs:
        for words in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    out[lang or "und", b" ".join(words[i : i + k]).decode()] += 1
    return out


def plain(docs, longest, min_count, best, inside=100):
    f = gram_counts(docs, longest)
    n = Counter()
    for lang, text in docs:
        n[lang or "und"] += sum(map(len, pieces(text)))
    candidates = {(lang, ph): c for (lang, ph), c in f.items() if c >= min_count and " " in ph}
    covered = Counter()
    for (lang, ph), c in candidates.items():
        w = ph.split(" ")
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    part = lang, " ".join(w[i:j])
                    covered[part] = max(covered[part], c)
    by = {}
    for (lang, ph), a in candidates.items():
        if 100 * covered[lang, ph] >= inside * a:
            continue
        w = ph.split(" ")
        cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, ph.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return sorted((lang, i + 1, ph.decode(), -a, left, right, n[lang], -s) for lang, rows in by.items() for i, (s, a, ph, left, right) in enumerate(sorted(rows)[:best]))


def test_documents_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(SQL["op12_phrase_arrays"].replace(">= 100)", ">= 9)").replace("count(*) >= 100", "count(*) >= 9"))
    names = [c[0] for c in found.description]
    got = p.collocations(spark.read.parquet(f"{SF}/documents.parquet"), min_count=9)
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.select(*names)) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("inside", [100, 60])
def test_against_brute_force_in_small_shards(spark, monkeypatch, inside):
    monkeypatch.setattr(p, "SHARD", 300)
    monkeypatch.setattr(p, "LEAST_BITS", 20)
    monkeypatch.setattr(p, "SALT_BYTES", 4000)
    rng = np.random.default_rng(3)
    vocabulary = ["a", "B", "cc", "Été", "eight888", "ninechars", "x" * 300, "b-b", "c|d"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " ; ", " ", " "]
    docs = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.02, 0.04, 0.04]) + rng.choice(marks, p=[0.6, 0.1, 0.1, 0.05, 0.03, 0.04, 0.02, 0.03, 0.03]) for _ in range(rng.integers(0, 90)))) for _ in range(120)]
    docs += [("en", "lorem ipsum DOLOR sit amet. ") ] * 40
    table = spark.createDataFrame([(i, lang if lang is None else str(lang), t) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string").repartition(7)
    got = sorted(tuple(r) for r in p.collocations(table, min_count=4, best=30, inside=inside).collect())
    assert got == plain(docs, 5, 4, 30, inside) and len(got) > 60


def test_buckets_that_fill_by_chance_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(p, "LEAST_BITS", 20)
    full = p._full_buckets
    monkeypatch.setattr(p, "_full_buckets", lambda *a: bytes(255 for _ in full(*a)))
    docs = [("en", "one two three four. one two"), (None, "one two"), ("en", "One two three")] * 3
    table = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in p.collocations(table, min_count=3).collect()) == plain(docs, 5, 3, 2000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "fr"]), st.text(alphabet="abAé .,\t\n", max_size=80)), min_size=1, max_size=6), st.integers(1, 7))
def test_shard_counts(docs, longest):
    shard = p.Shard([(lang, text.encode()) for lang, text in docs])
    raw, got = shard.data.tobytes(), {}
    for k, at, count, _ in shard.grams(longest):
        for i, c in zip(at.tolist(), count.tolist()):
            got[shard.langs[shard.lang[i]], b" ".join(raw[shard.start[i] : shard.end[i + k - 1]].split()).decode()] = c
    assert got == gram_counts(docs, longest)


def test_long_texts_are_cut_at_borders(monkeypatch):
    monkeypatch.setattr(p, "SHARD", 10)
    for text in (b"", b"aaa bbb ccc ddd eee", b"aa.bb,cc;dd:ee!ff?gg", b"a" * 25 + b".b", b".........." * 3):
        parts = list(p._cut(text))
        assert b"".join(parts) == text and all(x[-1:] in b".,;:!?" for x in parts[:-1])


def test_hashes_tell_words_and_languages_apart():
    words = [b"a", b"b", b"ab", b"a\0", b"abcdefgh", b"abcdefghi", b"x" * 300, b"x" * 299 + b"y", b"x" * 301]
    shard = p.Shard([(lang, b" ".join(words)) for lang in ("en", "de")])
    assert len(set(shard.word.tolist())) == 2 * len(words)


def test_packed_counts():
    at = np.array([0, 5, 300, 70_000, (1 << 20) - 1])
    got, count = p._unpack(p._pack(at, np.array([1, 2, 255, 4, 5])))
    assert got.tolist() == at.tolist() and count.tolist() == [1, 2, 255, 4, 5]


def test_odd_rows(spark, odd_docs):
    docs = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in p.collocations(odd_docs, min_count=2).collect()) == plain(docs, 5, 2, 2000)
    assert p.collocations(odd_docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [("en", 1, "a", 10**13), ("en", 1, "b", 10**13), ("en", 2, "a b", 10**13), ("en", 0, "", 3 * 10**14)]
    known = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    original = p.counts
    try:
        p.counts = lambda *a: known
        got = p.collocations(known).collect()
    finally:
        p.counts = original
    assert [tuple(r) for r in got] == [("en", 1, "a b", 10**13, 10**13, 10**13, 3 * 10**14, 30_000)]
