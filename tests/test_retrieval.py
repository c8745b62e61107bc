"""Keyword search, approximate vectors and both on small frames."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import ann, hybrid, search
from quillstack.operators import keywords as kw

SCHEMA = "doc_id long, text string, lang string"


def plain_bm25(docs, queries, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t, _ in docs if i is not None}
    n, mean = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for query, asked in queries:
        scores = Counter()
        for i, ws in words.items():
            for w in set(asked):
                if tf := ws.count(w):
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] += math.floor(1e6 * idf * tf * (kw.K1 + 1) / (tf + kw.K1 * (1 - kw.B + kw.B * len(ws) / mean)))
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(query, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=weights / weights.sum())), ["en", "de", None][i % 3]) for i in range(150)]
    return [*rows, (200, None, "en"), (201, "", "en"), (202, " .,; ", None), (None, "w1 w2", "en"), (203, rows[0][1], "en"), (204, rows[0][1].upper(), "de"), (205, "x" * 5000 + " w1", None), (206, "Été w1-w2_w3", "fr")]


@pytest.mark.parametrize("k, first, per_block", [(5, 1, 8), (3, 4, 4), (400, 2, 64)])
def test_keywords_against_brute_force(spark, docs, k, first, per_block):
    queries = [(i, t.lower().split()[:6]) for i, t, _ in docs[:12]] + [(900, ["nothing"]), (901, []), (902, ["w59", "w59", "w1"]), (903, ["été"])]
    index = kw.index(spark.createDataFrame(docs, SCHEMA), cluster=["lang"], per_block=per_block)
    got = kw.top_k(index, spark.createDataFrame(queries, "query long, words array<string>"), k, first)
    assert sorted(tuple(r) for r in got.collect()) == plain_bm25(docs, queries, k)


def test_many_parts_and_groups_keep_few_rows(spark, docs, monkeypatch):
    """a query in a block was a row, and so was each of its terms there; now no more than the first blocks of each part are."""
    monkeypatch.setattr(kw, "PART", 400), monkeypatch.setattr(kw, "ASKED", 20), monkeypatch.setattr(kw, "AT_ONCE", 3)
    queries = [(i, t.lower().split()[:6]) for i, t, _ in docs[:12]] + [(900, ["nothing"]), (901, None)]
    asked = spark.createDataFrame(queries, "query long, words array<string>")
    index = kw.index(spark.createDataFrame(docs, SCHEMA), cluster=["lang"], per_block=4)
    assert index.parts > 4
    _, firsts, n_blocks = kw.plan(index, asked, 5, 2)
    assert firsts.count() == 24 and n_blocks.agg(F.min("n_blocks")).first()[0] > 2
    got = kw.top_k(index, asked, 5, 2)
    assert sorted(tuple(r) for r in got.collect()) == plain_bm25(docs, [(q, w or []) for q, w in queries], 5)


def test_few_rows_and_late_lookups(spark, docs, monkeypatch):
    """the index had a row for each term in a block; now parts have few rows. Thresholds of the first parts and words looked up late leave the results as they are, and queries of the same words are one."""
    for name, value in (("PART", 400), ("ASKED", 20), ("AT_ONCE", 3), ("SOME", 4), ("OFTEN", 1000), ("LATER", 0.9), ("AT_A_TIME", 32)):
        monkeypatch.setattr(kw, name, value)
    queries = [(i, t.lower().split()[:6]) for i, t, _ in docs[:12]] + [(800 + i, t.lower().split()[:6][::-1]) for i, t, _ in docs[:5]] + [(900, ["nothing"]), (901, None), (902, ["w1", "été"])]
    asked = spark.createDataFrame(queries, "query long, words array<string>")
    index = kw.index(spark.createDataFrame(docs, SCHEMA), cluster=["lang"], per_block=4)
    assert index.parts > 4 and index.lists.count() <= 2 * index.parts
    once, members = kw._once(kw._asked(index, asked))
    assert once.count() < members.count() == 18
    for k in (1, 5):
        assert sorted(tuple(r) for r in kw.top_k(index, asked, k).collect()) == plain_bm25(docs, [(q, w or []) for q, w in queries], k)


def test_sums_beyond_32_bits_and_words_worth_nothing():
    """sums are of 32 bits where none can be larger."""
    at, word, start = np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([0, 2, 3])
    item = np.array([0, 2, 2])
    for value in ([2**30, 2**31 - 5, 2**30], [3, 4, 5], [3, 0, 5]):
        value = np.array(value, np.int64)
        most = np.array([value[:2].max(), value[2]])
        want = [[value[0], -1, value[1] + value[2]], [value[0], -1, value[1]]]
        assert kw._sums(at, word, item, start, value, most, (2, 3)).tolist() == want
        table = np.array([[value[0], 0, value[1]]], np.int32)
        assert kw._sums(at, word, item, start, value, most, (2, 3), table, np.array([0, -1])).tolist() == want


def test_few_blocks_of_each_part_move_on(spark, docs, monkeypatch):
    """each part sent its first blocks of every query; now only those that reach what a few parts' first blocks do."""
    queries = [(i, t.lower().split()[:6]) for i, t, _ in docs[:40]]
    asked, table = spark.createDataFrame(queries, "query long, words array<string>"), spark.createDataFrame(docs, SCHEMA)
    want = sorted(tuple(r) for r in kw.blocks_read(kw.index(table, cluster=["lang"], per_block=4), asked, 5, 2).collect())
    monkeypatch.setattr(kw, "PART", 100), monkeypatch.setattr(kw, "AT_ONCE", 3)
    if hasattr(kw, "SOME"):
        monkeypatch.setattr(kw, "SOME", 4)
    index = kw.index(table, cluster=["lang"], per_block=4)
    assert index.parts > 16
    kept, store = {}, kw.stored

    def keep(rows, name):
        kept[name] = store(rows, name)
        return kept[name]

    monkeypatch.setattr(kw, "stored", keep)
    assert sorted(tuple(r) for r in kw.blocks_read(index, asked, 5, 2).collect()) == want
    assert kept["top"].where("bound IS NOT NULL").count() < 40 * 2 * index.parts / 4


def test_rare_terms_read_few_blocks(spark):
    """Block maxima rule out what can't reach the threshold: most blocks hold the common word only."""
    rows = [(i, "common " * 3 + ("rare " * 4 if i % 100 == 7 else f"other{i} other{i + 1} ") * 1, "en") for i in range(1000)]
    index = kw.index(spark.createDataFrame(rows, SCHEMA), per_block=10)
    queries = spark.createDataFrame([(1, ["common", "rare"])], "query long, words array<string>")
    read = kw.blocks_read(index, queries, 5, first=10).first()
    assert read.n_blocks > 60 and read.n_read <= 20
    assert {r.doc % 100 for r in kw.top_k(index, queries, 5, first=10).collect()} == {7}


def test_keywords_of_an_empty_table(spark):
    index = kw.index(spark.createDataFrame([], SCHEMA))
    assert kw.top_k(index, spark.createDataFrame([(1, ["a"])], "query long, words array<string>"), 5).collect() == []


def test_scans_for_terms_are_pushed_down(spark, docs):
    index = kw.index(spark.createDataFrame(docs, SCHEMA))
    plan = index.table.where(F.col("term") == "w1").select("term", "best")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w1)" in plan and "postings" not in plan.split("ReadSchema")[1]


# approximate vectors


def exact(vectors, queries, k):
    ids, x = list(vectors), np.array(list(vectors.values()))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for name, q in queries.items():
        d = 1 - x @ (np.array(q) / np.linalg.norm(q))
        out[name] = [ids[i] for i in np.lexsort((ids, np.round(d, 12)))[:k]]
    return out


VECTORS = "key long, v array<double>"


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_exact_distances(spark, clusters, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters or 1, 16)) * (4 if clusters else 0)
    vectors = {i: (centres[i % len(centres)] + rng.normal(size=16)).tolist() for i in range(900)}
    queries = {i: vectors[i] for i in range(0, 900, 30)}
    index = ann.index(spark.createDataFrame(list(vectors.items()), VECTORS), "key", "v", 16, n_parts=8)
    asked = spark.createDataFrame(list(queries.items()), "query long, vector array<double>")
    got = ann.top_k(index, asked, 10).collect()
    want = exact(vectors, queries, 10)
    assert sum(r.key in want[r.query] for r in got) >= 0.9 * 10 * len(queries)
    for r in got[:40]:
        a, b = np.array(vectors[r.query]), np.array(vectors[r.key])
        assert r.score == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
    share = ann.visited(index, asked).agg(F.avg("share")).first()[0]
    assert share < (0.35 if clusters else 0.95)
    assert all(sorted(x.rank for x in got if x.query == q) == list(range(1, 11)) for q in queries)


def test_every_cell_and_row_visited_is_exact_search(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=8).tolist() for i in range(120)}
    index = ann.index(spark.createDataFrame(list(vectors.items()), VECTORS), "key", "v", 8, n_cells=5, n_parts=4)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(9)], "query long, vector array<double>")
    got = ann.top_k(index, asked, 7, probes=5, rerank=120).orderBy("query", "rank").collect()
    want = exact(vectors, {i: vectors[i] for i in range(9)}, 7)
    assert {q: [r.key for r in got if r.query == q] for q in range(9)} == want


def test_candidates_are_few_rows_of_each_block(spark, monkeypatch):
    """each cell sent its best of every query; now each block does, whatever cells it holds."""
    monkeypatch.setattr(ann, "BLOCK", 100), monkeypatch.setattr(ann, "ASKED", 4)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).tolist() for i in range(300)}
    index = ann.index(spark.createDataFrame(list(vectors.items()), VECTORS), "key", "v", 8, n_cells=30, n_parts=4)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(10)], "query long, vector array<double>")
    assert sorted(r.block for r in index.table.select("block").distinct().collect()) == [0, 1, 2]
    units = ann.unit(asked, "query", "vector", 8).withColumnRenamed("key", "query")
    plan = ann.candidates(index, units, 30, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # no row for a query and a cell
    got = ann.top_k(index, asked, 5, probes=30, rerank=300).orderBy("query", "rank").collect()
    assert {q: [r.key for r in got if r.query == q] for q in range(10)} == exact(vectors, {i: vectors[i] for i in range(10)}, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [2.0, 0.1])]
    index = ann.index(spark.createDataFrame(rows, VECTORS), "key", "v", 2, n_parts=2)
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query long, vector array<double>")
    assert [(r.query, r.rank, r.key) for r in ann.top_k(index, asked, 5).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 8), (1, 3, 9)]
    empty = ann.index(spark.createDataFrame([], VECTORS), "key", "v", 2, n_parts=2)
    assert ann.top_k(empty, asked, 5).collect() == []


# both


def test_hybrid_against_scoring_everything(spark, docs):
    rng = np.random.default_rng(11)
    vectors = {i: rng.normal(size=6).tolist() for i in [*range(0, 150, 2), 203, 5000, 5001]}  # fewer than texts, and two without a text
    words = {i: re.findall(r"[^\W_]+", (t or "").lower())[:5] for i, t, _ in docs if i is not None}
    queries = [(0, words[0], vectors[0]), (3, words[3], None), (4, [], vectors[4]), (5, ["nothing"], [0.0] * 6), (None, words[6], vectors[6]), (8, words[8], vectors[8]), (9, None, vectors[10])]
    index = kw.index(spark.createDataFrame(docs, SCHEMA), cluster=["lang"], per_block=8)
    table = spark.createDataFrame([*vectors.items(), (7000, None), (7001, [0.0] * 6)], "doc long, vector array<double>")
    got = hybrid.top_k(index, table, spark.createDataFrame(queries, "query long, words array<string>, vector array<double>"), 6, 6, weight=3, depth=2).collect()
    by_words = {(q, d): s for q, _, d, s in plain_bm25(docs, [(q, w or []) for q, w, _ in queries if q is not None], 10**6)}
    want = []
    for q, _, v in queries:
        if q is None:
            continue
        scores = {d: s for (a, d), s in by_words.items() if a == q}
        for d, x in vectors.items() if v is not None and any(v) else ():
            cosine = np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)
            scores[d] = scores.get(d, 0) + 3 * max(0, round(1e6 * cosine))
        best = sorted(((-s, d) for d, s in scores.items() if s > 0))[:6]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(best)]
    assert sorted((r.query, r["rank"], r.doc, r.score) for r in got) == sorted(want)
    assert len({r.depth for r in got}) > 1  # some queries had to go deeper than others


def test_hybrid_lists_stay_short(spark, docs, monkeypatch):
    """lists grew until a query was sure, up to all documents; the rest is now found by its threshold in the parts of the index."""
    monkeypatch.setattr(kw, "PART", 400), monkeypatch.setattr(hybrid, "LONGEST", 3, raising=False)
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(0, 150, 2)], "doc long, vector array<double>")  # all alike: no list is ever deep enough
    asked = spark.createDataFrame([(1, ["w1", "w2"], [1.0, 0.0]), (2, None, [1.0, 0.0])], "query long, words array<string>, vector array<double>")
    got = hybrid.top_k(kw.index(spark.createDataFrame(docs, SCHEMA)), table, asked, 3, 2, depth=2).collect()
    scores = {d: s + 5_000_000 * (d % 2 == 0 and d < 150) for _, _, d, s in plain_bm25(docs, [(1, ["w1", "w2"])], 10**6)}
    best = sorted((-s, d) for d, s in scores.items())[:3]
    assert sorted((r["rank"], r.doc, r.score) for r in got if r.query == 1) == [(i + 1, d, -s) for i, (s, d) in enumerate(best)]
    assert sorted((r["rank"], r.doc, r.score) for r in got if r.query == 2) == [(i + 1, 2 * i, 5_000_000) for i in range(3)]
    assert {r.depth for r in got} <= {2, None}


def test_few_vectors_are_scored_again(spark):
    """F2: every vector was scored and sorted for each query; now those that a product puts within reach."""
    nan = float("nan")
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    x[100:200] = x[:100]
    q = rng.normal(size=(70, 8))
    near = search._near(x, (x * x).sum(axis=1), q, 5)
    assert all(5 <= len(n) <= 10 for n in near)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, [nan] + [1.0] * 7), (902, [1e200] * 8), (903, [1.0] * 7), (904, [1.0] * 7)]
    asked = [(i, v.tolist()) for i, v in enumerate(q)] + [(500, [0.0] * 8), (501, [1e200] * 8), (502, [1.0] * 7)]
    got = search.top_k_many(spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(asked, "query long, vector array<double>"), 5).collect()
    want = exact({i: v for i, v in rows[:500]}, {i: v for i, v in asked[:70]}, 5)
    found = {i: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query == i] for i, _ in asked}
    assert {i: found[i] for i in range(70)} == want and len(found[500]) == len(found[501]) == 5 and found[502] == [903, 904]
