import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillstack.llm import simhash_trie as s

from .conftest import SF


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest key reachable; prints: key -> fingerprint."""
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in prints}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    roots = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_duplicates(docs).collect()}
    assert got == {k: (f"{v:016x}", roots[k]) for k, v in prints.items()}


def test_links_of_crowded_fingerprints(spark):
    """Chains and balls of fingerprints around a few centres, over cells of four."""
    r = random.Random(3)
    prints = {}
    for centre in range(12):
        at = r.getrandbits(64)
        for _ in range(25):
            for _ in range(r.randint(0, 5)):
                at ^= 1 << r.randrange(64)
            prints[len(prints)] = at
    prints |= {len(prints) + i: r.getrandbits(64) for i in range(200)}
    roots = brute_components(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(v)) for k, v in prints.items()], "doc_id long, fp long")
    groups = df.select("fp").distinct()
    edges = s.links(groups, groups.count(), cell=4)
    for e in edges.collect():
        assert e.a != e.b
    by = {r.node: r.root for r in s.components(edges).collect()}
    got = {}
    for k, v in prints.items():
        got.setdefault(by.get(signed(v), signed(v)), set()).add(k)
    want = {}
    for k, v in roots.items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_crowded_prefixes_are_divided(spark):
    """A third of all fingerprints share their first bits."""
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(800)] + [(0x5A5 << 52) | r.getrandbits(52) for _ in range(400)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "key long").withColumn("turn", F.lit(0))
    assert s._depth(df, 1200, 4) >= 12 and s._depth(df, 1200, 400) == 4
    assert s._depth(df.limit(0), 0, 4) == 4


def test_cells_beyond_the_deepest_prefix_are_divided(spark, monkeypatch):
    """Most fingerprints share 40 bits; with a small limit their cells are divided several times, and no link is lost."""
    r = random.Random(12)
    prints = {(0xABCDE12345 << 24) | r.getrandbits(24) for _ in range(600)} | {r.getrandbits(64) for _ in range(100)}
    prints |= {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in list(prints)[:60]}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = s.written(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), "test")
    whole = s.links(df, len(prints)).collect()
    monkeypatch.setattr(s, "LIMIT", 20)
    monkeypatch.setattr(s, "CELL", 4)
    divided = []
    keep = s.written
    monkeypatch.setattr(s, "written", lambda d, name: divided.append(name) or keep(d, name))
    again = s.links(df, len(prints)).collect()
    assert divided.count("cells") >= 2

    def roots(edges):
        root = {signed(x): signed(x) for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    assert roots(whole) == roots(again)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 64 for a, b in again)


def test_pairs_are_exactly_those_within_the_budget():
    r = np.random.default_rng(1)
    own = np.unique(np.concatenate([(np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)) ^ np.uint64(0xF0F0), r.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    # one cell of everything: no lead limit
    found = {(int(a), int(b)) for i, j in s._pairs(own, 0, 4, 4, 21) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if bin(int(own[i] ^ own[j])).count("1") <= 4}
    assert found == want


def test_odd_rows(spark, odd_docs):
    got = s.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {3, 4, None, 7} and {r.component_id for r in empty} == {3}
    same = {r.component_id for r in got if r.doc_id in (1, 2, 9)}
    assert same == {1}
    kept = s.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [r.doc_id for r in kept.where(F.col("doc_id").isin(1, 2, 9)).collect()] == [1]
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id = 4").count() == 0


def test_empty(spark, odd_docs):
    assert s.near_duplicates(odd_docs.limit(0)).count() == 0
    assert s.keep_one(odd_docs.limit(0)).count() == 0
