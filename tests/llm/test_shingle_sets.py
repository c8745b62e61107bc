import random
import re

import corpus_pipeline
import numpy as np

from quillstack.llm import shingle_sets as ss

from .conftest import SF


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """doc_ids that stay: the smallest of each component of pairs with Jaccard >= 0.8."""
    sets, root = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}
    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()} if low != high else root
    return sorted(set(root.values()))


def changed(r, words, similarity):
    """A copy with single words replaced until its similarity is just at or above the given one."""
    out, best = list(words), list(words)
    own = shingles(" ".join(words))
    while True:
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
        new = shingles(" ".join(out))
        if len(own & new) < similarity * len(own | new):
            return best
        best = list(out)


def test_planted_near_copies_go(spark):
    r = random.Random(5)
    texts = {}
    for group in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 300))]
        texts[len(texts)] = " ".join(words)
        for similarity in (0.8, 0.85, 0.95):
            texts[len(texts)] = " ".join(changed(r, words, similarity))
        # well below
        texts[len(texts)] = " ".join(words[: len(words) // 2] + [f"y{group}_{i}" for i in range(len(words) // 2)])
    want = brute_kept(texts)
    assert 40 <= len(want) <= 80
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_stage_on_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == brute_kept(texts)


def test_hot_keys_are_compared_block_by_block(spark, monkeypatch):
    """Chains of copies in one key whose ends are not similar: blocks of two members find the same components as whole keys."""
    base = np.arange(200)
    sets = {100 * c + i: np.r_[c * 1000, base[7 * i : 7 * i + 100]] for c in range(3) for i in range(9)}
    members = spark.createDataFrame([(k, 1) for k in sets], "set long, band long")
    hashes = spark.createDataFrame([(k, v.tolist()) for k, v in sets.items()], "set long, hashes array<long>")
    roots = spark.createDataFrame([], "node long, root long")

    def components():
        root = {k: k for k in sets}
        for r in ss.between_components(members, roots, hashes).collect():
            assert len(np.intersect1d(sets[r.a], sets[r.b])) >= 0.8 * len(np.union1d(sets[r.a], sets[r.b]))
            low, high = sorted((root[r.a], root[r.b]))
            root = {k: low if x == high else x for k, x in root.items()}
        return root

    whole = components()
    assert len(set(whole.values())) < len(sets)
    monkeypatch.setattr(ss, "MEMBERS", 2)
    assert components() == whole


def test_pairs_across_components_without_a_similar_leader():
    """A chain whose ends are not similar: the middle joins them, whichever is the leader."""
    sets = [np.arange(0, 100), np.arange(8, 108), np.arange(16, 116), np.arange(500, 600)]
    links = list(ss._across([x.astype(np.int64) for x in sets], np.arange(4)))
    assert sorted(map(sorted, links)) == [[0, 1], [1, 2]]
    assert not list(ss._across([x.astype(np.int64) for x in sets[:3]], np.zeros(3, np.int64)))
