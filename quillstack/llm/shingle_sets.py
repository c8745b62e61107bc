"""Pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Shingles: texts are lower-cased in A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and 5 of them in a row are a shingle (fewer
words: the whole sequence). A text is known by a hash of its set; texts with the same set are one node.

Candidates: MinHash, ``BANDS`` keys of ``ROWS`` minima each. A pair of similarity 0.8 shares no key with a probability of
(1 - 0.8 ** ROWS) ** BANDS, 3 in a million, and less above. Callers may add pairs of their own. Every candidate is checked on
whole sets, so no pair below 0.8 is linked. Members of a key are checked against its smallest member first, in a join; only in
keys of three members or more that are then in several components are all pairs across components checked. Such a key is dealt to blocks of
some ``MEMBERS``, and a task compares two blocks, so none holds a whole key.

Defined cases: texts without words, nulls among them, have the same empty set; they have no key and no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm._text import Words, blocks, mix, utf8

SHINGLE = 5
ROWS, BANDS = 4, 24
BLOCK = 1 << 18  # bytes of text taken together
MEMBERS = 512  # of a key, compared with as many in a task

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many by text): each text's distinct shingles, sorted."""
    w = Words(_LOWER[data], offsets)
    w.prefix_hash()
    word = w.span_hash(w.start, w.end)
    first = np.cumsum(w.per_doc) - w.per_doc
    keys, docs = [], []
    for k in range(1, shingle + 1):
        # texts of k words, or all longer ones
        some = w.per_doc == k if k < shingle else w.per_doc >= k
        each = (w.per_doc[some] - k + 1).astype(np.int64)
        at = np.repeat(first[some], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        key = np.full(len(at), k, np.uint64)
        for i in range(k):
            key = key * np.uint64(0x9FB21C651E98DF25) + word[at + i]
        keys.append(mix(key))
        docs.append(np.repeat(np.flatnonzero(some), each))
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], np.bincount(doc[new], minlength=w.n_docs)


def sketch(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each set (zero if empty), and the band keys of those that are not empty."""
    some = np.flatnonzero(counts)
    name = np.zeros(len(counts), np.uint64)
    if not len(some):
        return name, np.zeros((0, BANDS), np.uint64)
    first = (np.cumsum(counts) - counts)[some]
    name[some] = mix(np.add.reduceat(mix(hashes + np.uint64(1)), first) + counts[some].astype(np.uint64))
    out = np.zeros((len(some), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(some), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + np.minimum.reduceat(hashes * _TIMES[i] + _PLUS[i], first))
        out[:, band] = key
    return name, out


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns of set hashes and of lists of band keys."""
    names, bands, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in blocks(offsets, BLOCK):
        hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        name, keys = sketch(hashes, counts)
        names.append(name), bands.append(keys.ravel()), sizes.append(np.where(counts > 0, BANDS, 0))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(bands).view(np.int64)))
    return pa.array(np.concatenate(names).view(np.int64)), lists


def with_hashes(named: DataFrame) -> DataFrame:
    """(set, hashes) of ``named`` (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets, BLOCK):
                hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["set", "hashes"])

    return named.select("set", "text").mapInArrow(run, "set long, hashes array<long>")


def similar(a: Column, b: Column) -> Column:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar; ``sets`` (set, hashes)."""
    left = sets.select(F.col("set").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").where(similar(F.col("left"), F.col("right"))).select("a", "b")


def _across(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs between components, given each set's component; with ``side``, of pairs across the two sides."""
    sizes = np.array([len(x) for x in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    root = np.unique(root, return_inverse=True)[1]
    mark = np.zeros(which.max() + 1, np.int64)
    for i in range(len(sets)):
        open_ = root != root[i]
        if side is not None:
            open_ &= side & ~side[i]  # from the first side to the second
        if not open_.any():
            continue
        own = which[first[i] : first[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[which], first)
        mark[own] = 0
        for j in np.flatnonzero((9 * both >= 4 * (sizes + sizes[i])) & open_):
            if root[i] != root[j]:
                yield i, int(j)
                root[root == root[j]] = root[i]


def between_components(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) that join components; ``members`` (set, band), ``roots`` (node, root)."""
    rooted = members.join(roots, members["set"] == roots["node"], "left").select("band", "set", F.coalesce("root", "set").alias("root"))
    # a pair is checked already; of keys with the same members one is enough
    about = F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("who"), F.sum(F.col("set") % 1000003).alias("sum")
    several = rooted.groupBy("band").agg(*about).where("low < high AND n > 2").groupBy("n", "who", "sum").agg(F.min("band").alias("band")).select("band", "n")
    # a member meets every block of its key
    several = several.select("band", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
    dealt = rooted.join(several, "band").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "set", "root", F.least("own", "met").alias("first"), F.greatest("own", "met").alias("second"), (F.col("own") > F.col("met")).alias("later"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name = table.column("set").to_numpy()
        side = table.column("later").to_numpy(zero_copy_only=False) if key[1].as_py() != key[2].as_py() else None
        found = list(_across([np.asarray(x.values) for x in table.column("hashes")], table.column("root").to_numpy(), side))
        pair = name[np.array(found, np.int64).reshape(-1, 2)]
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return dealt.join(sets, "set").groupBy("band", "first", "second").applyInArrow(run, "a long, b long").distinct()
