"""SimHash near-duplicates: fingerprints of word shingles and a binary trie self-join.

Fingerprint: texts are lower-cased in A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of 4 words
joined by spaces (fewer words: the whole sequence); a bit is 1 if set in over half the XXH64 hashes (seed 42).
Texts without words, nulls among them, have fingerprint zero.

Join: a sorted array of fingerprints is an implicit trie, a node is a range in it. Node pairs are traversed
together; where their bits differ the error grows, and a pair is dropped as soon as the error exceeds what
is allowed at its depth. The fingerprints are read in ``ORDERS`` rotations: of 4 differing bits, one third
of the word holds at most one, so within the leading third one error is allowed and 4 in all. Every link is
found in at least one rotation. Cells are the nodes at the first ``depth`` levels: a task holds one node's
fingerprints and those of nodes whose prefix has one bit cleared, and returns a spanning forest of the links
rather than the pairs. Depth follows the number of distinct fingerprints and the most crowded node, so a cell holds some thousand. A cell that stays over
``LIMIT`` although the prefix is as deep as it goes is divided by the bits behind it: cut into one piece more than bits may differ, one piece is equal
in any two linked fingerprints, so they meet in the group of that piece; groups that are still too large are divided again.

Components: alternating large-star and small-star steps over the forests' edges, all in Spark.

Defined cases: equal texts share a fingerprint and are linked; a null doc_id is never the smallest id unless
no other is in the component; repeated rows each give a row; empty tables give empty results; other columns
of the input are kept unless they clash with those produced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm import shingle_sets
from quillstack.llm._tables import by_name, drop_written, fresh, numbered, written
from quillstack.llm._text import SEPARATOR, Words, blocks, utf8

SHINGLE, MAX_DIFF, SEED = 4, 4, 42
ORDERS = 3
LEADING = 21  # bits of a rotation within which MAX_DIFF // ORDERS errors are allowed
CELL, CROWDED = 1024, 16  # fingerprints aimed at in a cell; how many times that call for more levels
BLOCK = 1 << 18  # bytes of text hashed together
LEAF = 64  # pairs compared directly below a node pair
PAIRS = 1 << 20  # pairs compared at once
LIMIT = 1 << 16  # fingerprints of a cell that one task compares; more are divided

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, least significant first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts that lie one after the other."""
    w = Words(data, offsets)
    keep = w.word | w.before
    text = np.where(SEPARATOR[data], np.uint8(32), _LOWER[data])[keep]
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    start, end = moved[w.start], moved[w.end]
    counts = w.per_doc
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    whole = memoryview(text.tobytes())
    digest, weight = xxhash.xxh64_intdigest, (np.uint64(1) << np.arange(64, dtype=np.uint64))
    out = np.zeros(len(counts), np.uint64)
    for d in np.flatnonzero(counts):
        a, b = first[d], first[d + 1]
        k = min(shingle, b - a)
        ones, n = np.zeros(64, np.int64), int(b - a - k + 1)
        for at in range(0, n, 1 << 16):
            lo, hi = a + at, a + min(n, at + (1 << 16))
            hashes = [digest(whole[s:e], seed) for s, e in zip(start[lo:hi].tolist(), end[lo + k - 1 : hi + k - 1].tolist())]
            ones += _bits(np.array(hashes, np.uint64))
        out[d] = weight[2 * ones > n].sum(dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint as a signed long in ``out``."""
    docs = fresh(docs, out)
    kept = [c for c in docs.columns if keep is None or c in keep]
    held, back = numbered(*kept)
    carried = docs.select(*held, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*held).schema.fields, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            made = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, BLOCK)]
            prints = np.concatenate(made) if made else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=schema.names)

    return carried.mapInArrow(run, schema).select(*back, out)


def _pairs(own: np.ndarray, depth: int, max_diff: int, lead_diff: int, leading: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``own`` (uint64) that differ in at most ``max_diff`` bits, by traversal of node pairs."""
    n = len(own)
    top = own >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    edges = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True])
    lo, hi, name = edges[:-1], edges[1:], top[edges[:-1]]
    a, b = np.triu_indices(len(lo))
    diff = np.bitwise_count(name[a] ^ name[b]).astype(np.int64)
    ok = diff <= lead_diff
    # the home node is the last: pairs of two guests belong to other cells
    home = len(lo) - 1
    ok &= (a == home) | (b == home)
    stack = [(depth, lo[a[ok]], hi[a[ok]], lo[b[ok]], hi[b[ok]], diff[ok])]
    ones = {}
    while stack:
        d, l1, h1, l2, h2, diff = stack.pop()
        if len(l1) > 1 and (len(l1) > 1 << 18 or np.minimum((h1 - l1) * (h2 - l2), LEAF).sum() > PAIRS):
            half = len(l1) // 2
            stack += [(d, *(x[half:] for x in (l1, h1, l2, h2, diff))), (d, *(x[:half] for x in (l1, h1, l2, h2, diff)))]
            continue
        small = ((h1 - l1) * (h2 - l2) <= LEAF) | (d == 64)
        if small.any():
            s1, n1, s2, n2 = l1[small], (h1 - l1)[small], l2[small], (h2 - l2)[small]
            each = n1 * n2
            which = np.repeat(np.arange(len(each)), each)
            within = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            i, j = s1[which] + within // n2[which], s2[which] + within % n2[which]
            ok = (i < j) & (np.bitwise_count(own[i] ^ own[j]) <= max_diff)
            if ok.any():
                yield i[ok], j[ok]
            l1, h1, l2, h2, diff = (x[~small] for x in (l1, h1, l2, h2, diff))
        if not len(l1):
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((own >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)]
        c = ones[d]
        m1, m2 = h1 - (c[h1] - c[l1]), h2 - (c[h2] - c[l2])
        same = l1 == l2
        zero, one = (l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff)
        up, down = (l1, m1, m2, h2, diff + 1), tuple(x[~same] for x in (m1, h1, l2, m2, diff + 1))
        parts = [np.concatenate(x) for x in zip(zero, one, up, down)]
        most = lead_diff if d < leading else max_diff
        ok = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= most)
        if ok.any():
            stack.append((d + 1, *(x[ok] for x in parts)))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := label[label], label):
                label = nxt
    return label


def _cell_links(own: np.ndarray, depth: int, turn: int, max_diff: int, leading: int, lead_diff: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.sort(own)
    label = _forest(len(own), _pairs(own, depth, max_diff, lead_diff, leading))
    member = np.flatnonzero(label != np.arange(len(own)))
    back = lambda x: (x >> np.uint64(turn)) | (x << np.uint64(64 - turn)) if turn else x
    return back(own[member]).view(np.int64), back(own[label[member]]).view(np.int64)


def _depth(each: DataFrame, n: int, cell: int) -> int:
    """Levels after which the average node has ``cell`` fingerprints, or more while some node has far more: crowded
    prefixes are divided further, as deep as the leading third goes."""
    depth = max(4, min(LEADING, math.ceil(math.log2(n / cell)) if n > cell else 4))
    while depth < LEADING and n > CROWDED * cell:
        sizes = each.groupBy("turn", F.shiftrightunsigned("key", 64 - depth)).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= CROWDED * cell:
            break
        depth = min(LEADING, depth + 3)
    return depth


def _divided(cells: DataFrame, each: DataFrame, n: int, depth: int, pieces: int) -> DataFrame:
    """``cells`` (turn, cell, key) with ``part``: 0, or a group within a cell of more than ``LIMIT`` fingerprints."""
    cells = cells.withColumn("part", F.lit(0).cast("long"))
    if n <= LIMIT:
        return cells
    most = each.groupBy("turn", F.shiftrightunsigned("key", 64 - depth)).count().agg(F.max("count")).first()[0] or 0
    if most * (depth + 1) <= LIMIT:  # a cell holds its own node and ``depth`` others at most
        return cells
    width = 64 - depth
    cells = cells.withColumn("rest", F.col("key").bitwiseAND((1 << width) - 1))
    place = ["turn", "cell", "part"]
    while (w := width // pieces) >= 1:
        large = written(cells.groupBy(*place).count().where(F.col("count") > LIMIT).select(*place), "large")
        if large.isEmpty():
            break
        piece = lambda i: F.shiftright("rest", i * w).bitwiseAND((1 << w) - 1)
        left = lambda i: F.shiftleft(F.shiftright("rest", (i + 1) * w), i * w).bitwiseOR(F.col("rest").bitwiseAND((1 << i * w) - 1))
        groups = F.explode(F.array(*[F.struct(F.xxhash64("part", F.lit(i), piece(i)).alias("part"), left(i).alias("rest")) for i in range(pieces)])).alias("g")
        crowded = cells.join(large, place, "left_semi").select("turn", "cell", "key", groups).select("turn", "cell", "key", "g.part", "g.rest")
        calm = cells.join(large, place, "left_anti")
        cells = written(calm.select("turn", "cell", "key", "part", "rest").unionByName(crowded), "cells")
        width -= w
    return cells.drop("rest")


def links(prints: DataFrame, n: int, max_diff: int = MAX_DIFF, cell: int = CELL) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links between distinct fingerprints ``prints.fp``; ``n`` is their number."""
    lead_diff = max_diff // ORDERS
    turns = [i * LEADING for i in range(ORDERS)]
    rotate = lambda x, t: F.shiftleft(x, t).bitwiseOR(F.shiftrightunsigned(x, 64 - t)) if t else x
    each = prints.select(F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), rotate(F.col("fp"), t).alias("key")) for t in turns])).alias("x")).select("x.*")
    depth = _depth(each, n, cell)
    home = F.shiftrightunsigned("key", 64 - depth)
    bits = [F.shiftleft(F.lit(1).cast("long"), i) for i in range(depth)]
    # a guest in every cell whose prefix has one more bit set
    cells = F.array(F.col("home"), *[F.when(F.col("home").bitwiseAND(b) == 0, F.col("home").bitwiseOR(b)) for b in bits])
    spread = each.withColumn("home", home).withColumn("cell", F.explode(F.filter(cells, lambda c: c.isNotNull()))).select("turn", "cell", "key")

    spread = _divided(spread, each, n, depth, max_diff + 1)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.column("key").to_numpy().view(np.uint64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # no pair without a fingerprint whose home is this cell, the largest prefix here
        if int(own.max() >> np.uint64(64 - depth)) == key[1].as_py():
            a, b = _cell_links(own, depth, key[0].as_py(), max_diff, LEADING, lead_diff)
        return pa.table({"a": a, "b": b})

    return spread.groupBy("turn", "cell", "part").applyInArrow(run, "a long, b long").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest reachable node."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        after = written(small.where("a <> b").distinct(), "edges")
        for done in (now, least, large, low):
            drop_written(done)
        was, state, now = state, _state(after), after
        if was == state:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def with_component(prints: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``prints`` (doc_id, fp, ...), a written table, with component_id: the smallest doc_id linked, itself included."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = written(components(links(groups, groups.count(), max_diff)), "roots")
    joined = groups.join(roots, groups.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "rooted")
    # only fingerprints with a partner need the component's smallest id
    ids = written(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    named = written(joined.join(ids, "root").select("fp", "component_id"), "named")
    for done in (groups, roots, joined, ids):
        drop_written(done)
    return fresh(prints, "component_id").join(named, "fp", "left")


def near_duplicates(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    prints = written(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    found = with_component(prints, max_diff)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, __name, fp, set and bands of ``docs`` (doc_id, __name, text), over shingles of 5 words."""
    fields = docs.select("doc_id", "__name").schema.fields
    more = [T.StructField("fp", T.LongType()), T.StructField("set", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            made = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle_sets.SHINGLE) for a, b in blocks(offsets, BLOCK)]
            prints = np.concatenate(made) if made else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints.view(np.int64)), *shingle_sets.sketches(data, offsets)], names=schema.names)

    return docs.select("doc_id", "__name", "text").mapInArrow(run, schema)


def _similar(best: DataFrame, named: DataFrame, max_diff: int) -> DataFrame:
    """Roots (node, root) of the sets of ``best`` (set, best, fp, bands) that are linked: candidates from the trie and from
    MinHash keys, each checked on whole sets."""
    prints = written(best.groupBy("fp").agg(F.min("set").alias("lead")), "prints")
    near = links(prints.select("fp"), prints.count(), max_diff)
    ends = [prints.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    same = best.join(prints, "fp").select(F.col("set").alias("a"), F.col("lead").alias("b"))
    keys = best.select("set", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("set").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    members = written(keys.join(shared, "band"), "members")
    pairs = near.unionByName(same).unionByName(members.select(F.col("set").alias("a"), F.col("lead").alias("b")))
    pairs = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = best.join(wanted, "set").select("set", F.col("best.id").alias("id"), F.col("best.name").alias("name"))
    texts = named.join(wanted, named["doc_id"].eqNullSafe(wanted["id"]) & (named["__name"] == wanted["name"])).select("set", "text")
    sets = written(shingle_sets.with_hashes(texts).groupBy("set").agg(F.first("hashes").alias("hashes")), "sets")
    edges = written(shingle_sets.checked(pairs, sets), "links")
    roots = written(components(edges), "roots")
    more = written(shingle_sets.between_components(members, roots, sets), "links")
    return roots if more.isEmpty() else written(components(edges.unionByName(more)), "roots")


def keep_one(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``docs`` without near-duplicates: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are
    linked, and of each component one row with the smallest doc_id stays (nulls last).

    Rows are known by doc_id and the digest of their text, so only numbers and the sets of candidates are written."""
    name = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    named = docs.withColumn("__name", name)
    rows = written(_sketched(named), "sketches")
    # pre-aggregated by set first: a group of copies is never gathered
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__name").alias("name"))
    best = written(rows.groupBy("set").agg(F.min(rank).alias("best"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "best")
    roots = _similar(best, named, max_diff)
    rooted = best.join(roots, best["set"] == roots["node"], "left").select(F.coalesce("root", "set").alias("root"), "best")
    stay = written(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.name"), "stay")
    kept = named.join(stay, named["doc_id"].eqNullSafe(stay["id"]) & (named["__name"] == stay["name"]), "left_semi")
    # repeated rows share the name: of those one stays
    twice = rows.join(stay, rows["doc_id"].eqNullSafe(stay["id"]) & (rows["__name"] == stay["name"]), "left_semi")
    if twice.groupBy("doc_id", "__name").count().where("count > 1").isEmpty():
        return kept.select(*by_name(*docs.columns))
    return kept.dropDuplicates(["doc_id", "__name"]).select(*by_name(*docs.columns))
