"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

The texts of a batch are cut into pieces; pieces not met before are grouped by length and laid into padded
matrices of token ids. In each round every row merges its leftmost pair of minimum rank: ranks come from a hash
table of id pairs, and rows are compacted after the merge; rows without a mergeable pair leave the
matrix. A piece over ``LONG`` bytes is a row by itself, where one round stands for many: it merges all pairs of the minimum rank from the left,
up to the first merge that makes a pair of a lower rank, which is next. These are the merges of as many single rounds, and
rounds number about the different ranks in the row, not its bytes. Encoded pieces are kept in a bounded cache.

Defined cases: null text is empty and has no ids; repeated rows are encoded alike; long texts are whole; extra
columns are kept, those that clash with the produced columns are replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm._pieces import IntTable, read_ranks, ship, splitter
from quillstack.llm._tables import fresh, numbered

LONG, CACHE, ROWS = 256, 200_000, 1 << 14
_NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        key = (path, pattern)
        if key not in cls._made:
            cls._made[key] = cls(path, pattern)
        return cls._made[key]

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.find = splitter(pattern).findall
        rank = {t: i for i, t in enumerate(self.tokens) if t}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two others; its rank is its id
        pairs = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        self.table = IntTable(len(pairs))
        self.table.put(np.array([(a << 32) | b for a, b, _ in pairs], np.int64), np.array([r for *_, r in pairs], np.int32))
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.all = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NONE`` where they don't merge or one is padding (-1)."""
        out = np.full(left.size, _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.table.get((left.ravel()[open_].astype(np.int64) << 32) | right.ravel()[open_])
        out[open_] = np.where(found < 0, _NONE, found)
        return out.reshape(left.shape)

    def encode_rows(self, rows: np.ndarray) -> np.ndarray:
        """Merges a matrix of byte ids padded with -1 to the end; returns ids, padded likewise."""
        done = rows.copy()
        live, m = np.arange(len(rows)), rows.copy()
        ranks = self.lookup(m[:, :-1], m[:, 1:])
        while m.shape[1] > 1 and len(live):
            at = ranks.argmin(axis=1)
            r = np.arange(len(m))
            best = ranks[r, at]
            stop = best == _NONE
            if stop.any():
                done[live[stop]] = -1
                done[live[stop], : m.shape[1]] = m[stop]
                live, m, ranks, at, best = live[~stop], m[~stop], ranks[~stop], at[~stop], best[~stop]
                if not len(live):
                    break
                r = np.arange(len(m))
            m[r, at] = best
            # compaction: what stands after the merged pair moves up by one
            keep = np.arange(m.shape[1])[None, :] != (at + 1)[:, None]
            m = m[keep].reshape(len(m), -1)
            if m.shape[1] > 1:
                keep = np.arange(ranks.shape[1])[None, :] != at[:, None]
                ranks = ranks[keep].reshape(len(m), -1)
                left = np.maximum(at - 1, 0)
                right = np.minimum(at, m.shape[1] - 2)
                ranks[r, left] = self.lookup(m[r, left], m[r, left + 1])
                ranks[r, right] = self.lookup(m[r, right], m[r, right + 1])
        if len(live):
            done[live] = -1
            done[live, : m.shape[1]] = m
        return done

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece as a row of its own; a round merges all pairs of its minimum rank."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.lookup(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap every other one is left once those before it are merged
            new = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(new, nth, 0))) % 2 == 0]
            # the pairs that each merge makes, with what stands before it merged and what follows not yet
            after_merge = np.r_[False, np.diff(at) == 2]
            before = np.where(after_merge, best, np.where(at > 0, ids[at - 1], -1))
            behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), best, np.int32)
            lower = (self.lookup(before, merged) < best) | (self.lookup(merged, behind) < best)
            if lower.any():  # that pair comes first
                at = at[: lower.argmax() + 1]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            place = at - np.arange(len(at))
            for pair in (place[place > 0] - 1, place[place < len(ranks)]):
                ranks[pair] = self.lookup(ids[pair], ids[pair + 1])
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't in the cache, by length."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(b) for b in raw])
        cut = np.array([*range(1, 33), *range(36, 65, 4), *range(72, 129, 8), *range(144, LONG + 1, 16)])
        bucket = cut[np.minimum(np.searchsorted(cut, lengths), len(cut) - 1)]
        for size in np.unique(bucket[lengths <= LONG]):
            of = np.flatnonzero((bucket == size) & (lengths <= LONG))
            for at in range(0, len(of), ROWS):
                some = of[at : at + ROWS]
                rows = np.full((len(some), size), -1, np.int32)
                there = np.arange(size)[None, :] < lengths[some][:, None]
                rows[there] = self.byte[np.frombuffer(b"".join([raw[i] for i in some]), np.uint8)]
                ids = self.encode_rows(rows)
                counts, flat = (ids >= 0).sum(axis=1), ids[ids >= 0].astype("<i4").tobytes()
                ends = (np.cumsum(counts) * 4).tolist()
                for i, a, b in zip(some.tolist(), [0, *ends[:-1]], ends):
                    self.cache[pieces[i]] = flat[a:b]
        for i in np.flatnonzero(lengths > LONG).tolist():
            self.cache[pieces[i]] = self.encode_long(raw[i]).astype("<i4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        for at in range(0, len(texts), 256):
            cut = [self.find(t) if t else [] for t in texts[at : at + 256]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = set().union(*cut).difference(self.cache)
            if new:
                self.learn(list(new))
            get = self.cache.__getitem__
            for pieces in cut:
                yield b"".join(map(get, pieces))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return self.all[np.repeat(self.starts[ids], size) + within]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` array<int> and, on demand, ``decoded``: the bytes that the ids stand for,
    made from them in the same pass."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *[T.StructField("decoded", T.BinaryType(), False)] * decoded]
    docs_kept = fresh(docs, *[f.name for f in made])
    kept = [c for c in docs_kept.columns if keep is None or c in keep]
    held, back = numbered(*kept)
    schema = T.StructType([*docs_kept.select(*held).schema.fields, *made])
    ship(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # ids take more room than their text
                batch = whole.slice(at, 512)
                ids = list(codec.encode(batch.column(batch.num_columns - 1).to_pylist()))
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [*batch.columns[:-1], lists]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(x, "<i4")).tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        codec.cache.clear()  # the worker goes on to other tasks

    return docs_kept.select(*held, docs[text].alias("__text")).mapInArrow(run, schema).select(*back, *[f.name for f in made])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``."""
    encoded = fresh(encoded, "decoded")
    held, back = numbered(*encoded.columns)
    slim = encoded.select(*held)
    schema = T.StructType([*slim.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    at = encoded.columns.index("ids")
    ship(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            lists = batch.column(at)
            flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            out = [codec.decode(flat[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema).select(*back, "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, then decoded from the ids."""
    both = encode(docs, path, pattern, keep=["doc_id"], decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
