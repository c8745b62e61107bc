"""Packing token sequences into windows of fixed size by hierarchical best fit.

A document is its token ids and an end mark; one over ``size`` tokens is cut into pieces of ``size``, of which only the first may be shorter. A
piece of full size is a sequence by itself. The others are dealt evenly to tasks of about ``ITEMS`` pieces, each of which packs its own by best fit,
longest first: a piece goes where it leaves least room. Bins that can't be filled further are done. The others go up a tree:
``FAN`` nodes meet in a task, where their bins are items and are packed by best fit again, until one task is left.

Two bins of at most half the size can't both be open in a node, as best fit would have put them together, and two larger ones never fit. So of N nodes
come at most N bins that can go into others. A node passes on its N emptiest bins: with these as good a packing remains as with all of them, and what meets
in a task is bounded. Only numbers move; texts and ids stay where they were read.

Ids are made by tiktoken under the vocabulary and merges of the json file, which gives what the ``tokenizers`` library gives (its merges' order is that of
their ids, and every code point falls into the same class); a text that it refuses, as one with very long white space, goes to that library.

Defined cases: null and empty texts are the end mark alone; special strings in texts are one token each, as the library's default; ids that are null or repeated
are told apart by row; ties go to the bin opened last; long texts are whole; extra columns have no effect; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm._pieces import byte_letters, local, read_json, ship
from quillstack.llm._tables import written

SIZE, END = 1024, 2
ITEMS, FAN = 1 << 16, 16


class Encoder:
    """Ids of whole texts; made once in each Python worker."""

    _made: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        key = (path, pattern)
        if key not in cls._made:
            cls._made[key] = cls(path, pattern)
        return cls._made[key]

    def __init__(self, path: str, pattern: str):
        merges, vocab, special = read_json(path)
        self.library = Tokenizer.from_file(local(path))
        # ids follow the merges; single bytes come first
        known = self.library.get_vocab()
        self.fast = None
        ranks = {a + b: 0 for a, b in merges} | {t: 0 for t in vocab if len(t) == 1}
        ids = self._ids(known, special)
        if set(ranks) == set(ids) and all(ids[a + b] < ids[c + d] for (a, b), (c, d) in zip(merges, merges[1:])):
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ids, special_tokens={s: known[s] for s in special})

    @staticmethod
    def _ids(known: dict[str, int], special: list[str]) -> dict[bytes, int]:
        letters = byte_letters()
        return {bytes(letters[c] for c in t): i for t, i in known.items() if t not in special}

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
            except ValueError:  # white space too long for its pattern matcher
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each item; items are taken as they stand. Open bins are kept by their room, with a bit for each room there is."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bits, n, bins, places = 0, 0, [], []
    for length in lengths:
        fit = bits >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, at, n = size, n, n + 1
        bins.append(at)
        places.append(size - room)
        if room := room - length:
            rooms[room].append(at)
            bits |= 1 << room
    return bins, places


def pieces(docs: DataFrame, path: str, pattern: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, item, piece, start, length, ids_crc32: the pieces of every document; ``item`` tells all pieces apart."""
    ship(docs.sparkSession, path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, item = Encoder.of(path, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end], "<u4"))
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            items = pa.array(np.arange(item, item + len(row)))
            item += len(row)
            numbers = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), items, *numbers], names=["doc_id", "item", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, item long, piece int, start long, length long, ids_crc32 long")


def _pass_on(fill: np.ndarray, size: int, most: int) -> np.ndarray:
    """Which bins go up: those with room, and of them the ``most`` emptiest."""
    up = np.zeros(len(fill), bool)
    up[np.argsort(fill, kind="stable")[:most]] = True
    return up & (fill < size)


def _packed_in(items: pa.Table, size: int, most: int, node: int) -> pa.Table:
    """Items of one node with bin, place, fill (tokens in the bin) and, for the first item of a bin, whether the bin goes up."""
    length = items.column("length").to_numpy()
    order = np.argsort(-length, kind="stable")
    bins, places = best_fit(length[order].tolist(), size)
    bins, places = np.array(bins, np.int64), np.array(places, np.int64)
    fill = np.bincount(bins, weights=length[order]).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    up = _pass_on(fill, size, most)[bins] & (places == 0)
    return pa.table({**{c: items.column(c).take(pa.array(order)) for c in items.column_names}, "node": np.full(len(bins), node), "bin": bins + (node << 32), "place": places, "fill": fill[bins], "up": up})


def pack(items: DataFrame, size: int = SIZE) -> DataFrame:
    """``items`` (with ``item``, unique, and ``length``, from 1 to ``size``) with sequence_id and offset, in as few sequences as best fit finds."""
    short = items.where(F.col("length") < size)
    n = short.count()
    nodes = max(1, -(-n // ITEMS))
    full = items.where(F.col("length") == size).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = f"{', '.join(f'`{c}` {t}' for c, t in items.dtypes)}, node long, bin long, place long, fill long, up boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _packed_in(pa.Table.from_batches(held), size, nodes, TaskContext.get().partitionId()).to_batches(1 << 14)

    if nodes == 1:
        packed = short.repartition(1).mapInArrow(run, schema)
        return full.unionByName(packed.select(*items.columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")))
    packed = written(short.repartition(nodes, F.xxhash64("item")).mapInArrow(run, schema), "packed")
    moves = _merged(packed.where("up").select("node", "bin", F.col("fill").alias("length")), size, nodes)
    joined = packed.join(moves, "bin", "left") if moves is not None else packed.withColumns({"into": F.lit(None), "ahead": F.lit(None)})
    done = joined.select(*items.columns, F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("ahead", F.lit(0))).cast("long").alias("offset"))
    return full.unionByName(done)


def _merged(bins: DataFrame, size: int, nodes: int) -> DataFrame | None:
    """bin, into, ahead: the bins that end up in another, and what stands there before them."""
    levels = []
    while nodes > 1:
        nodes = -(-nodes // FAN)

        def meet(batches: Iterator[pa.RecordBatch], most: int = nodes) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches))
            parent = held.column("node")[0].as_py() // FAN
            out = _packed_in(held.select(["bin", "length"]).rename_columns(["own", "length"]), size, most, parent)
            # a new bin is known by the first of its bins
            bins, first = out.column("bin").to_numpy(), out.column("place").to_numpy() == 0
            heads = np.zeros(int((bins & 0xFFFFFFFF).max()) + 1, np.int64)
            own = out.column("own").to_numpy()
            heads[bins[first] & 0xFFFFFFFF] = own[first]
            yield from pa.table({"node": out.column("node"), "bin": own, "into": heads[bins & 0xFFFFFFFF], "ahead": out.column("place"), "length": out.column("fill"), "up": out.column("up")}).to_batches(1 << 14)

        level = written(bins.withColumn("__group", F.expr(f"node div {FAN}")).groupBy("__group").applyInArrow(_ungrouped(meet), "node long, bin long, into long, ahead long, length long, up boolean"), "merged")
        levels.append(level)
        bins = level.where("up").select("node", "bin", "length")
    moves = None
    for level in reversed(levels):  # from the root down: where a bin goes, and where that went
        here = level.where("bin <> into").select("bin", "into", "ahead")
        if moves is None:
            moves = here
            continue
        above = moves.select(F.col("bin").alias("into"), F.col("into").alias("__into"), F.col("ahead").alias("__ahead"))
        further = here.join(above, "into", "left").select("bin", F.coalesce("__into", "into").alias("into"), (F.col("ahead") + F.coalesce("__ahead", F.lit(0))).alias("ahead"))
        moves = further.unionByName(moves)
    return moves


def _ungrouped(f):
    """``f`` for groups that bring their key as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.select(["node", "bin", "length"]) for b in batches)

    return run


def packed_documents(docs: DataFrame, path: str, pattern: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    items = written(pieces(docs, path, pattern, size, end), "pieces")
    return pack(items, size).drop("item")
