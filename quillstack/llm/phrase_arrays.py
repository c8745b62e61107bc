"""Phrase collocations from word-id suffix arrays.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``. A task joins its documents
to shards of some ``SHARD`` bytes. In a shard words get ids, suffixes are put in order by prefix doubling (the order by their first word,
two, four, and ``longest`` words, each from the ranks of the one before), and the array of common prefixes of neighbours follows from the same ranks. A
maximal run of neighbours that share k words is one k-gram, its length the k-gram's count in the shard. Suffixes end with
their piece, so no phrase crosses a border.

Two passes give exact totals without moving every n-gram. The first adds up counts by hash bucket: a shard sends its non-empty buckets, sorted
and as compressed differences, and blocks of buckets are added up. A bucket's total is at least the count of each n-gram in
it, so buckets below ``min_count`` rule their n-grams out; nothing else is ruled out. The second pass sends the n-grams that are left, as
text, in lists by range of their checksums, and adds them up by key, range by range; it cuts the sequence at words and pairs that are ruled out before it sorts suffixes. The number of buckets follows
the size of the texts, up to twice 2^``MOST_BITS``, where the broadcast set of full buckets has 128 MB: with still more text fewer n-grams are ruled out, rare
words last as they have buckets of their own, and the result is the same.

Defined cases: null text is empty; a null lang is ``und``; repeated rows count as often as they occur; long texts are cut into shards at piece
borders; texts without words give nothing; a doc_id isn't needed, extra columns have no effect; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm._tables import written
from quillstack.llm._text import mix

LONGEST, MIN_COUNT, BEST = 5, 100, 2000
SHARD = 4 << 20  # bytes of text in a suffix array
LEAST_BITS, MOST_BITS, BLOCK_BITS = 20, 29, 20
HELD = 150_000  # phrases whose counts a task adds up before it sends them
RANGE_BYTES = 2 << 20  # text whose phrases, of one language, are added up by one call
FEW = 10_000  # languages whose word counts are broadcast
SALT_BYTES = 8 << 30  # text whose buckets of one block are added up by one task
_STEP = np.uint64(0x9FB21C651E98DF25)

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys below 2^bits in rising order, and the keys in that order. Places go below the key where both fit a word."""
    low = max(len(key) - 1, 1).bit_length()
    if bits + low > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort((key.astype(np.int64) << low) | np.arange(len(key)))
    return both & ((1 << low) - 1), both >> low


def _changes(a: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Shard:
    """Some texts of known languages as one sequence of words."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        data = _FOLD[np.frombuffer(b"\n".join(t for _, t in texts), np.uint8)]
        ends = np.cumsum([len(t) + 1 for _, t in texts]) - 1
        breaks = _BREAK[data]
        edge = np.diff(np.r_[False, ~(breaks | _BLANK[data]), False].view(np.int8))
        self.data, self.start, self.end = data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.langs = sorted({lang for lang, _ in texts})
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[lang] for lang, _ in texts], np.int64)[np.searchsorted(ends, self.start)]
        piece = np.searchsorted(np.flatnonzero(breaks), self.start)
        #: whether the next word stands in the same piece
        self.joined = np.r_[piece[1:] == piece[:-1], False] if len(piece) else np.zeros(0, bool)
        self.word = self._hashes()

    def _hashes(self) -> np.ndarray:
        """64-bit hashes of the words and their languages, the same in every shard."""
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = self.end - self.start
        mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        out = np.array([_seed(lang) for lang in self.langs], np.uint64)[self.lang] + size.astype(np.uint64)
        open_ = np.arange(len(size))
        for at in range(0, min(int(size.max(initial=0)), 256), 8):
            open_ = open_[size[open_] > at]
            out[open_] = mix(out[open_] * _STEP ^ (eight[self.start[open_] + at] & mask[np.minimum(size[open_] - at, 8)]))
        for i in np.flatnonzero(size > 256).tolist():  # long words are hashed whole
            whole = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest()
            out[i] ^= np.uint64(int.from_bytes(whole, "little"))
        return out

    def _ids(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense ids from 1 of the words at some places, a place of each, and how often it occurs."""
        low = max(len(of) - 1, 1).bit_length()
        order, key = _ordered((self.word[of] >> np.uint64(low + 1)).astype(np.int64), 63 - low)
        h = self.word[of][order]
        new = _changes(h)
        if len(new) != len(_changes(key)):  # two words share the leading bits of their hashes
            order = np.argsort(self.word[of])
            h = self.word[of][order]
            new = _changes(h)
        ids = np.empty(len(of), np.int64)
        ids[order] = np.repeat(np.arange(1, len(new) + 1), np.diff(np.r_[new, len(of)]))
        return ids, of[order[new]], np.diff(np.r_[new, len(of)])

    def grams(self, longest: int, may: Callable[[np.ndarray, int], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, first word of an occurrence, count, hash) of all k-grams, for k from 1 on; of those only whose hash ``may`` admits."""
        words, joined = np.arange(len(self.word)), self.joined
        if may is not None:
            # an n-gram that isn't admitted is in none that is: the sequence is cut there before it is sorted
            words = np.flatnonzero(may(self.word, 1))
            joined = np.r_[joined[words[:-1]] & (np.diff(words) == 1), False] if len(words) else joined[:0]
        ids, at, count = self._ids(words)
        yield 1, at, count, self.word[at]
        if longest < 2:
            return
        if may is not None and len(words):
            joined[:-1] &= may(mix(self.word[words[:-1]] * _STEP + self.word[words[1:]]), 2)
        inside = np.flatnonzero(joined | np.r_[False, joined[:-1]]) if len(words) else np.zeros(0, np.int64)
        words, joined, ids = words[inside], joined[inside], ids[inside]
        n = len(words)
        last = np.flatnonzero(~joined)
        left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # words up to the end of the run
        order, shared = self._suffixes(ids, left, longest)
        h = self.word[words]
        for k in range(2, longest + 1):
            h = mix(h[: max(n - k + 1, 0)] * _STEP + self.word[words[k - 1 :]])
            begin = np.flatnonzero(np.r_[True, shared < k]) if n else np.zeros(0, np.int64)
            count, at = np.diff(np.r_[begin, n]), order[begin]
            full = left[at] >= k
            at, count = at[full], count[full]
            if may is not None and len(at):
                there = may(h[at], k)
                at, count = at[there], count[there]
            yield k, words[at], count, h[at]

    @staticmethod
    def _suffixes(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their first ``longest`` words, and how many of these neighbours share."""
        n, have, rank = len(ids), 1, {1: ids}
        order = np.zeros(0, np.int64)
        while have < longest and n:
            more = min(have, longest - have)
            more = max(s for s in rank if s <= more)
            # the first `have` words, then the next `more`; 0 where the run ends before
            behind = np.zeros(n, np.int64)
            behind[: max(n - have, 0)] = rank[more][have:]
            behind[left <= have] = 0
            high, low = int(rank[have].max()).bit_length(), int(rank[more].max()).bit_length()
            order, key = _ordered((rank[have] << low) | behind, high + low)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            have += more
            rank[have] = new
        a, b = order[:-1], order[1:]
        room = np.minimum(left[a], left[b])
        shared = np.zeros(max(n - 1, 0), np.int8)
        for k in range(1, longest + 1):
            # k words are alike if known prefixes of theirs are, one at the start and one that ends with word k
            size = max(s for s in rank if s <= k)
            pair = np.flatnonzero((shared == k - 1) & (room >= k))
            x, y = a[pair], b[pair]
            same = (rank[size][x] == rank[size][y]) & (rank[size][x + k - size] == rank[size][y + k - size])
            shared[pair[same]] = k
        return order, shared


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    held, size = [], 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang, text in zip(langs, (t.as_py() for t in texts)):
            for part in _cut(text.encode() if text else b""):
                held.append((lang, part))
                size += len(part) + 1
                if size >= SHARD:
                    yield Shard(held)
                    held, size = [], 0
    if held:
        yield Shard(held)


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``SHARD`` bytes that end with a piece; a piece without a border is whole."""
    if len(text) <= SHARD:
        yield text
        return
    at = 0
    ends = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8)])
    while len(text) - at > SHARD:
        i = np.searchsorted(ends, at + SHARD, "right")
        if i and ends[i - 1] >= at:
            to = int(ends[i - 1]) + 1
        elif i < len(ends):
            to = int(ends[i]) + 1
        else:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _pack(sorted_low: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 as differences, byte by byte, with counts of one byte; compressed."""
    steps = np.diff(sorted_low, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.concatenate([steps.ravel(), counts.astype(np.uint8)]).tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(both[:4].T).view("<u4").ravel(), dtype=np.int64), both[4]


def _bucket(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Words have 2^bits buckets of their own, all longer n-grams as many."""
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64) | ((k > 1) << bits)


def _full_buckets(texts: DataFrame, longest: int, min_count: int, bits: int, salts: int) -> bytes:
    """A bit for each bucket: whether the n-grams in it occur ``min_count`` times in all."""
    top, low = min(min_count, 255), (1 << BLOCK_BITS) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, shard in enumerate(_shards(batches)):
            found = [(_bucket(h, k, bits) << 8) | np.minimum(count, top) for k, _, count, h in shard.grams(longest)]
            both = np.sort(np.concatenate(found))
            key, count = both >> 8, both & 255
            first = _changes(key)
            if not len(first):
                continue
            key, count = key[first], np.minimum(np.add.reduceat(count, first), top)
            begin = _changes(key >> BLOCK_BITS)
            blocks = key[begin] >> BLOCK_BITS
            salt = np.full(len(begin), int(key[-1] + nth) % salts)
            packed = [_pack(key[a:b] & low, count[a:b]) for a, b in zip(begin, np.r_[begin[1:], len(key)])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(salt, pa.int32()), pa.array(packed, pa.binary())], names=["block", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(1 << BLOCK_BITS, np.uint16), None
        for batch in batches:
            block = batch.column("block")[0].as_py()
            for raw in batch.column("counts"):
                at, count = _unpack(raw.as_py())
                total[at] = np.minimum(total[at] + count, top)
        at = np.flatnonzero(total)
        out = np.packbits(total >= top, bitorder="little").tobytes() if final else _pack(at, total[at])
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out], pa.binary())], names=["block", "counts"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(batches, False)

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(batches, True)

    sent = texts.mapInArrow(send, "block int, salt int, counts binary")
    if salts > 1:
        sent = sent.groupBy("block", "salt").applyInArrow(some, "block int, counts binary")
    out, size = bytearray(1 << (bits - 2)), 1 << (BLOCK_BITS - 3)
    for row in written(sent.groupBy("block").applyInArrow(all_, "block int, counts binary"), "buckets").collect():  # as many bits as buckets
        out[row.block * size : (row.block + 1) * size] = row.counts
    return bytes(out)


def counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words int, phrase, f: every phrase of up to ``longest`` words that occurs ``min_count`` times or more in its language, and, as
    words 0 and an empty phrase, all words of the language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size / 8, 1))), LEAST_BITS, MOST_BITS))
    ranges = 1 + size // RANGE_BYTES
    full = spark.sparkContext.broadcast(_full_buckets(texts, longest, min_count, bits, max(1, size // SALT_BYTES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(full.value, np.uint8)

        def may(h: np.ndarray, k: int) -> np.ndarray:
            bucket = _bucket(h, k, bits)
            return ((bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1).astype(bool)

        def sums(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
            for lang, of in held.items():
                parts: dict[int, tuple[list[bytes], list[int]]] = {}
                for phrase, n in of.items():
                    phrases, f = parts.setdefault(zlib.crc32(phrase) % ranges, ([], []))
                    phrases.append(phrase)
                    f.append(n)
                columns = [pa.array([phrases for phrases, _ in parts.values()], pa.list_(pa.binary())), pa.array([f for _, f in parts.values()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(list(parts), pa.int64()), *columns], names=["lang", "range", "phrases", "f"])

        held: dict[str, dict[bytes, int]] = {}
        for shard in _shards(batches):
            raw = shard.data.tobytes()
            each = [held.setdefault(lang, {}) for lang in shard.langs]
            for of, total in zip(each, np.bincount(shard.lang, minlength=len(each)).tolist()):
                of[b""] = of.get(b"", 0) + total
            for k, at, count, _ in shard.grams(longest, may):
                for i, a, b, n in zip(shard.lang[at].tolist(), shard.start[at].tolist(), shard.end[at + k - 1].tolist(), count.tolist()):
                    phrase = b" ".join(raw[a:b].split())
                    of = each[i]
                    of[phrase] = of.get(phrase, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield from sums(held)
                held = {}
        yield from sums(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, total = "", {}
        for batch in batches:
            lang = batch.column("lang")[0].as_py()
            for phrase, n in zip(batch.column("phrases").flatten().to_pylist(), batch.column("f").flatten().to_pylist()):
                total[phrase] = total.get(phrase, 0) + n
        enough = [(p, n) for p, n in total.items() if n >= min_count or not p]
        phrases, f = [p for p, _ in enough], [n for _, n in enough]
        words = [p.count(b" ") + 1 if p else 0 for p in phrases]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(words, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "words", "phrase", "f"])

    sent = texts.mapInArrow(send, "lang string, range long, phrases array<binary>, f array<long>")
    return sent.groupBy("lang", "range").applyInArrow(add, "lang string, words int, phrase string, f long")


def _part(begin, size):
    return F.array_join(F.slice("__words", begin, size), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, best: int = BEST, inside: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of 2 to ``longest`` words by their lowest-scoring cut in two.

    A phrase goes if a longer one that holds it occurs in ``inside`` hundredths of its places or more. Scores are quotients of whole numbers
    of up to 38 digits, rounded down."""
    known = written(counts(docs, longest, min_count), "phrases")
    phrases = known.where("words > 1").withColumn("__words", F.split("phrase", " "))
    total = known.where("words = 0").select("lang", F.col("f").alias("n"))
    if total.count() <= FEW:
        total = F.broadcast(total)

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", "__words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "words", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("words").alias("k"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).where("words > 0")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(left, ["lang", "k", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    scored = scored.withColumn("__up", (1000 * F.col("a")).cast("decimal(19,0)") * wide("n")).withColumn("__down", wide("l") * wide("r"))
    scored = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(F.expr("__up div __down").alias("score"), "k", "l", "r")).alias("cut"))

    spans = phrases.where("words > 2").select("lang", F.col("f").alias("longer"), "words", "__words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    spans = spans.select("lang", "longer", "__words", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    spans = spans.groupBy("lang", _part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("longer").alias("longer"))

    kept = scored.join(spans, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
