"""Token counts by prefix dynamic programming.

For every prefix of a piece the last token of its encoding is found from shorter prefixes: it is the one token that
ends there, is its own encoding, and stays apart from the last token of the prefix before it. The count of a prefix is
that of the prefix before its last token, plus one. Two tokens stay apart if no merge across their border comes due
while both neighbours exist: each token has a spine of parts at the border, each part exists from its own merge until the
one that absorbs it, and equal merges go leftmost first. Counts are kept as differences between neighbouring prefixes, so a text's
counts at all its prefixes are one running sum; its end is the text's token count, and truncation and budget questions
read the sums without encoding again. Pieces up to ``SHORT`` bytes go through the recurrence as one matrix, longer ones singly, in
time proportional to their length.

Counts are those of a prefix encoded by itself: where cutting changes the pieces (after a run of white space, inside 're,
've and 'll) they are corrected. Inside special strings and UTF-8 characters a prefix can't end.

Defined cases: null text is empty with no tokens; special strings in texts are one token each, as the library's default;
repeated rows are counted alike; long texts are whole; clashing columns are replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm._pieces import IntTable, read_json, ship, splitter
from quillstack.llm._tables import fresh, numbered
from quillstack.llm._text import mix

SHORT, CACHE, PAIRS = 32, 400_000, 1 << 20
_BASE = np.uint64(0x9FB21C651E98DF25)
_CUT = ("'re", "'ve", "'ll")  # contractions whose middle prefix is two pieces
_RUN = regex.compile(r"\s{2,}(?=\S)")


def _byte_steps(steps: np.ndarray) -> bytes:
    """Differences as bytes. A step is below the length of the longest token, which must be under 128 bytes more than it saves."""
    if len(steps) and (steps.max() > 127 or steps.min() < -128):
        raise ValueError("the vocabulary's tokens are too long for prefix differences of one byte")
    return steps.astype(np.int8).tobytes()


class Counter:
    """Prefix counts under one vocabulary; made once in each Python worker."""

    _made: dict[tuple[str, str], Counter] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Counter:
        key = (path, pattern)
        if key not in cls._made:
            cls._made[key] = cls(path, pattern)
        return cls._made[key]

    def __init__(self, path: str, pattern: str):
        merges, vocab, self.special = read_json(path)
        self.find = splitter(pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        tokens = [t for t in sorted(vocab) if len(t) == 1] + [a + b for a, b in merges]
        self.id = {t: i for i, t in enumerate(tokens)}  # in order of merges
        self.rank = {(self.id[a], self.id[b]): self.id[a + b] for a, b in merges}
        self.parts = {self.id[a + b]: (self.id[a], self.id[b]) for a, b in merges}
        self.left, self.right = [self._spine(i, 0) for i in range(len(tokens))], [self._spine(i, 1) for i in range(len(tokens))]
        self.sizes = sorted({len(t) for t in tokens})
        self.stable = [len(t) == 1 for t in tokens]
        for i in range(len(tokens)):
            if i in self.parts:
                a, b = self.parts[i]
                self.stable[i] = self.stable[a] and self.stable[b] and self.apart(a, b, i)
        stable = [t for i, t in enumerate(tokens) if self.stable[i]]
        self.by_hash = IntTable(len(stable))
        self.by_hash.put(np.array([self._hash(t) for t in stable], np.int64), np.array([self.id[t] for t in stable], np.int32))
        self.pairs = IntTable(PAIRS)
        self.cache: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, merge that absorbs it) along one border, from the token inwards."""
        out, until = [], 1 << 40
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            token, until = self.parts[token][side], token

    def apart(self, a: int, b: int, before: int = 1 << 40) -> bool:
        """Whether a and b, one after the other, never merge across their border (before a given merge)."""
        rank = self.rank.get
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = rank((x, y))
                if r is not None and r < x_until and r <= y_until and r < before:
                    return False
        return True

    @staticmethod
    def _hash(token: bytes) -> int:
        h = 0
        for c in token:
            h = (h * int(_BASE) + c + 1) % (1 << 64)
        return int(mix(np.array([h], np.uint64))[0] >> np.uint64(1))

    def _pairs_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        out = self.pairs.get(key)
        miss = np.unique(key[out < 0])
        if len(miss):
            if self.pairs.used + len(miss) > self.pairs.room:
                self.pairs = IntTable(max(PAIRS, len(miss)))
            new = np.array([self.apart(k >> 20, k & 0xFFFFF) for k in miss.tolist()], np.int32)
            self.pairs.put(miss, new)
            at = np.minimum(np.searchsorted(miss, key), len(miss) - 1)
            out = np.where(out < 0, new[at], out)
        return out > 0

    def rows(self, raw: list[bytes]) -> np.ndarray:
        """Counts at every prefix (column j: j bytes) of pieces sorted by falling length."""
        n, width = len(raw), len(raw[0])
        length = np.array([len(b) for b in raw])
        text = np.zeros((n, width), np.uint64)
        text[np.arange(width)[None, :] < length[:, None]] = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, width + 1), np.uint64)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(width, _BASE, np.uint64)])
        for j in range(width):
            h[:, j + 1] = h[:, j] * _BASE + text[:, j]
        last, count = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
        for j in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-length, -j, "right"))
            for size in reversed(self.sizes):
                if size > j or not len(open_):
                    continue
                i = j - size
                key = (mix(h[open_, j] - h[open_, i] * power[size]) >> np.uint64(1)).astype(np.int64)
                token = self.by_hash.get(key)
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                row, token = open_[some], token[some]
                fits = np.ones(len(row), bool) if i == 0 else self._pairs_apart(last[row, i], token)
                row, token = row[fits], token[fits]
                last[row, j], count[row, j] = token, count[row, i] + 1
                open_ = np.delete(open_, some[fits])
        return count

    def single(self, piece: bytes) -> list[int]:
        last, count = [-1], [0]
        for j in range(1, len(piece) + 1):
            for size in self.sizes:
                if size > j:
                    break
                t = self.id.get(piece[j - size : j])
                if t is not None and self.stable[t] and (size == j or self.apart(last[j - size], t)):
                    last.append(t)
                    count.append(count[j - size] + 1)
                    break
        return count

    def learn(self, pieces: list[str]) -> None:
        """Puts the differences of new pieces' prefix counts into the cache, a byte each."""
        raw = sorted(((p.encode(), p) for p in pieces), key=lambda x: -len(x[0]))
        short = next((i for i, x in enumerate(raw) if len(x[0]) <= SHORT), len(raw))
        for b, p in raw[:short]:
            self.cache[p] = _byte_steps(np.diff(self.single(b)))
        for at in range(short, len(raw), 1 << 15):
            some = raw[at : at + (1 << 15)]
            steps = np.diff(self.rows([b for b, _ in some]), axis=1)
            for row, (b, p) in zip(steps, some):
                self.cache[p] = _byte_steps(row[: len(b)])
        for p in set(pieces).intersection(_CUT):
            n = int(np.frombuffer(self.cache[p], np.int8).sum())
            self.cache[p] = _byte_steps(np.array([1, 1, n - 2]))

    def steps(self, texts: list[str]) -> Iterator[bytes]:
        """The differences between neighbouring prefix counts of each text, a byte for each of its bytes."""
        for at in range(0, len(texts), 1024):
            cut = []
            for text in texts[at : at + 1024]:
                parts = self.split(text)
                cut.append([p for i, x in enumerate(parts) for p in ([(x,)] if i % 2 else self.find(x))] if len(parts) > 1 else self.find(text))
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = {p for pieces in cut for p in pieces if p not in self.cache}
            special = {p for p in new if isinstance(p, tuple)}
            for p in special:
                self.cache[p] = bytes(len(p[0].encode()) - 1) + b"\x01"
            if new := new - special:
                self.learn(list(new))
            get = self.cache.__getitem__
            for pieces in cut:
                yield b"".join(map(get, pieces))

    def prefix_counts(self, text: str, steps: bytes | None = None) -> np.ndarray:
        """Token count at every byte prefix of a text, from 0 bytes to all."""
        if steps is None:
            steps = next(self.steps([text]))
        out = np.r_[0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32)]
        runs = [(m.start(), m.end()) for x, y in self._plain(text) for m in _RUN.finditer(text, x, y)]
        if runs:
            # a run of white space that ends the prefix is one piece
            at = np.r_[0, np.cumsum([1 + (c > "\x7f") + (c > "߿") + (c > "￿") for c in text])] if not text.isascii() else np.arange(len(text) + 1)
            for (a, b), s in zip(runs, self.steps([text[a:b] for a, b in runs])):
                out[at[b]] = out[at[a]] + int(np.frombuffer(s, np.int8).sum())
        return out

    def _plain(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for i, x in enumerate(self.split(text)):
            if i % 2 == 0:
                yield at, at + len(x)
            at += len(x)

    def fitting(self, text: str, steps: bytes, limit: int) -> int:
        """Bytes of the longest prefix of ``text`` with ``limit`` tokens at most."""
        ok = self.prefix_counts(text, steps) <= limit
        raw = np.frombuffer(text.encode(), np.uint8)
        ok[:-1] &= (raw & 0xC0) != 0x80
        at = 0
        for i, x in enumerate(self.split(text)):
            size = len(x.encode())
            if i % 2:
                ok[at + 1 : at + size] = False
            at += size
        return int(np.flatnonzero(ok)[-1])


def with_counts(docs: DataFrame, path: str, pattern: str, limit: int, text: str = "text", keep: list[str] | None = None, prefixes: bool = False, steps: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_bytes, n_tokens, over_limit, fit_bytes (the longest prefix within ``limit``
    tokens) and, with ``prefixes``, prefix_counts array<int> (by bytes, from the empty prefix), or, with ``steps``, prefix_steps: their
    differences, a signed byte for each byte of the text, whose running sums are the counts."""
    made = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("over_limit", T.BooleanType(), False), T.StructField("fit_bytes", T.LongType(), False)]
    made += [T.StructField("prefix_counts", T.ArrayType(T.IntegerType(), False), False)] * prefixes
    made += [T.StructField("prefix_steps", T.BinaryType(), False)] * steps
    ship(docs.sparkSession, path)
    docs_kept = fresh(docs, *[f.name for f in made])
    kept = [c for c in docs_kept.columns if keep is None or c in keep]
    held, back = numbered(*kept)
    schema = T.StructType([*docs_kept.select(*held).schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path, pattern)
        for whole in batches:
            step = 64 if prefixes else 2048
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                size, count, fit, arrays, bytes_ = [], [], [], [], []
                for t, s in zip(texts, list(counter.steps(texts))):
                    size.append(len(s))
                    count.append(int(np.frombuffer(s, np.int8).sum(dtype=np.int64)))
                    fit.append(len(s) if count[-1] <= limit else counter.fitting(t, s, limit))
                    if prefixes:
                        arrays.append(counter.prefix_counts(t, s))
                    if steps:
                        # running sums are exact but at the end of a run of white space
                        bytes_.append(_byte_steps(np.diff(counter.prefix_counts(t, s))) if _RUN.search(t) else s)
                out = [pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array([c > limit for c in count], pa.bool_()), pa.array(fit, pa.int64())]
                if prefixes:
                    out.append(pa.array(arrays, pa.list_(pa.int32())))
                if steps:
                    out.append(pa.array(bytes_, pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=schema.names)

    return docs_kept.select(*held, docs[text].alias("__text")).mapInArrow(run, schema).select(*back, *[f.name for f in made])


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts at every byte prefix, from stored differences."""
    return np.r_[0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)]


def longest_within(counted: DataFrame, limit: int) -> DataFrame:
    """Adds ``fit_bytes`` for another limit from stored ``prefix_counts``, without encoding."""
    fits = F.filter(F.transform("prefix_counts", lambda n, i: F.when(n <= limit, i)), lambda i: i.isNotNull())
    return fresh(counted, "fit_bytes").withColumn("fit_bytes", F.array_max(fits).cast("long"))
