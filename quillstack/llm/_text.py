"""numpy views of Arrow string columns and the word arithmetic that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Word separators: space and the controls 0x09-0x0D, the complement of [^\x20\x09-\x0D].
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an unsigned array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def hash_longs(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, as Spark's ``xxhash64`` gives it; the seed of a further column is the hash of those before it."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    seed = np.asarray(seed).astype(np.uint64) if not isinstance(seed, int) else np.uint64(seed)
    h = (seed + (_P5 + np.uint64(8))) ^ (turn(values.view(np.uint64) * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes, one for each byte that is not a continuation."""
    if not len(data) or data.max() < 128:
        return data.astype(np.int64)
    lead = (data & 0xC0) != 0x80
    out = data[lead].astype(np.int64)
    long = np.flatnonzero(out > 0x7F)
    at = np.flatnonzero(lead & (data > 0x7F))
    padded = np.r_[data, np.zeros(3, np.uint8)]
    a, (b, c, d) = out[long], (padded[at + i].astype(np.int64) & 0x3F for i in (1, 2, 3))
    two, three = ((a & 0x1F) << 6) | b, ((a & 0x0F) << 12) | (b << 6) | c
    four = ((a & 0x07) << 18) | (b << 12) | (c << 6) | d
    out[long] = np.minimum(np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)), 0x10FFFF)
    return out


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


class Words:
    """Words of some documents that lie one after the other in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        self.word = ~SEPARATOR[data]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.empty(len(data), bool)
        before[1:] = self.word[:-1]
        before[first] = False
        self.before = before
        after = np.empty(len(data), bool)
        after[:-1] = self.word[1:]
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        self.start = np.flatnonzero(self.word & ~before)
        self.end = np.flatnonzero(self.word & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def prefix_hash(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=total[1:])
        self.total = total
        return total

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: a polynomial of odd base, moved to exponent zero and mixed."""
        down = _power("down", pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        return mix((self.total[end] - self.total[start]) * down[start])
