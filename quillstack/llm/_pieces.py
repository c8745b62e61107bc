"""Cutting texts into the pieces that byte-level BPE merges separately, and reading rank files."""

from __future__ import annotations

import base64
import json
import os
from functools import cache

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession


@cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


_sent: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary file to the executors, once for each application; there ``local`` finds it."""
    name = (spark.sparkContext.applicationId, path)
    if name not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _sent.add(name)


def local(path: str) -> str:
    """Where a worker can open the file: the path itself, or what was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(local(path), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the json vocabulary: itself if printable, else from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_json(path: str) -> tuple[list[tuple[bytes, bytes]], set[bytes], list[str]]:
    """Merges in order, the vocabulary, and the special strings of a json vocabulary."""
    with open(local(path), encoding="utf-8") as f:
        whole = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = [t["content"] for t in whole["added_tokens"]]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in whole["model"]["merges"]]
    vocab = {raw(t) for t in whole["model"]["vocab"] if t not in special}
    return [(raw(a), raw(b)) for a, b in merges], vocab, special


class IntTable:
    """A hash table of distinct non-negative 64-bit keys with 32-bit values, for whole arrays: open addressing, linear probing."""

    def __init__(self, room: int):
        self.bits = int(np.ceil(np.log2(max(room, 16) * 4)))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.room, self.used = room, 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct keys that aren't there."""
        at, open_ = self._slot(key), np.arange(len(key))
        while len(open_):
            free = self.keys[at[open_]] < 0
            won = open_[free][np.unique(at[open_[free]], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = key[won], value[won]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        self.used += len(key)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values, -1 where a key isn't there."""
        out, open_, at = np.full(len(key), -1, np.int32), np.arange(len(key)), self._slot(key)
        while len(open_):
            there = self.keys[at]
            hit = there == key
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            open_, key, at = open_[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out
