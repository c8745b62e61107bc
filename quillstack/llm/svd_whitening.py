"""Whitening of embeddings by hierarchical SVD merging.

Entries become whole numbers x = floor(scale * c) + shift; the fit list is each distinct x vector once. A task turns its part of the fit list
into a state: the number of vectors, their sums, and all singular values and vectors of the part less its mean. Two states merge into that of both
parts: their scaled vectors, one below the other, with a row sqrt(n1 n2 / (n1 + n2)) (m1 - m2) for the difference of the means, are decomposed again.
No singular value is dropped, so the last state is that of the whole list but for rounding. States meet ``FAN`` at a time, level by level; a state has as many
numbers as a square of the vector's length. Components are the last state's vectors, eigenvalues its squared values over n.

As neither means taken away nor covariances depend on ``shift``, vectors are held without it. Sums are whole numbers, and a mean is taken away as (n x - S) / n,
so the only rounding is that of quotients.

Defined cases: rows whose vector is null or holds a null or non-finite entry go; vectors of different lengths are lists of their own, each with its own n, and empty
vectors have no components; a component whose singular value is below ``LEAST`` of the largest (as of one distinct vector) isn't returned; repeated rows are fitted once
and all returned; equal eigenvalues have any basis; ids may be null or repeated; extra columns have no effect; empty tables give no rows.
``deviation`` is null beyond 64 bits, where ``deviation_exact``, of up to 38 digits, has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm._tables import written

SCALE, COMPONENTS = 64, 16
FAN, ROWS, LEAST = 8, 4096, 1e-9
_STATE = "dim int, node long, n long, sums binary, spread binary, vectors binary"


@dataclass
class Part:
    """The state of some vectors: count, sums, singular values and vectors (as rows) of what is left without the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Part:
        sums = x.sum(axis=0)
        _, values, vectors = np.linalg.svd((x * len(x) - sums) / len(x), full_matrices=False)
        return cls(len(x), sums, values, vectors)

    def __add__(self, other: Part) -> Part:
        n = self.n + other.n
        apart = (self.sums / self.n - other.sums / other.n) * np.sqrt(self.n / n * other.n)
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, apart])
        _, values, vectors = np.linalg.svd(rows, full_matrices=False)
        return Part(n, self.sums + other.sums, values, vectors)

    def row(self, dim: int, node: int) -> tuple:
        return dim, node, self.n, self.sums.tobytes(), self.values.tobytes(), self.vectors.tobytes()

    @classmethod
    def read(cls, dim: int, n: int, sums: bytes, spread: bytes, vectors: bytes) -> Part:
        return cls(n, np.frombuffer(sums, np.int64), np.frombuffer(spread), np.frombuffer(vectors).reshape(-1, dim))


@dataclass
class Fit:
    """What projects a vector: n, sums, and by component the unit vector, the eigenvalue and its share of the trace; then the error measured."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    e: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n @ self.vectors.T / np.sqrt(self.e)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of squares of n x - S, exactly."""
        apart = x * self.n - self.sums
        size = float(np.abs(apart.astype(float)).max(initial=0))
        if size * size * x.shape[1] < 2**62:
            return (apart * apart).sum(axis=1).tolist()
        return [sum(a * a for a in row) for row in apart.tolist()]


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    lists = batch.column(column)
    size = lists.value_lengths().to_numpy()
    flat, begin = lists.flatten().to_numpy(), np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield some, flat[begin[some][:, None] + np.arange(dim)]


def _states(fit_list: DataFrame, make: Callable[[np.ndarray], Part]) -> dict[int, Part]:
    """The merged state of each vector length: one for each task, then ``FAN`` into one until one is left."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Part] = {}
        for batch in batches:
            for _, x in _matrices(batch, 0):
                new = make(x)
                held[x.shape[1]] = held[x.shape[1]] + new if x.shape[1] in held else new
        node = TaskContext.get().partitionId()
        if held:
            yield _batch([part.row(dim, node) for dim, part in held.items()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dim, node = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                dim, node = r["dim"], r["node"] // FAN
                width = len(r["sums"]) // 8
                part = Part.read(width, r["n"], r["sums"], r["spread"], r["vectors"])
                total = part if total is None else total + part
        yield _batch([total.row(dim, node)])

    states = written(fit_list.mapInArrow(first, _STATE), "states")
    top = states.agg(F.max("node")).first()[0] or 0
    while top > 0:
        states = states.withColumn("__above", F.expr(f"node div {FAN}")).groupBy("dim", "__above").applyInArrow(meet, _STATE)
        top //= FAN
    return {r.dim: Part.read(len(r.sums) // 8, r.n, r.sums, r.spread, r.vectors) for r in states.collect()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["dim", "node", "n", "sums", "spread", "vectors"])


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each vector length in ``fit_list`` (``x`` array<long>, distinct); on the driver, as ``components`` vectors each."""
    out = {}
    for dim, part in _states(fit_list.select("x"), Part.of).items():
        k = min(components, int((part.values > LEAST * part.values[0]).sum())) if part.values[0] > 0 else 0
        squares = part.values**2
        out[dim] = Fit(part.n, part.sums, part.vectors[:k], squares[:k] / part.n, squares[:k] / max(squares.sum(), 1e-300))
    return out


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each vector length the largest absolute entry of (covariance of the whitened fit list - identity), measured over the list."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch, 0):
                w = fits[x.shape[1]].whitened(x)
                # count, sums and products, one after the other
                numbers = np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([numbers], pa.list_(pa.float64()))], names=["dim", "numbers"])

    each = fit_list.select("x").mapInArrow(first, "dim int, numbers array<double>").select("dim", F.posexplode("numbers"))
    total: dict[int, dict[int, float]] = {}
    for r in each.groupBy("dim", "pos").agg(F.sum("col").alias("sum")).collect():  # a square of components for each length
        total.setdefault(r.dim, {})[r.pos] = r["sum"]
    out = {}
    for dim, numbers in total.items():
        k = len(fits[dim].e)
        sums = np.array([numbers[i] for i in range(1 + k + k * k)])
        mean = sums[1 : 1 + k] / sums[0]
        out[dim] = float(np.abs(sums[1 + k :].reshape(k, k) / sums[0] - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def whole_numbers(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id_`` and ``x`` array<long> of the rows whose vector is whole and finite; the shift is left out."""
    there = embeddings.select(embeddings[id_].alias(id_), embeddings[vector].alias("__vector")).where("__vector IS NOT NULL")
    finite = F.forall("__vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return there.where(finite).select(id_, F.transform("__vector", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def whitened(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``id_``, component, n, deviation, whitened, explained, identity_error, deviation_exact for each row and component."""
    vectors = whole_numbers(embeddings, id_, vector, scale)
    fit_list = written(vectors.select("x").distinct(), "fit")
    fits = fitted(fit_list, components)
    for dim, error in identity_errors(fit_list, fits).items():
        fits[dim].identity_error = error
    made = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("deviation_exact", T.DecimalType(38, 0))]
    schema = T.StructType([vectors.schema[id_], *[T.StructField(name, kind) for name, kind in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch, 1):
                fit = fits[x.shape[1]]
                k = len(fit.e)
                if not k:
                    continue
                exact = fit.deviations(x)
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * k, fit.n)),
                    pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(each),
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.explained, len(rows))),
                    pa.array(np.full(len(rows) * k, fit.identity_error)),
                    pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(each),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.mapInArrow(run, schema)
