"""Approximate nearest vectors: cells around centroids, product-quantised residuals, exact re-ranking.

Vectors are taken at length 1, so that squared distance is twice the cosine distance. Centroids of cells and of the residuals' sub-spaces are fitted on the driver on at most ``SAMPLE`` vectors, those
whose ids have the smallest hashes; then every vector is indexed: its cell, and a byte for each sub-space of what is left of it. A query visits its nearest cells, as many as hold ``TARGET`` of the nearest of some rows of the sample among all of it (so few where vectors
lie in clusters, and about half of all where they have no structure). Vectors are dealt in blocks of about
``BLOCK`` rows of any cells, so a crowded cell is several tasks, and queries in groups of about ``ASKED``. Where a block meets a group, the codes of a query's cells give estimates, and only the ``rerank`` best of the block
move on: a row for a query and a block's best, not for its best in each cell. The best over all blocks are scored exactly.

Defined cases: vectors that are null, of another length than ``dims``, zero or with null or non-finite entries take no part, neither in the index nor as queries; of equal distances the smaller id comes first; with fewer
vectors than cells or codes every vector is a centroid; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions.vectors import cosine_distance
from quillstack.sources.sinks import stored

SAMPLE, ROUNDS, CODES, BLOCK, ASKED, AT_ONCE = 20_000, 12, 256, 1 << 15, 1 << 10, 64
TARGET, TRIED = 0.97, 200


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)


def _centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of some rows, by Lloyd's rounds from distinct rows."""
    own = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = own if len(own) <= k else own[rng.choice(len(own), k, replace=False)]
    for _ in range(ROUNDS if len(own) > k else 0):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Centroids of cells (rows), and of each sub-space of the residuals."""

    cells: np.ndarray
    parts: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, n_cells: int, n_parts: int) -> Quantiser:
        cells = _centres(x, n_cells, 1)
        rest = np.array_split(x - cells[_nearest(x, cells)], n_parts, axis=1)
        return cls(cells, [_centres(r, CODES, 2 + i) for i, r in enumerate(rest)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = np.array_split(x - self.cells[cell], len(self.parts), axis=1)
        return cell, np.stack([_nearest(r, c) for r, c in zip(rest, self.parts)], axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each query."""
        d = -2 * q @ self.cells.T + (self.cells * self.cells).sum(axis=1)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def needed(self, x: np.ndarray, k: int = 10) -> int:
        """How many cells some rows of ``x`` must visit to meet ``TARGET`` of their k nearest among ``x``."""
        q = x[:: max(1, len(x) // TRIED)]
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(self.probes(q, len(self.cells)), axis=1)  # of each cell in a query's order
        return int(np.quantile(np.take_along_axis(place, _nearest(x, self.cells)[near], axis=1), TARGET, method="higher")) + 1

    def restored(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that coded rows stand for."""
        return self.cells[cell] + np.concatenate([c[codes[:, i]] for i, c in enumerate(self.parts)], axis=1)

    def estimates(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Squared distances of queries from restored rows."""
        return (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)


def unit(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """key and ``v``, of length 1, of the vectors that take part."""
    sound = (F.size(vector) == dims) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = vectors.where(F.col(vector).isNotNull()).where(sound).withColumn("__n", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
    return some.where("__n > 0").select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda c: c / F.col("__n")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


@dataclass(frozen=True)
class Index:
    """key, v, cell, block, codes of every vector."""

    quantiser: Quantiser
    table: DataFrame
    dims: int
    probes: int
    n_blocks: int


def index(vectors: DataFrame, key: str, vector: str, dims: int, n_cells: int | None = None, n_parts: int = 16, sample: int = SAMPLE) -> Index:
    units = unit(vectors, key, vector, dims)
    n = units.count()
    some = units.orderBy(F.xxhash64("key"), "key").limit(sample).toArrow()  # bounded by `sample`
    x = _matrix(some["v"].combine_chunks(), dims) if some.num_rows else np.zeros((1, dims))
    quantiser = Quantiser.fit(x, n_cells or int(np.clip(np.sqrt(n), 1, 4096)), n_parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, codes = quantiser.encode(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "v", "cell", "codes"])

    coded = units.mapInArrow(encode, "key long, v array<double>, cell int, codes binary")
    sized = stored(coded, "coded")
    n_blocks = max(1, -(-n // BLOCK))
    return Index(quantiser, sized.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")), dims, quantiser.needed(x), n_blocks)


def candidates(index: Index, queries: DataFrame, probes: int, rerank: int) -> DataFrame:
    """query, key, estimate: the best by estimate in the visited cells; ``queries`` has query (long) and v (of length 1)."""
    quantiser, dims = index.quantiser, index.dims

    def score(_: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        query, key, estimate = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by([("cell", "ascending"), ("key", "ascending")])
            keys, cell = rows["key"].to_numpy(), rows["cell"].to_numpy()
            x = quantiser.restored(cell, np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(rows.num_rows, -1))
            own, of = asked["query"].to_numpy(), _matrix(asked["v"].combine_chunks(), dims)
            edge = np.searchsorted(cell, np.arange(len(quantiser.cells) + 1))
            for low in range(0, len(own), AT_ONCE):
                q = of[low : low + AT_ONCE]
                visits = np.zeros((len(q), len(quantiser.cells)), bool)
                np.put_along_axis(visits, quantiser.probes(q, probes), True, axis=1)
                d = np.full((len(q), len(keys)), np.inf)
                for c in np.flatnonzero(visits.any(axis=0) & (edge[1:] > edge[:-1])):
                    some = np.flatnonzero(visits[:, c])
                    d[some, edge[c] : edge[c + 1]] = quantiser.estimates(q[some], x[edge[c] : edge[c + 1]])
                for i, row in enumerate(d):
                    most = np.partition(row, rerank - 1)[rerank - 1] if len(row) > rerank else np.inf
                    best = np.flatnonzero((row <= most) & (row < np.inf))
                    best = best[np.lexsort((keys[best], row[best]))][:rerank]
                    query.append(np.full(len(best), own[low + i])), key.append(keys[best]), estimate.append(row[best])
        return pa.table({"query": np.concatenate(query).astype(np.int64), "key": np.concatenate(key).astype(np.int64), "estimate": np.concatenate(estimate)})

    m = max(1, -(-queries.count() // ASKED))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(m)).cast("int").alias("group"), all_(index.n_blocks).alias("block"))
    rows = index.table.select("block", "cell", "key", "codes", all_(m).alias("group"))
    found = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(score, "query long, key long, estimate double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("estimate", "key"))
    return found.withColumn("__p", place).where(F.col("__p") <= rerank).drop("__p")


def top_k(index: Index, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 100) -> DataFrame:
    """query, rank, key, score (cosine distance) for each row of ``queries`` (query, vector)."""
    asked = stored(unit(queries, "query", "vector", index.dims).withColumnRenamed("key", "query"), "asked")
    near = candidates(index, asked, probes or index.probes, rerank)
    # bounded by `rerank` rows a query; vectors come by key
    both = near.join(index.table.select("key", "v"), "key").join(asked.withColumnRenamed("v", "q"), "query")
    scored = both.select("query", "key", cosine_distance(F.col("v"), F.col("q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def visited(index: Index, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """query and the share of all vectors that lie in its visited cells."""
    asked = unit(queries, "query", "vector", index.dims).withColumnRenamed("key", "query")
    quantiser, dims, index_probes = index.quantiser, index.dims, index.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = quantiser.probes(_matrix(b.column(1), dims), probes or index_probes)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))), pa.array(cells.ravel(), pa.int32())], names=["query", "cell"])

    sizes = index.table.groupBy("cell").agg(F.count("*").alias("n"))
    total = index.table.count()
    return asked.mapInArrow(probe, "query long, cell int").join(sizes, "cell", "left").groupBy("query").agg((F.coalesce(F.sum("n"), F.lit(0)) / max(total, 1)).alias("share"))
