"""Exact top-k by inner product over a pivot-distance index.

Vectors are made integers, floor(``SCALE`` * x). Those of one length are an index of their own: they are lengthened by one coordinate, the root of
their largest squared norm less their own, so that all have the same norm; a query gets a zero there. Distance between
them then falls exactly as the inner product rises, and metric bounds hold.

Index: pivots of a length are chosen farthest-first from a bounded sample (``SAMPLE`` rows of smallest hash over all lengths,
fewer of very long vectors); each vector is keyed by its nearest pivot and the distance to it, rows are range-partitioned and sorted by that key, and
every run of ``RING`` rows of one pivot is an annulus, stored as one row with its radii.

Search: queries are keyed and cut into blocks likewise. A query's first bound is its k-th score in the sample; with it, a ball around the query holds all
better vectors, and a block's balls reach an interval of distances from each pivot. Blocks meet the annuli that their intervals
touch in a join of numbers. Only pairs left by it move vectors: neighbouring blocks and neighbouring annuli are joined to bundles of some
``BUNDLE`` bytes, and each pair of bundles is one task's work, so that what moves falls with the size of a bundle. Queries lie in as few partitions as
their bytes need; annuli keep to the session's number of partitions, which is that of the tasks. There annuli are expanded in order of their
lower bound, | d(q, pivot) - radius |, and the search stops once the triangle inequality shows that none left can hold a better score.

Scores are sums of integer products in float64, exact below 2 ** 53; distances only prune, with slack. Vectors whose squared norm is
2 ** 52 or more are not indexed: they meet the queries, and as queries all vectors, in blocks, with integers of any size.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, all others do; a query meets the vectors of
its own length, empty ones among themselves with score zero; a score beyond the range of a long is the nearest long and ranked by its true value; a row
without a vec_id is found like any other, comes after equal scores that have one and keeps its null; repeated rows are rows of their own, a query meets all but itself;
ties go to the smaller vec_id; fewer rows than k give fewer results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm._tables import written

SCALE, SAMPLE, SAMPLE_BYTES, PIVOTS, RING, BLOCK, BUNDLE = 256, 2048, 1 << 25, 32, 256, 64, 1 << 25
SLACK = 1e-6
EXACT = 1 << 52  # squared norms below it are indexed
_LONG = 2**63 - 1
_FOUND = "query_row long, query_id long, vec_id long, score long, beyond string"
_RUN = "dim int, pivot int, inner double, outer double, ids binary, named binary, rows binary, vectors binary"


def _ints(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of finite doubles, exactly."""
    return [int(np.floor(v * scale)) if abs(v) < 2.0**44 else int(v) * scale for v in x.tolist()]


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, row, dim, norm, wide and v of the rows that take part: packed 32-bit integers, or, where ``wide``, the doubles themselves."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = vectors.where(F.col("embedding").isNotNull() & sound)
    rows = good.select("vec_id", F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            flat, at = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py() if len(x) else np.zeros(1, np.int64)
            with np.errstate(over="ignore"):
                y = np.floor(flat * scale)
                upto = np.r_[0.0, np.cumsum(np.minimum(y * y, float(EXACT)))]
            wide = upto[at[1:]] - upto[at[:-1]] >= EXACT
            # sums over many rows round; what is near the bound is summed again by itself
            near = np.flatnonzero(~wide & (upto[at[1:]] >= EXACT))
            norm = np.array([0.0 if w else float((y[i:j] ** 2).sum()) for w, i, j in zip(wide, at[:-1], at[1:])])
            wide[near] |= norm[near] >= EXACT
            packed = [flat[i:j].tobytes() if w else y[i:j].astype("<i4").tobytes() for w, i, j in zip(wide, at[:-1], at[1:])]
            columns = [b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int32)), pa.array(norm.astype(np.int64)), pa.array(wide), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "row", "dim", "norm", "wide", "v"])

    return rows.mapInArrow(run, "vec_id long, row long, dim int, norm long, wide boolean, v binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of packed int32 vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.float64)


def _lifted(x: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top - norm, 0))]


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice."""
    chosen, dist = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        dist = np.minimum(dist, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(dist.argmax()))
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


class Guide:
    """Of one length: pivots, and the sampled vectors with their rows, for first bounds."""

    def __init__(self, dim: int, top: float, sample: np.ndarray, rows: np.ndarray):
        self.dim, self.top, self.sample, self.rows = dim, top, sample, rows
        self.pivots = _pivots(_lifted(sample, (sample**2).sum(axis=1), top), PIVOTS) if len(sample) else np.zeros((0, dim + 1))

    def bounds(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """What the k-th score of each query is at least."""
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        first = q @ self.sample.T
        first[own[:, None] == self.rows[None, :]] = -np.inf
        return np.partition(first, -k, axis=1)[:, -k]


def guides(rows: DataFrame) -> dict[int, Guide]:
    """A guide for every length in the sample; bounded by ``SAMPLE`` rows and ``SAMPLE_BYTES``."""
    longest = rows.agg(F.max("dim")).first()[0]
    if longest is None:
        return {}
    n = max(PIVOTS, min(SAMPLE, SAMPLE_BYTES // (8 * longest + 8)))
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(n).select("dim", "row", "v", "top").toArrow()
    dims = drawn["dim"].to_numpy()
    out = {}
    for d in np.unique(dims).tolist():
        mine = drawn.filter(pa.array(dims == d))
        out[d] = Guide(d, float(mine["top"][0].as_py()), _matrix(mine["v"], d), mine["row"].to_numpy())
    return out


def runs(rows: DataFrame, found: dict[int, Guide], queries: bool, ring: int) -> DataFrame:
    """``rows`` (vec_id, row, dim, norm, top, v) by length, nearest pivot and distance, ``ring`` of them in a row. A length without
    a guide has no pivot (-1) and one unbounded run after the other. ``queries`` have no lift."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, near, dist = b.column(2).to_numpy(), np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for d in np.unique(dims).tolist():
                guide, at = shared.value.get(d), np.flatnonzero(dims == d)
                if guide is None:
                    continue
                x = _matrix(b.column(5).take(pa.array(at)), d)
                x = np.c_[x, np.zeros(len(x))] if queries else _lifted(x, b.column(3).to_numpy()[at].astype(np.float64), guide.top)
                all_ = _distances(x, guide.pivots)
                near[at] = all_.argmin(axis=1)
                dist[at] = all_[np.arange(len(x)), near[at]]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(near), pa.array(dist), b.column(0), b.column(1), b.column(5)], names=["dim", "pivot", "dist", "vec_id", "row", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one length and pivot in a sorted partition."""
        held: pa.Table | None = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows > ring:
                held = yield from cut(held)
        while held is not None and held.num_rows:
            held = yield from cut(held)

    def cut(held: pa.Table) -> Iterator[pa.RecordBatch]:
        dim, pivot = (held[c].slice(0, ring).to_numpy() for c in ("dim", "pivot"))
        n = int(np.argmin(np.r_[(dim == dim[0]) & (pivot == pivot[0]), False]))
        part = held.slice(0, n)
        dist = part["dist"].to_numpy()
        outer = float(dist[-1]) if pivot[0] >= 0 else float("inf")
        ids = part["vec_id"].combine_chunks()
        binary = [ids.fill_null(_LONG).to_numpy().astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), part["row"].to_numpy().astype("<i8").tobytes(), b"".join(part["v"].to_pylist())]
        one = [pa.array([int(dim[0])], pa.int32()), pa.array([int(pivot[0])], pa.int32()), pa.array([float(dist[0])]), pa.array([outer]), *[pa.array([x], pa.binary()) for x in binary]]
        yield pa.RecordBatch.from_arrays(one, names=[c.split()[0] for c in _RUN.split(", ")])
        return held.slice(n)

    base = rows.select("vec_id", "row", "dim", "norm", "top", "v").mapInArrow(keyed, "dim int, pivot int, dist double, vec_id long, row long, v binary")
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if queries:  # each annulus moves once for each bundle of queries that it meets, so these are filled
        n = -(-int(rows.agg(F.sum(4 * F.col("dim") + 32)).first()[0] or 1) // BUNDLE)
    ranged = base.repartitionByRange(n, "dim", "pivot", "dist", "row").sortWithinPartitions("dim", "pivot", "dist", "row")
    # neighbours have neighbouring numbers; a bundle is a range of them within a partition
    number = F.monotonically_increasing_id()
    each = F.greatest(F.lit(1), F.lit(BUNDLE).cast("long") / (F.lit(ring) * (4 * F.col("dim") + 32)))
    bundle = F.xxhash64(F.shiftright("run", 33), F.col("dim"), F.floor(F.col("run").bitwiseAND((1 << 33) - 1) / each))
    return ranged.mapInArrow(packed, _RUN).withColumn("run", number).withColumn("bundle", bundle)


def _unpacked(runs_: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether there is one, rows, vectors) of each run."""
    for i in range(runs_.num_rows):
        rows = np.frombuffer(runs_["rows"][i].as_py(), "<i8")
        vectors = np.frombuffer(runs_["vectors"][i].as_py(), "<i4").reshape(len(rows), dim).astype(np.float64)
        yield np.frombuffer(runs_["ids"][i].as_py(), "<i8"), np.frombuffer(runs_["named"][i].as_py(), bool), rows, vectors


def reach(asked: DataFrame, found: dict[int, Guide], k: int) -> DataFrame:
    """(run, bundle, dim, pivot, low, high): the distances from each pivot within which a block of queries can find better vectors."""
    shared = asked.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            out: list[tuple[int, int, int, int, float, float]] = []
            for i in range(t.num_rows):
                dim, at = t["dim"][i].as_py(), (t["run"][i].as_py(), t["bundle"][i].as_py())
                guide = shared.value.get(dim)
                if guide is None:
                    out.append((*at, dim, -1, 0.0, float("inf")))
                    continue
                (_, _, rows, q), = _unpacked(t.slice(i, 1), dim)
                ball = np.sqrt(np.maximum((q**2).sum(axis=1) + guide.top - 2 * guide.bounds(q, rows, k), 0)) * (1 + SLACK) + SLACK
                d = _distances(np.c_[q, np.zeros(len(q))], guide.pivots)
                low, high = (d - ball[:, None]).min(axis=0) - SLACK, (d + ball[:, None]).max(axis=0) + SLACK
                out += [(*at, dim, p, float(low[p]), float(high[p])) for p in range(len(low))]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["run", "bundle", "dim", "pivot", "low", "high"])

    return asked.mapInArrow(run, "run long, bundle long, dim int, pivot int, low double, high double")


def _best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query."""
    order = np.lexsort((ids, -score, who))
    start = np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[nth < k]


def _result(row: np.ndarray, query: np.ndarray, vec: np.ndarray, named: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({
        "query_row": row.astype(np.int64), "query_id": query.astype(np.int64), "vec_id": pa.array(vec.astype(np.int64), mask=~named.astype(bool)),
        "score": score.astype(np.int64), "beyond": pa.array([""] * len(row), pa.string())})


def indexed(index: DataFrame, asked: DataFrame, found: dict[int, Guide], k: int) -> DataFrame:
    """The best ``k`` of each pair of bundles."""
    reaches = reach(asked, found, k).select("run", "bundle", "dim", "pivot", "low", "high")
    rings = index.select(F.col("run").alias("ring"), F.col("bundle").alias("group"), "dim", "pivot", "inner", "outer")
    pairs = reaches.join(rings, ["dim", "pivot"]).where("outer >= low AND inner <= high").select("run", "bundle", "ring", "group")
    pairs = written(pairs, "pairs")
    left = index.drop("bundle").join(pairs.select("bundle", "group", F.col("ring").alias("run")).distinct(), "run")
    right = asked.drop("bundle").join(pairs.select(F.col("bundle").alias("b"), F.col("group").alias("g"), "run").distinct(), "run")
    shared = index.sparkSession.sparkContext.broadcast(found)

    def search(key: tuple[pa.Scalar, ...], annuli: pa.Table, blocks: pa.Table) -> pa.Table:
        dim = annuli["dim"][0].as_py()
        ids, _, own, q = (np.concatenate(x) for x in zip(*_unpacked(blocks, dim)))
        guide = shared.value.get(dim)
        limit = guide.bounds(q, own, k) if guide else np.full(len(q), -np.inf)  # the k-th score is at least this
        best = np.full((len(q), annuli.num_rows), np.inf)  # the largest score an annulus can hold
        if guide:
            d = _distances(np.c_[q, np.zeros(len(q))], guide.pivots)[:, annuli["pivot"].to_numpy()]
            least = np.maximum(np.maximum(annuli["inner"].to_numpy() - d, d - annuli["outer"].to_numpy()), 0) * (1 - SLACK) - SLACK
            best = ((q**2).sum(axis=1)[:, None] + guide.top - np.maximum(least, 0) ** 2) / 2
        hits: list[tuple[np.ndarray, ...]] = []
        for j in np.argsort(-best.max(axis=0)):
            ask = np.flatnonzero(best[:, j] >= limit)
            if not len(ask):
                if best[:, j].max() < limit.min():
                    break
                continue
            (vec, named, row, x), = _unpacked(annuli.slice(int(j), 1), dim)
            score = q[ask] @ x.T
            score[own[ask][:, None] == row[None, :]] = -np.inf
            hit_q, hit_x = np.nonzero((score >= limit[ask][:, None]) & (score > -np.inf))
            hits.append((ask[hit_q], vec[hit_x], named[hit_x], score[hit_q, hit_x]))
            if score.shape[1] >= k:
                limit[ask] = np.maximum(limit[ask], np.partition(score, -k, axis=1)[:, -k])
        if not hits:
            none = np.zeros(0, np.int64)
            return _result(none, none, none, none, none)
        who, vec, named, score = (np.concatenate(x) for x in zip(*hits))
        keep = _best(who, vec, score, k)
        return _result(own[who[keep]], ids[who[keep]], vec[keep], named[keep], score[keep])

    return left.groupBy("bundle", "group").cogroup(right.groupBy("b", "g")).applyInArrow(search, _FOUND)


def _beyond(score: int) -> str:
    """Orders scores that share the same nearest long; descending like the scores."""
    if -(2**63) <= score <= _LONG:
        return "" if score > 0 else "~"
    digits = str(abs(score))
    named = f"{len(digits):06d}{digits}"
    return named if score > 0 else named.translate(str.maketrans("0123456789", "9876543210"))


def unindexed(rows: DataFrame, is_query: Column, k: int, scale: int) -> DataFrame:
    """The best ``k`` of pairs with a wide vector: narrow queries against wide rows, wide queries against all, in blocks."""
    queries, wide = rows.where(is_query), rows.where("wide")
    part = lambda d, n: d.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)))
    bound = lambda d: max(1, -(-d.count() // (4 * RING)))
    out = None
    for asked, met in ((queries.where("NOT wide"), wide), (queries.where("wide"), rows)):
        n, m = bound(asked), bound(met)
        left = part(met, m).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("dim", "part", "ask", "vec_id", "row", "wide", "v")
        right = part(asked, n).withColumn("meet", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("dim", F.col("part").alias("ask"), F.col("meet").alias("part"), "vec_id", "row", "wide", "v")

        def search(key: tuple[pa.Scalar, ...], rows_: pa.Table, queries_: pa.Table) -> pa.Table:
            whole = lambda t: [_ints(np.frombuffer(v, "<f8"), scale) if w else np.frombuffer(v, "<i4").tolist() for v, w in zip(t["v"].to_pylist(), t["wide"].to_pylist())]
            x, names, of = whole(rows_), rows_["vec_id"].to_pylist(), rows_["row"].to_pylist()
            out: list[tuple] = []
            for q, query, own in zip(whole(queries_), queries_["vec_id"].to_pylist(), queries_["row"].to_pylist()):
                scores = [(-sum(a * b for a, b in zip(q, v)), i is None, i or 0, i) for v, i, r in zip(x, names, of) if r != own]
                out += [(own, query, i, max(-(2**63), min(_LONG, -s)), _beyond(-s)) for s, _, _, i in sorted(scores, key=lambda y: y[:3])[:k]]
            columns = list(zip(*out)) or [()] * 5
            return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], names=[c.split()[0] for c in _FOUND.split(", ")])

        found = left.groupBy("dim", "part", "ask").cogroup(right.groupBy("dim", "part", "ask")).applyInArrow(search, _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query row of ``vectors`` (vec_id, embedding)."""
    rows = written(prepared(vectors, scale), "vectors")
    narrow = rows.where("NOT wide")
    narrow = narrow.join(narrow.groupBy("dim").agg(F.max("norm").alias("top")), "dim")
    found = guides(narrow)
    index = written(runs(narrow, found, False, RING), "annuli")
    asked = written(runs(narrow.where(is_query), found, True, BLOCK), "asked")
    parts = indexed(index, asked, found, k)
    if not rows.where("wide").isEmpty():
        parts = parts.unionByName(unindexed(rows, is_query, k, scale))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
