import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import svd_whitening as p

from .conftest import SF


def plain(vectors, components=16):
    """By one eigendecomposition of the covariance: n, sums, eigenvectors, eigenvalues, trace."""
    x = np.array(sorted({tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors}), np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, s, u[:, ::-1][:, :components].T, e[::-1][:components], e.sum(), centred


def check(rows, vectors, components=16):
    n, s, u, e, trace, centred = plain([v for v in vectors.values()], components)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * components
    signs = {}
    for id_, v in vectors.items():
        x = np.array([int(np.floor(64 * float(c))) + 1_000_000 for c in v])
        want = (x * n - s) / n @ u.T / np.sqrt(e)
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
        for k in range(components):
            r = got[id_, k + 1]
            assert (r.n, int(r.deviation_exact)) == (n, exact) and r.deviation == (exact if exact < 2**63 else None)
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9) and r.identity_error < 1e-9
            if abs(want[k]) > 1e-6:
                sign = signs.setdefault(k, np.sign(r.whitened) * np.sign(want[k]))
                assert r.whitened * sign == pytest.approx(want[k], rel=1e-6, abs=1e-9)


def test_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect() if r.embedding is not None}
    check(p.whitened(table).collect(), vectors)


@pytest.mark.parametrize("parts", [1, 2, 30])
def test_merged_states_are_that_of_all(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 1, 0.5, 0.2] + 40).tolist()) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    check(p.whitened(table, components=6).collect(), dict(rows), 6)
    fit = p.whole_numbers(table).select("x").distinct().repartition(parts)
    n, _, _, e, trace, _ = plain([v for _, v in rows], 6)
    part = p._states(fit, p.Part.of)[6]
    assert part.n == n and np.allclose(part.values**2 / n, e, rtol=1e-9)


def test_merge_keeps_every_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (90, 12))
    merged = p.Part.of(x[:3]) + p.Part.of(x[3:4]) + p.Part.of(x[4:])
    whole = p.Part.of(x)
    assert merged.n == 90 and (merged.sums == whole.sums).all() and len(merged.values) == 12
    assert np.allclose(merged.values, whole.values) and np.allclose(np.abs((merged.vectors * whole.vectors).sum(axis=1)), 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (None, [3.0, 1.0], 3), (2, [nan, 1.0], 4), (3, [inf, 1.0], 5), (4, None, 6), (5, [None, 1.0], 7), (6, [], 8), (7, [5.0, 5.5], 9), (8, [1.0, 2.0, 3.0], 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").withColumn("a.b", F.lit(1))
    got = p.whitened(table).collect()
    # three distinct vectors of length 2; a single one of length 3 has no components
    assert sorted((repr(r.vec_id), r.component, r.n) for r in got) == sorted((repr(i), c, 3) for i in (1, 1, None, 7) for c in (1, 2))
    assert max(r.identity_error for r in got) < 1e-9
    assert p.whitened(table.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], "vec_id long, embedding array<double>")
    assert p.whitened(same).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(i, [1e8 * i, -3e8 * i + (i % 3), 7.0]) for i in range(1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = p.whitened(table, components=2).collect()
    n = 8
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows}
    s = [sum(v[k] for v in x.values()) for k in range(3)]
    for r in got:
        exact = sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert int(r.deviation_exact) == exact and r.deviation == (exact if exact < 2**63 else None)
