import math
import random
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from quillstack.llm import pivot_index as p
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of


def brute(rows, k):
    """Exact integers; a query meets vectors of its own length; null ids come last among equal scores."""
    whole = lambda x: math.floor(Fraction(x) * 256)
    ok = [(i, v, [whole(x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in ok:
        if v is not None and v % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), w is None, w or 0, w) for j, w, f in ok if j != i and len(f) == len(e))[:k]
            out += [(v, n, w, max(-(2**63), min(2**63 - 1, -s))) for n, (s, _, _, w) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(df, k=5):
    return sorted((tuple(x) for x in p.top_k(df, F.col("vec_id") % 50 == 0, k).collect()), key=repr)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = QUERIES["op5_pivot_distance_topk"](spark, SF)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op5_pivot_distance_topk']})").fetchall()) == sorted(rows_of(df))


def test_odd_vectors_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(p, "SAMPLE", 40)
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25]) for _ in range(4)]) for i in range(300)]
    rows += [(50, [0.25] * 4), (50, [0.25] * 4), (700, [9.0] * 4), (None, [0.1] * 4)]
    rows += [(750, None), (800, []), (850, [None, 0.1, 0.1, 0.1]), (900, [float("nan")] * 4), (950, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    assert found(df) == brute(rows, 5)


def test_clustered_vectors_over_many_annuli(spark, monkeypatch):
    monkeypatch.setattr(p, "SAMPLE", 64)
    monkeypatch.setattr(p, "BLOCK", 8)
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == brute(rows, 5)


def test_few_rows_and_empty(spark):
    one = spark.createDataFrame([(0, [0.5, 1.0]), (1, [0.25, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in p.top_k(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 128 * 64)]
    assert p.top_k(one.limit(0), F.lit(True)).count() == 0
    assert p.top_k(one, F.lit(False)).count() == 0


def test_every_finite_vector_takes_part_whatever_its_size(spark):
    """Components whose products exceed 64-bit integers and doubles, on both sides of a pair."""
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(200)]
    rows += [(250, [1e8, -1e8, 0.5]), (251, [4e6, 1.0, 1.0]), (252, [-4e6, 0.0, 2.0]), (300, [1e300, 1.0, -1e300]), (301, [1e300, 0.0, 0.0]), (302, [1.7e308, 1.7e308, 0.25])]
    rows += [(303, [-1e300, 5.0, 0.0]), (None, [1e9, 1e9, 1e9]), (304, [262143.0, 0.0, 0.0]), (305, [2.0**18, 0.0, 0.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 5)


def test_lengths_are_indexes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(p, "SAMPLE", 40)
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(r.choice([1, 2, 2, 2, 5]))]) for i in range(600)]
    rows += [(0, [1.0] * 7), (1, [2.0] * 7), (100, []), (2, []), (None, []), (150, [1e9] * 9), (3, [1.0] * 9)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 5)


def test_rows_without_an_id(spark):
    rows = [(None, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (-9, [0.5, 0.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 5) == sorted([(50, 1, 7, 65536), (50, 2, None, 65536), (50, 3, None, 65536), (50, 4, -9, 32768)], key=repr)


def test_vectors_out_of_reach_do_not_move(spark, monkeypatch):
    """Far clusters: most pairs of blocks and annuli are gone before vectors are joined to them."""
    for name, value in (("RING", 16), ("BLOCK", 4), ("BUNDLE", 1 << 10), ("SAMPLE", 400)):
        monkeypatch.setattr(p, name, value)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    centres = [[x / math.hypot(*c) for x in c] for c in centres]
    rows = [(i, [x + r.gauss(0, 0.01) for x in centres[i % 20]]) for i in range(4000)]
    pairs = []
    keep = p.written
    monkeypatch.setattr(p, "written", lambda df, name: pairs.append(out) or out if name == "pairs" and (out := keep(df, name)) else keep(df, name))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == brute(rows, 5)
    blocks, rings = pairs[0].agg(F.count_distinct("run"), F.count_distinct("ring")).first()
    assert pairs[0].count() < 0.5 * blocks * 4000 / 16
