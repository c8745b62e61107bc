"""Ordered joins, cubes and sketches on small frames."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.operators import asof, cubes, sketches


def plain_asof(left, right, strict=False, tolerance=None):
    out = []
    for key, t, own in left:
        found = None
        for k, u, tie, value in right:
            if None in (key, t, k, u) or k != key or (u >= t if strict else u > t):
                continue
            rank = (u, tie is not None, tie if tie is not None else 0)
            if found is None or rank > found[0]:
                found = (rank, u, value)
        if found and tolerance is not None and found[1] < t - tolerance:
            found = None
        out.append((key, t, own, found[1] if found else None, found[2] if found else None))
    return sorted(out, key=repr)


KEY, TIME = st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 12))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(KEY, TIME, st.integers(0, 9)), max_size=25), st.lists(st.tuples(KEY, TIME, st.one_of(st.none(), st.integers(0, 50)), st.integers(0, 9)), max_size=25, unique_by=lambda r: r[2]), st.booleans(), st.sampled_from([None, 0, 3]), st.sampled_from([1, 2, 7]))
def test_asof_of_any_rows(spark, left, right, strict, tolerance, ranges):
    l = spark.createDataFrame(left, "`a.k` long, t long, `own.b` long")  # noqa: E741
    r = spark.createDataFrame(right, "k long, t long, tie long, `own.b` long")
    j = asof.asof_join(l, r, [("a.k", "k")], ("t", "t"), "tie", strict=strict, tolerance=None if tolerance is None else F.lit(tolerance), ranges=ranges)
    assert j.columns == ["a.k", "t", "own.b", "right_k", "right_t", "right_tie", "right_own.b"]
    got = sorted(((x[0], x[1], x[2], x[4], x[6]) for x in j.collect()), key=repr)
    assert got == plain_asof(left, right, strict, tolerance)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double"])
def test_asof_times_of_any_type(spark, kind):
    start = datetime.datetime(2024, 10, 27)
    time = {"date": lambda i: start.date() + datetime.timedelta(days=i), "double": lambda i: i / 2}.get(kind, lambda i: start + datetime.timedelta(minutes=10 * i))
    l = spark.createDataFrame([("k", time(i), i) for i in range(0, 200, 3)], f"k string, t {kind}, i long")  # noqa: E741
    r = spark.createDataFrame([("k", time(i), i) for i in range(5, 200, 7)], f"k string, t {kind}, i long")
    got = asof.asof_join(l, r, [("k", "k")], ("t", "t"), "i", ranges=9).collect()
    assert {x.i: x.right_i for x in got} == {i: max((j for j in range(5, 200, 7) if j <= i), default=None) for i in range(0, 200, 3)}


def test_a_hot_key_is_split(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id")
    bounds = asof.range_bounds(rows.select(F.col("t").alias("__t")), rows.limit(0).select(F.col("t").alias("__t")), 16)
    sizes = [b - a for a, b in zip([0, *bounds], [*bounds, 4000])]
    assert len(bounds) == 15 and max(sizes) < 2 * 4000 / 16
    j = asof.asof_join(rows.where("id % 2 = 0"), rows.where("id % 50 = 7"), [("k", "k")], ("t", "t"), "id", ranges=16)
    assert all(x.right_id == (None if x.id < 7 else (x.id - 7) // 50 * 50 + 7) for x in j.collect())
    plan = j._jdf.queryExecution().analyzed().toString()
    assert "Window [last" in plan and "__r" in plan.split("Window [last")[1].split("]")[1]


def test_asof_of_empty_tables(spark):
    l = spark.createDataFrame([(1, 5)], "k long, t long")  # noqa: E741
    r = spark.createDataFrame([], "k long, t long")
    assert [tuple(x) for x in asof.asof_join(l, r, [("k", "k")], ("t", "t"), "t").collect()] == [(1, 5, None, None)]
    assert asof.asof_join(r, l, [("k", "k")], ("t", "t"), "t").collect() == []


# cubes and sketches


def plain_sets(rows, sets, n_dims):
    out = []
    for s in sets:
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[i] if i in s else None for i in range(n_dims)), []).append(r)
        if not s and not rows:
            groups[(None,) * n_dims] = []
        bits = sum(1 << (n_dims - 1 - i) for i in range(n_dims) if i not in s)
        for k, mine in groups.items():
            values = [r[-1] for r in mine if r[-1] is not None]
            out.append((*k, bits, len(mine), len({r[-2] for r in mine if r[-2] is not None}), sum(values) if values else None))
    return sorted(out, key=repr)


def test_cubes_and_rollups_of_odd_rows(spark):
    rows = [("a", 1, 5, 1), ("a", 1, 5, 2), ("a", None, 6, None), (None, 1, None, 4), (None, None, 5, 5), ("b", 2, 7, 6), ("b", 2, 7, 6)] + [("hot", 9, i % 3, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "x string, y long, u long, v long")
    got = sorted((tuple(r) for r in cubes.cube(df, ["x", "y"], "u", "v").collect()), key=repr)
    assert got == plain_sets(rows, [{0, 1}, {0}, {1}, set()], 2)
    got = sorted((tuple(r) for r in cubes.rollup(df, ["x", "y"], "u", "v").collect()), key=repr)
    assert got == plain_sets(rows, [{0, 1}, {0}, set()], 2)
    assert [tuple(r) for r in cubes.cube(df.limit(0), ["x", "y"], "u", "v").collect()] == plain_sets([], [set()], 2)


def test_cubes_expand_what_is_added_up_and_not_the_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = cubes.cube(df, ["l_returnflag", "l_linestatus"], "l_suppkey", "l_quantity")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    below = plan[plan.index("Generate") :]  # the first addition lies below the multiplication
    assert "Aggregate" in below


def test_sketches_stay_within_their_bounds(spark):
    rows = spark.range(60_000).select(F.expr("timestamp_seconds(1704067200 + id)").alias("ts"), F.lit("k").alias("key"), (F.col("id") % 20_011).alias("u"), F.expr("CAST(pmod(hash(id), 100000) AS DOUBLE)").alias("v"))
    hours = sketches.hourly(rows, "ts", "key", "u", "v")
    assert hours.count() == 17
    r = sketches.merged(hours, "key").select("n", sketches.distinct(F.col("members")).alias("d"), *[sketches.quantile(F.col("quantiles"), q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
    assert r.n == 60_000 and abs(r.d - 20_011) <= 0.035 * 20_011
    ranks = rows.agg(*[F.avg((F.col("v") <= r[f"q{i}"]).cast("double")) for i in range(3)]).first()
    assert all(abs(a - b) <= sketches.RANK for a, b in zip(ranks, (0.1, 0.5, 0.99)))
    low = F.lit("2024-01-01 02:00:00").cast("timestamp")
    two = sketches.merged(sketches.within(hours, low, low + F.expr("INTERVAL 2 HOURS"))).select("n", sketches.distinct(F.col("members")).alias("d")).first()
    assert two.n == 7200 and abs(two.d - 7200) <= 0.035 * 7200


def test_sketches_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a", 1, 1.0), ("2024-01-01 00:10:00", "a", None, None), ("2024-01-01 00:20:00", None, 3, 2.0), ("2024-01-01 00:30:00", None, 3, 4.0)], "ts string, key string, u long, v double")
    got = {(r.key, r.hour is None): (r.n, r.d, r.total) for r in sketches.hourly(rows, "ts", "key", "u", "v").withColumn("d", sketches.distinct(F.col("members"))).collect()}
    assert got == {("a", True): (1, 1, 1.0), ("a", False): (1, 0, None), (None, False): (2, 1, 6.0)}
    assert sketches.hourly(rows.limit(0), "ts", "key", "u", "v").count() == 0


def test_overlaps_of_sets_too_large_for_a_sketch(spark):
    """9,000 members of one key and 6,000 of another were estimates; the pair of small sets answers by its sketches."""
    part = lambda key, low, high: spark.range(low, high).select(F.lit(key).alias("key"), F.col("id").alias("u"))
    rows = part("a", 0, 9000).unionByName(part("b", 5000, 11_000)).unionByName(part("c", 8990, 9010)).unionByName(part("d", 9005, 9020)).unionByName(part("a", 0, 10))
    hours = sketches.hourly(rows.withColumn("ts", F.lit("2024-01-01 00:30:00")).withColumn("v", F.lit(1.0)), "ts", "key", "u", "v")
    got = sorted(tuple(r) for r in sketches.overlaps(sketches.merged(hours, "key"), rows, "u").collect())
    assert got == [("a", "b", 4000, 5000), ("a", "c", 10, 8990), ("a", "d", 0, 9000), ("b", "c", 20, 5980), ("b", "d", 15, 5985), ("c", "d", 5, 15)]
