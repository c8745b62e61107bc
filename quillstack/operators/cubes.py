"""Grouping sets, rollups and cubes with distinct counts, without multiplying the rows of the table.

Rows are added up by all dimensions and the counted column first, in the scan's own stage and then by key: what is left has a row for each different combination. Only that is expanded to the
grouping sets, added up again with the counted column, and last without it, where each row is one distinct value. A value that a third of all rows have is one row a task after the first step.

Defined cases: a null dimension is a value of its own, told from a rolled-up one by ``grouping``; null values of the counted column aren't counted; sums leave nulls out; an empty
table gives the empty set's row alone, as SQL does.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_sets(dims: list[str]) -> list[list[str]]:
    return [dims[:n] for n in range(len(dims), -1, -1)]


def cube_sets(dims: list[str]) -> list[list[str]]:
    return [list(c) for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def grouped(rows: DataFrame, sets: list[list[str]], dims: list[str], counted: str, summed: str) -> DataFrame:
    """dims, ``grouping`` (a bit for each dimension that is rolled up, the first the highest), n, n_distinct of ``counted``, total of ``summed``, for each of ``sets``."""
    named = rows.select(*[F.col(c).alias(f"__d{i}") for i, c in enumerate(dims)], F.col(counted).alias("__x"), F.col(summed).alias("__v"))
    keys = {c: f"__d{i}" for i, c in enumerate(dims)}
    base = named.groupBy(*keys.values(), "__x").agg(F.count("*").alias("n"), F.sum("__v").alias("total"))
    bits = lambda s: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in s)
    # a row of `base` for each set, with nulls for what the set rolls up
    each = F.explode(F.array(*[F.struct(F.lit(bits(s)).alias("g"), *[(F.col(k) if c in s else F.lit(None).cast(named.schema[k].dataType)).alias(k) for c, k in keys.items()]) for s in sets])).alias("s")
    many = base.select(each, "__x", "n", "total").select("s.*", "__x", "n", "total")
    once = many.groupBy("g", *keys.values(), "__x").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = once.groupBy("g", *keys.values()).agg(F.sum("n").alias("n"), F.count("__x").alias("n_distinct"), F.sum("total").alias("total"))
    out = out.select(*[F.col(k).alias(c) for c, k in keys.items()], F.col("g").alias("grouping"), "n", "n_distinct", "total")
    if [] in [list(s) for s in sets]:  # SQL's row for all of nothing
        spark, whole = rows.sparkSession, (1 << len(dims)) - 1
        none = spark.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in dims], F.lit(whole).alias("grouping"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_distinct"), F.lit(None).cast(out.schema["total"].dataType).alias("total"))
        out = out.unionByName(none.join(rows.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"))
    return out


def cube(rows: DataFrame, dims: list[str], counted: str, summed: str) -> DataFrame:
    return grouped(rows, cube_sets(dims), dims, counted, summed)


def rollup(rows: DataFrame, dims: list[str], counted: str, summed: str) -> DataFrame:
    return grouped(rows, rollup_sets(dims), dims, counted, summed)
