"""As-of join: each row with the newest row of another table at or before its time.

Both tables are dealt by key and time range; ranges are quantiles of the times, so a key with many rows is split. Within a key's range one pass in order of time carries the
last value forward. The last value of a range is carried into the ranges behind it, from a table with a row for each key and range, so no task sees all rows of a key.

Defined cases: of rows at one instant the one with the largest ``tie`` counts; a null time or key matches nothing, and such a row of ``left`` stays without a match; repeated rows of
``left`` stay; columns of ``right`` come with a prefix, so equal names don't clash; names may hold dots; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES, ACCURACY = 64, 1000


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _place(time: Column, bounds: list, kind) -> Column:
    """How many bounds, of the type of the times, are at or before a time, by halving."""

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(time < F.lit(bounds[middle]).cast(kind), find(low, middle)).otherwise(find(middle + 1, high))

    return find(0, len(bounds))


def range_bounds(left: DataFrame, right: DataFrame, ranges: int) -> list:
    """``ranges`` - 1 quantiles at most of the times (``__t``) of both tables."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    both = left.select("__t").unionByName(right.select("__t")).where("__t IS NOT NULL")
    found = both.agg(F.percentile_approx("__t", at, ACCURACY).alias("q")).first().q
    return sorted(set(found or []))


def asof_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], times: tuple[str, str], tie: str, prefix: str = "right_", strict: bool = False, tolerance: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """``left`` with the columns of the newest row of ``right`` with equal keys (``on``, pairs of names) and a time at or before (``strict``: before) its own, and, with
    ``tolerance``, no older than that; nulls where there is none."""
    keys = [f"__k{i}" for i in range(len(on))]
    own = F.struct(*[_name(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    other = F.struct(*[_name(c).alias(f"c{i}") for i, c in enumerate(right.columns)])
    l = left.select(*[_name(a).alias(k) for k, (a, _) in zip(keys, on)], _name(times[0]).alias("__t"), own.alias("__own"))  # noqa: E741
    r = right.select(*[_name(b).alias(k) for k, (_, b) in zip(keys, on)], _name(times[1]).alias("__t"), _name(tie).alias("__tie"), other.alias("__other")).where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "__t"]))
    # of rows at one instant one counts, found before anything is dealt by range
    r = r.groupBy(*keys, "__t").agg(F.max_by("__other", F.struct(F.col("__tie").isNotNull(), "__tie")).alias("__other"))
    bounds = range_bounds(l, r, ranges)
    # null times have a range without rows of `right`, null keys equal no key
    place = F.when(F.col("__t").isNull(), -1).otherwise(_place(F.col("__t"), bounds, l.schema["__t"].dataType))
    l, r = l.withColumn("__r", place), r.withColumn("__r", place)

    rows = l.withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    # of equal times, rows of `right` come first unless the join is strict
    before = Window.partitionBy(*keys, "__r").orderBy("__t", F.col("__left") != F.lit(strict)).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("__other").isNotNull(), F.struct("__t", "__other"))
    inside = rows.withColumn("__hit", F.last(hit, ignorenulls=True).over(before)).where("__left")

    # the last value of each range with rows, then of the ranges before it: a row for each key and range at most
    last = r.groupBy(*keys, "__r").agg(F.max_by(F.struct("__t", "__other"), "__t").alias("__last"))
    ahead = Window.partitionBy(*keys).orderBy("__r")
    until = last.select(*keys, F.col("__r").alias("__from"), F.lead("__r").over(ahead).alias("__to"), "__last")
    carried = until.select(*keys, F.explode(F.sequence(F.col("__from") + 1, F.coalesce(F.col("__to"), F.lit(len(bounds))))).alias("__r"), "__last").where(F.col("__from") < len(bounds))
    joined = inside.join(carried, [*keys, "__r"], "left")

    found = F.coalesce("__hit", "__last")
    if tolerance is not None:
        found = F.when(found["__t"] >= F.col("__t") - tolerance, found)
    joined = joined.withColumn("__found", found["__other"])
    back = [F.col("__own")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)]
    return joined.select(*back, *[F.col("__found")[f"c{i}"].alias(f"{prefix}{c}") for i, c in enumerate(right.columns)])
