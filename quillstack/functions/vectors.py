"""Vector arithmetic over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; NaN where a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / norm)


def preview(v: Column, n: int = 5) -> Column:
    return F.slice(v, 1, n)


def preview_text(v: Column, n: int = 5) -> Column:
    return F.concat(F.array_join(F.transform(preview(v, n), lambda x: F.format_string("%.6f", x.cast("double"))), ", "), F.lit(", …"))


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<float>")
