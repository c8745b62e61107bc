"""Parameters of operators for each job, as columns: defaults, overrides given as texts, and the typed values that a job keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH = {"k": ("int", 5), "max_distance": ("double", 0.5), "max_best": ("double", 0.4)}
CHUNK = {"max_tokens": ("int", 512), "inline_bytes": ("int", 2048)}
EMBED = {"per_call": ("int", 100), "repeats": ("int", 3), "seconds": ("double", 60.0)}
FILES = {"max_bytes": ("int", 50 << 20), "max_pages": ("int", 100)}

Parameters = dict[str, tuple[str, object]]
_FORM = {"int": r"^\s*[+-]?[0-9]{1,9}\s*$", "double": r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"}


def typed(value: Column, kind: str) -> Column:
    """A text as a number; null if it isn't one of that kind."""
    return F.when(value.rlike(_FORM[kind]), F.trim(value).cast(kind))


def snapshots(overrides: DataFrame, parameters: Parameters) -> DataFrame:
    """job_id, a column for each parameter, and ``rejected``: the parameters whose newest override isn't of their type, for which the default holds.

    ``overrides`` has job_id, name, value, at and id (which decides ties); names that aren't parameters have no effect, and so nothing else, as a key, is kept."""
    newest = {n: F.max(F.when(F.col("name") == n, F.struct("at", "id", "value")))["value"] for n in parameters}
    given = overrides.groupBy("job_id").agg(*[c.alias(f"__{n}") for n, c in newest.items()])
    values = {n: typed(F.col(f"__{n}"), kind) for n, (kind, _) in parameters.items()}
    rejected = F.array_compact(F.array(*[F.when(F.col(f"__{n}").isNotNull() & v.isNull(), n) for n, v in values.items()]))
    return given.select("job_id", *[F.coalesce(v, F.lit(parameters[n][1])).alias(n) for n, v in values.items()], F.array_join(rejected, ",").alias("rejected"))
