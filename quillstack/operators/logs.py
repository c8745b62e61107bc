"""Log records: level gate, ring, flush batches, retention by size, and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANK = {"debug": 10, "info": 20, "warn": 30, "error": 40}
SHORT = {"debug": "DBG", "info": "INF", "warn": "WRN", "error": "ERR"}


def _of(values: dict, column: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def at_least(records: DataFrame, level: str) -> DataFrame:
    return records.where(_of(RANK, F.col("level")) >= RANK[level])


def ring(records: DataFrame, n: int, level: str = "info") -> DataFrame:
    """The last n admitted records, oldest first."""
    return at_least(records, level).orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")


def _before(rows: DataFrame, ts: str, value: Column, newest_first: bool) -> DataFrame:
    """(__second, __ahead): the sum of ``value`` over all seconds before each second (or after it). Hours are summed first, so one task
    orders hours and others the seconds of an hour; no task holds rows."""
    second, hour = F.date_trunc("second", F.col(ts)), F.date_trunc("hour", F.col("__second"))
    sums = rows.groupBy(second.alias("__second")).agg(value.alias("__sum")).withColumn("__hour", hour)
    order = F.desc if newest_first else F.asc
    ahead = lambda w: F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = sums.groupBy("__hour").agg(F.sum("__sum").alias("__sum")).select("__hour", ahead(Window.orderBy(order("__hour"))).alias("__start"))
    inside = sums.select("__hour", "__second", ahead(Window.partitionBy("__hour").orderBy(order("__second"))).alias("__inside"))
    return inside.join(hours, "__hour").select("__second", (F.col("__start") + F.col("__inside")).alias("__ahead"))


def numbered(records: DataFrame, name: str = "number") -> DataFrame:
    """Places from 0 in order of (ts, id), without one task that holds all rows, or an hour's: rows are numbered within their second."""
    ahead = _before(records, "ts", F.count("*"), False)
    inside = F.row_number().over(Window.partitionBy("__second").orderBy("ts", "id")) - 1
    out = records.withColumn("__second", F.date_trunc("second", F.col("ts"))).join(ahead, "__second")
    return out.withColumn(name, F.col("__ahead") + inside).drop("__second", "__ahead")


def flush_batches(records: DataFrame, size: int = 100, level: str = "info") -> DataFrame:
    """Batches of admitted records in the order in which the ring hands them to disk: number, rows, bytes, first time."""
    n = numbered(at_least(records, level))
    return n.groupBy(F.floor(F.col("number") / size).alias("batch")).agg(
        F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"), F.min("ts").alias("created_at"), F.min("id").alias("first_id"))


def retained(batches: DataFrame, max_bytes: int) -> DataFrame:
    """Newest batches whose running size from the newest back stays within ``max_bytes``; once over, all older ones go."""
    ahead = _before(batches, "created_at", F.sum("bytes"), True)
    inside = Window.partitionBy("__second").orderBy(F.desc("created_at"), F.desc("batch")).rowsBetween(Window.unboundedPreceding, 0)
    out = batches.withColumn("__second", F.date_trunc("second", F.col("created_at"))).join(ahead, "__second")
    out = out.withColumn("suffix_bytes", F.col("__ahead") + F.sum("bytes").over(inside))
    return out.where(F.col("suffix_bytes") <= max_bytes).drop("__second", "__ahead")


def formatted(records: DataFrame) -> DataFrame:
    """``time LEVEL [trace] module — message``."""
    level = F.coalesce(_of(SHORT, F.col("level")), F.upper("level"))
    line = F.concat(F.date_format("ts", "HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" ["), F.substring("trace_id", 1, 6), F.lit("] "), F.col("module"), F.lit(" — "), F.col("message"))
    return records.withColumn("line", line)


def pairs_text(extra: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
