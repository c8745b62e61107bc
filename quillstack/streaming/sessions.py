"""Event-time sessions by gap from a stream, with a watermark, and the rows that came too late for theirs.

A session is a key's rows of which each lies within ``gap`` of another before it. The watermark is the newest time of earlier batches less ``late``. Each micro-batch joins
its rows to the open sessions, writes those that end before the new watermark and keeps the others; a row whose own ``gap`` has ended before the watermark could only
belong to a closed session and goes to the side table. What a batch writes (closed, open, late, watermark) lies in folders with its number, is made of the batch before it
and of its own rows alone, and is written again if it is run again, so a restart loses and doubles nothing. Of open sessions the last two batches' are kept.

Defined cases: a null key is a key; rows with a null time go to the side table; rows at one instant are one session's, and so are rows just ``gap`` apart, as with ``session_window``; a row later than
``late`` allows that still isn't aside begins a session of its own; no rows give empty tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SUMS = ("n", "value")


def batch_sessions(rows: DataFrame, gap: str) -> DataFrame:
    """key, start, end, n, value of ``rows`` (key, ts, value), all at once."""
    w = rows.where("ts IS NOT NULL").groupBy("key", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *_SUMS)


def merged(sessions: DataFrame) -> DataFrame:
    """Sessions that overlap become one; a key's task holds its open sessions and the batch's rows."""
    before = Window.partitionBy("key").orderBy("start", "end")
    new = F.coalesce((F.col("start") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    named = sessions.withColumn("__new", new).withColumn("__s", F.sum("__new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("key", "__s").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in _SUMS]).drop("__s")


class Sessions:
    """The tables below ``path`` of one stream of sessions."""

    def __init__(self, spark: SparkSession, path: str, gap: str, late: str):
        self.spark, self.path, self.gap, self.late = spark, path.rstrip("/"), F.expr(f"INTERVAL {gap}"), F.expr(f"INTERVAL {late}")

    def _read(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}" + ("" if batch is None else f"/batch={batch}"))
        except AnalysisException:  # nothing has been written there
            return self.spark.createDataFrame([], schema)

    def _schema(self, key: str) -> str:
        return f"key {key}, start timestamp, end timestamp, n long, value double"

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of ``rows`` (key, ts, value)."""
        key = dict(rows.dtypes)["key"]
        rows = rows.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).persist()
        past = self._read("watermark", "seen timestamp", batch - 1).agg(F.max("seen")).first()[0]  # one row
        seen = F.lit(past).cast("timestamp")
        out_of_time = F.col("ts").isNull() | F.coalesce(F.col("ts") + self.gap < seen - self.late, F.lit(False))  # before the first batch nothing is
        rows.where(out_of_time).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        alone = rows.where(~out_of_time).select("key", F.col("ts").alias("start"), (F.col("ts") + self.gap).alias("end"), F.lit(1).cast("long").alias("n"), "value")
        every = merged(self._read("open", self._schema(key), batch - 1).unionByName(alone)).persist()
        newest = rows.agg(F.greatest(F.max("ts"), seen).alias("seen"))
        now = newest.first().seen
        ended = F.col("end") < F.lit(now).cast("timestamp") - self.late if now else F.lit(False)
        every.where(ended).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch}")
        every.where(~ended).write.mode("overwrite").parquet(f"{self.path}/open/batch={batch}")
        newest.write.mode("overwrite").parquet(f"{self.path}/watermark/batch={batch}")
        every.unpersist()
        rows.unpersist()
        for name in ("open", "watermark"):
            self._forget(name, batch - 2)

    def _forget(self, name: str, batch: int) -> None:
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def run(self, stream: DataFrame, trigger: dict[str, object] | None = None) -> None:
        """Takes what ``stream`` (key, ts, value) has, from where an earlier run of it stopped."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/progress").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()

    def closed(self, key: str = "long") -> DataFrame:
        return self._read("closed", self._schema(key)).select("key", "start", "end", *_SUMS)

    def all(self, key: str = "long") -> DataFrame:
        """Closed sessions and those still open."""
        newest = self._read("watermark", "seen timestamp, batch long").agg(F.max("batch")).first()[0]  # written last, so of a whole batch
        now = self._read("open", f"{self._schema(key)}, batch long").where(F.col("batch") == F.lit(newest))
        return self.closed(key).unionByName(now.select("key", "start", "end", *_SUMS))

    def late_rows(self, key: str = "long") -> DataFrame:
        return self._read("late", f"key {key}, ts timestamp, value double, batch long")

