"""Log counts by window and level, and an archive of records as JSON lines, from streams.

Counts are updated until the watermark passes a window, which then leaves the state; records that come later still are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "id long, ts timestamp, level string, module string, message string, bytes long"


def read(spark: SparkSession, folder: str, fmt: str = "json", schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def counts(records: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "level")
    return w.agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "level", "n_records", "bytes")


def drain(stream: DataFrame, name: str, keys: list[str], trigger: dict[str, object] | None = None) -> DataFrame:
    """Runs a stream of updates over what is there; the newest row of each key.

    Each micro-batch writes its updates to a folder of its own in the shared folder, again if it is run again, so nothing comes to the driver."""
    from quillstack.sources.files import shared_folder

    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return newest.select(*keys, "__r.*").select(*stream.columns)


def archive(stream: DataFrame, path: str, checkpoint: str, partition: str = "day") -> None:
    """Appends records (with ``ts``) as JSON lines below ``path``, a folder for each day; each record once, also after a restart."""
    rows = stream.withColumn(partition, F.date_format("ts", "yyyy-MM-dd"))
    query = rows.writeStream.format("json").partitionBy(partition).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
