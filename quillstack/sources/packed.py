"""Texts and other artefacts in containers of some ``SIZE`` bytes instead of a file each.

A container is a Parquet file of (storage_key, content, n_bytes, sha256) in order of keys: its footer and page index hold the places of the keys, so a reader asks for a key, a
list or a range of keys and gets the pages that may hold them. The number of containers follows the bytes, not the rows. A write becomes visible as a whole.

Defined cases: a null content is empty; keys that would leave a root are refused, as in ``write_files``; a key written again later holds the newest content (by ``write``'s number); an empty
table makes an empty container.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import safe_path

SIZE, PAGE = 256 << 20, 1 << 18
SCHEMA = "storage_key string, content binary, n_bytes long, sha256 string"


def write(rows: DataFrame, root: str, number: int = 0, size: int = SIZE) -> None:
    """Adds ``rows`` (storage_key, content) below ``root``; a write with the same number replaces an earlier one."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    slim = rows.select("storage_key", content.alias("content"))
    total = slim.agg(F.sum(F.octet_length("content")).alias("n"), F.max(~F.coalesce(safe_path(F.col("storage_key")), F.lit(False))).alias("bad")).first()
    if total.bad:
        raise ValueError("a storage key would leave its root")
    n = max(1, -(-(total.n or 0) // size))
    kept = slim.select("storage_key", "content", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    w = kept.repartitionByRange(n, "storage_key").sortWithinPartitions("storage_key").write.mode("overwrite")
    # checksums are of the content, so a reader may check what it has read; small pages make single keys cheap
    w.option("parquet.page.size", PAGE).option("parquet.block.size", size).parquet(f"{root.rstrip('/')}/write={number}")


def scan(spark: SparkSession, root: str, **more: Column) -> DataFrame:
    """All artefacts; of a key written twice the newest. ``more`` are columns made of an artefact where it is read."""
    rows = spark.read.schema(f"{SCHEMA}, write long").parquet(root.rstrip("/")).withColumns(more)
    if len(_writes(spark, root)) < 2:
        return rows.drop("write")
    # only keys and numbers move to find the newest
    last = rows.groupBy("storage_key").agg(F.max("write").alias("write"))
    return rows.join(last, ["storage_key", "write"], "left_semi").drop("write")


def _writes(spark: SparkSession, root: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [f.getPath().getName() for f in found if f.getPath().getName().startswith("write=")]


def get(spark: SparkSession, root: str, keys: list[str] | DataFrame, **more: Column) -> DataFrame:
    """The artefacts of some keys: a list goes to the scan as a filter, a table (storage_key) is joined. Who needs only a digest of contents names it in ``more`` and selects it, then contents don't move."""
    all_ = scan(spark, root, **more)
    return all_.where(F.col("storage_key").isin(keys)) if isinstance(keys, list) else all_.join(keys.select("storage_key").distinct(), "storage_key", "left_semi")


def between(spark: SparkSession, root: str, low: str, high: str) -> DataFrame:
    """The artefacts of keys from ``low`` on and below ``high``."""
    return scan(spark, root).where((F.col("storage_key") >= low) & (F.col("storage_key") < high))


def sound(content: Column, sha256: Column) -> Column:
    return F.sha2(content, 256) == sha256


def containers(spark: SparkSession, root: str) -> DataFrame:
    """container, first_key, last_key, n_keys, n_bytes of each file."""
    rows = spark.read.schema(f"{SCHEMA}, write long").parquet(root.rstrip("/")).select("storage_key", "n_bytes", F.col("_metadata.file_path").alias("container"))
    return rows.groupBy("container").agg(F.min("storage_key").alias("first_key"), F.max("storage_key").alias("last_key"), F.count("*").alias("n_keys"), F.sum("n_bytes").alias("n_bytes"))
