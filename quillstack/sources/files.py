"""Binary and text files, archives of chunk texts, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import safe_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in ``spark.checkpoint.dir`` or given to ``setCheckpointDir``; a temporary one only where neither is set and
    all runs in this process."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    top = top or f"file://{tempfile.gettempdir()}/quillstack"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def binary(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """path, byte_size, checksum_sha256, content; larger files have no content or checksum and are marked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_bytes
    return files.select("path", F.col("length").alias("byte_size"), F.when(fits, F.sha2("content", 256)).alias("checksum_sha256"), F.when(fits, F.col("content")).alias("content"), (~fits).alias("too_large"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """storage_key (the path below ``root``) and content of text files."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    key = F.substring_index(F.col("_metadata.file_path"), f"{root.rstrip('/').rpartition('/')[2]}/", -1)
    return whole.select(key.alias("storage_key"), F.col("value").alias("content"))


def keyed(keys: DataFrame, key: Column) -> DataFrame:
    """Whether each key may be used as a path."""
    return keys.withColumn("is_safe", safe_path(key))
