"""Tables written to the shared folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``; a temporary one only where neither is set and
    all runs in this process (local tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quillstack-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For Python workers: the file system of a folder named by a URI or an absolute path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def _top(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillstack/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_top(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all that this application has written here; to be called once results are stored elsewhere."""
    delete(spark, _top(spark))


def delete(spark: SparkSession, name: str) -> None:
    """Deletes a folder that ``new_path`` named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back: evaluated once, with known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While tables are written in it, Arrow batches of ``rows`` rows at most: whole texts need little memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written``."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns whose names an operator is about to produce (compared without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def by_name(*names: str) -> list[Column]:
    """Columns by their whole names, whatever signs these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(*names: str) -> tuple[list[Column], list[Column]]:
    """Columns under plain names, for functions over Arrow batches, which take no others, and the expressions that give their own names back."""
    return [c.alias(f"__k{i}") for i, c in enumerate(by_name(*names))], [F.col(f"__k{i}").alias(n) for i, n in enumerate(names)]


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """``docs`` with all columns but ``needed`` put into one, ``__rest``, out of reach of any name that an operator produces, and
    the expressions that give the columns of ``docs`` back, in order."""
    used = {n.lower() for n in needed}
    rest = [c for c in docs.columns if c.lower() not in used]
    slim = docs.select(*needed, *([F.struct(*by_name(*rest)).alias("__rest")] if rest else []))
    back = [F.col(c) if c.lower() in used else F.col("__rest").getField(c).alias(c) for c in docs.columns]
    return slim, back
