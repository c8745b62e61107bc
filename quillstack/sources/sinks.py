"""Writers. A write is committed as a whole or not at all, so nothing has to be undone."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions import keys
from quillstack.sources.files import shared_folder


def append(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: made once, and safe from lost executors."""
    path = shared_folder(rows.sparkSession, name)
    replace(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def artifacts(parsed: DataFrame) -> DataFrame:
    """The three artefacts of a parse as (storage_key, content): Markdown, text, JSON."""
    owner, upload, job = F.col("owner_user_id"), F.col("uploaded_file_id"), F.col("parse_job_id")
    each = [("content.md", "markdown"), ("content.txt", "text"), ("document.json", "doc_json")]
    return parsed.select(F.explode(F.array(*[F.struct(keys.parsed_key(owner, upload, job, n).alias("storage_key"), F.col(c).alias("content")) for n, c in each])).alias("a")).select("a.*")


def documents_and_segments(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document rows and segment rows, tied by an id that follows from upload and job."""
    d = parsed.withColumn("document_id", F.sha2(F.concat_ws("|", F.col("uploaded_file_id").cast("string"), F.col("parse_job_id").cast("string")), 256))
    segments = d.select(F.col("document_id").alias("parsed_document_id"), F.explode("segments").alias("s")).select("parsed_document_id", "s.*")
    return d.drop("segments"), segments


def offloaded(stored: DataFrame, whole: DataFrame) -> DataFrame:
    """(storage_key, content) of texts that threshold storage moved out; ``whole`` has id and the full texts."""
    both = stored.select("id", "text_storage_key", "contextualized_text_storage_key").join(whole.select("id", "text", "contextualized_text"), "id")
    return offloaded_rows(both, "text", "contextualized_text")


def offloaded_rows(rows: DataFrame, text: str, context: str) -> DataFrame:
    """As ``offloaded``, of rows that have the keys and the whole texts in the columns named: nothing is joined."""
    pair = lambda key, whole: F.struct(F.col(key).alias("storage_key"), F.col(whole).alias("content"))
    each = rows.select(F.explode(F.array(pair("text_storage_key", text), pair("contextualized_text_storage_key", context))).alias("f")).select("f.*")
    return each.where(F.col("storage_key").isNotNull())


def write_files(rows: DataFrame, root: str) -> None:
    """Writes ``rows`` (storage_key, content) as one file each below ``root``, a URI; keys that would leave it are refused.

    Tasks write under names of their own and rename, so a retried task or a second attempt leaves whole files only."""
    from quillstack.functions.text import safe_path

    bad = rows.where(~safe_path(F.col("storage_key"))).limit(1).count()
    if bad:
        raise ValueError("a storage key would leave its root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{top}/{key}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
                fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.select("storage_key", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
