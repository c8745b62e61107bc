"""Storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.text import safe_extension


def upload_key(owner: Column, upload: Column, filename: Column) -> Column:
    return F.concat(F.lit("uploads/"), owner.cast("string"), F.lit("/"), upload.cast("string"), F.lit("/original"), safe_extension(filename))


def parsed_key(owner: Column, upload: Column, job: Column, name: str) -> Column:
    return F.concat_ws("/", F.lit("parsed"), owner.cast("string"), upload.cast("string"), job.cast("string"), F.lit(name))


def chunk_key(owner: Column, document: Column, job: Column, sequence: Column, kind: str) -> Column:
    name = F.concat(F.lpad(sequence.cast("string"), 6, "0"), F.lit(f"_{kind}.txt"))
    return F.concat_ws("/", F.lit("chunks"), owner.cast("string"), document.cast("string"), job.cast("string"), name)
