"""A data source for archived logs: ``spark.read.format("quillstack_logs")`` and ``readStream`` over a folder of JSON lines, a folder for each day.

Each file is a partition. Conditions on ``day`` (equal, in, from, until) are taken by the source: files of other days aren't opened; the others stay with Spark. A stream's offset is the number of files in
order of their names that it has read, so it takes each once, also after a restart; names must rise with time, as those of the archive's days do. Options: ``path``, a URI or a local path.

Defined cases: lines that aren't JSON objects are rows of nulls but for day; missing fields are null; empty files give nothing; a folder without files is an empty table.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan
from pyspark.sql.types import StructType

SCHEMA = "id long, ts string, level string, module string, message string, bytes long, day string"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")][:-1]


@dataclass
class LogFile(InputPartition):
    path: str
    day: str


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def files(path: str) -> list[LogFile]:
    fs, root = _folder(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    kept = sorted(f.path for f in found if f.is_file and "/day=" in f.path and not f.base_name.startswith(("_", ".")))
    return [LogFile(p, p.split("/day=", 1)[1].split("/", 1)[0]) for p in kept]


def rows(path: str, part: LogFile) -> Iterator[tuple]:
    fs, _ = _folder(path)
    with fs.open_input_stream(part.path) as stream:
        for line in stream.read().decode("utf-8", "replace").splitlines():
            try:
                row = json.loads(line)
            except ValueError:
                row = None
            row = row if isinstance(row, dict) else {}
            yield (*[row.get(f) for f in _FIELDS], part.day)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThan)) and f.attribute == ("day",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, day: str) -> bool:
        kinds = {EqualTo: lambda v: day == v, In: lambda v: day in v, GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v}
        return all(kinds[type(f)](f.value) for f in self.tests)

    def partitions(self) -> Sequence[LogFile]:
        return [f for f in files(self.path) if self._wanted(f.day)] or [LogFile("", "")]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return rows(self.path, partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(files(self.path))}

    def partitions(self, start: dict, end: dict) -> Sequence[LogFile]:
        return files(self.path)[start["files"] : end["files"]]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return rows(self.path, partition)


class LogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstack_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its conditions pushed down."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning runs in a worker of the driver without the application's archives
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogFiles)

