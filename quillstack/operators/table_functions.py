"""Table functions for SQL: ``sections`` over a partitioned table, ``windows`` for LATERAL.

``register`` makes both known to a session. ``sections(TABLE(segments) PARTITION BY parsed_document_id ORDER BY sequence_index, max_tokens => n)`` gives the rows of ``structure.section_chunks``: it sees a document's
segments one after the other, holds the section it is in, and gives its windows when it ends. ``windows(text, size)`` gives the word windows of one text.

Defined cases: a null text has no lines and no words; a document without text lines gives nothing; a missing column, a size below 1 or one that isn't constant is an error of the query, not of a task.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NEEDED = ("parsed_document_id", "sequence_index", "page_no", "text")
_INT, _TEXT = IntegerType(), StringType()
CHUNK = StructType().add("sequence_index", _INT).add("text", _TEXT).add("contextualized_text", _TEXT).add("token_count", _INT).add("heading_path", ArrayType(_TEXT)).add("page_numbers", ArrayType(_INT)).add("source_segment_indices", ArrayType(_INT))
WINDOW = StructType().add("place", _INT).add("words", _INT).add("text", _TEXT)
HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*\Z")


def _size(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not argument.isConstantExpression or argument.value is None or int(argument.value) < 1:
        raise ValueError(f"{name} must be a constant of 1 or more")


class Sections:
    """One document's segments, a row each."""

    @staticmethod
    def analyze(segments: AnalyzeArgument, max_tokens: AnalyzeArgument) -> AnalyzeResult:
        if not segments.isTable:
            raise ValueError("sections takes a table of segments")
        lacking = sorted(set(NEEDED) - set(segments.dataType.names))
        if lacking:
            raise ValueError(f"segments lack the columns {lacking}")
        _size(max_tokens, "max_tokens")
        # the document's id keeps the type that it has in the table
        schema = StructType([segments.dataType["parsed_document_id"], *CHUNK.fields])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("parsed_document_id")], orderBy=[OrderingColumn("sequence_index")])

    def __init__(self) -> None:
        self.path: list[str] = [""] * 6
        self.words: list[tuple[str, int | None, int]] = []
        self.shown: list[str] | None = None
        self.n, self.id, self.most = 0, None, 1

    def eval(self, row, max_tokens: int) -> Iterator[tuple]:
        self.id, self.most = row["parsed_document_id"], max_tokens
        for line in (row["text"] or "").split("\n"):
            if found := HEADING.match(line):
                level = len(found[1])
                self.path[level - 1 :] = [found[2], *[""] * (6 - level)]
                continue
            mine = line.split()
            here = [x for x in self.path if x]
            if mine and here != self.shown:
                yield from self._flush()
                self.shown = here
            self.words += [(w, row["page_no"], row["sequence_index"]) for w in mine]

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        for at in range(0, len(self.words), self.most):
            part = self.words[at : at + self.most]
            text, pages = " ".join(w for w, _, _ in part), sorted({p for _, p, _ in part if p is not None})
            above = "\n".join(self.shown or [])
            yield self.id, self.n, text, f"{above}\n{text}", len(part), self.shown or [], pages or None, sorted({s for _, _, s in part})
            self.n += 1
        self.words = []


class Windows:
    """Windows of ``size`` words of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _size(size, "size")
        return AnalyzeResult(WINDOW)

    def eval(self, text: str | None, size: int) -> Iterator[tuple[int, int, str]]:
        found = (text or "").split()
        for place, at in enumerate(range(0, len(found), size)):
            part = found[at : at + size]
            yield place, len(part), " ".join(part)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's analyser has no archives of the application
    spark.udtf.register("sections", udtf(Sections))
    spark.udtf.register("windows", udtf(Windows))
