"""Chunk generators as table functions for SQL, beside their DataFrame forms in ``operators.intervals``.

After :func:`register`, ``SELECT * FROM fixed_chunks(TABLE(durations), 600)`` and the like work on any table or query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


def _column(table: AnalyzeArgument, name: str) -> None:
    """An error that names the column, if the table lacks it."""
    if not table.isTable or name not in table.dataType.fieldNames():
        raise ValueError(f"the first argument must be a table with a column {name}")


def _whole(x: AnalyzeArgument, name: str) -> None:
    if not isinstance(x.value, int) or x.value < 1:
        raise ValueError(f"{name} must be a positive whole number, known when the query is analyzed")


CHUNK = StructType().add("rec", StringType()).add("k", LongType()).add("start", LongType()).add("end", LongType())


class FixedChunks:
    """Table (rec, dur), chunk: about equal chunks near a wanted length; the last one ends with the recording."""

    @staticmethod
    def analyze(table: AnalyzeArgument, chunk: AnalyzeArgument) -> AnalyzeResult:
        _column(table, "rec"), _column(table, "dur"), _whole(chunk, "chunk")
        return AnalyzeResult(CHUNK)

    def eval(self, row: Row, chunk: int) -> Iterator[tuple]:
        length = min(chunk, row["dur"])
        n = max(1, int(row["dur"] / length + 0.5)) if length else 1
        step = length + int((row["dur"] - length * n) / n)
        for k in range(n):
            yield (row["rec"], k, k * step, row["dur"] if k == n - 1 else (k + 1) * step)


class EqualChunks:
    """Table (rec, dur), n: ``n`` parts of int(dur / n); the last takes the rest."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        _column(table, "rec"), _column(table, "dur"), _whole(n, "n")
        return AnalyzeResult(CHUNK)

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        step = row["dur"] // n
        for k in range(n):
            yield (row["rec"], k, k * step, row["dur"] if k == n - 1 else (k + 1) * step)


class OverlappingChunks:
    """Table (seg, start_cs, end_cs), length, least, overlap: sliding windows; the one after which too little would remain runs to the end."""

    SCHEMA = StructType().add("seg", StringType()).add("chunk", StringType()).add("start_cs", LongType()).add("end_cs", LongType())

    @staticmethod
    def analyze(table: AnalyzeArgument, length: AnalyzeArgument, least: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        for name in ("seg", "start_cs", "end_cs"):
            _column(table, name)
        _whole(length, "length"), _whole(least, "least"), _whole(overlap, "overlap")
        if overlap.value >= length.value:
            raise ValueError("overlap must be less than length")
        return AnalyzeResult(OverlappingChunks.SCHEMA)

    def eval(self, row: Row, length: int, least: int, overlap: int) -> Iterator[tuple]:
        at, k, step = row["start_cs"], 0, length - overlap
        while at + step + least < row["end_cs"]:
            yield (row["seg"], f"{row['seg']}-{k:05d}", at, at + length)
            at, k = at + step, k + 1
        yield (row["seg"], f"{row['seg']}-{k:05d}", at, row["end_cs"])


class MinGap:
    """Table (rec, at), gap: of each recording's points in order, those at least ``gap`` after the last kept one.

    The function itself asks for one partition a recording, sorted by ``at``; only the last kept point is held.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql.types import DoubleType
        from pyspark.sql.udtf import OrderingColumn

        _column(table, "rec"), _column(table, "at")
        schema = StructType().add("rec", StringType()).add("at", DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("rec")], orderBy=[OrderingColumn("at")])

    def __init__(self):
        self.last = None

    def eval(self, row: Row, gap: float) -> Iterator[tuple]:
        if row["at"] is not None and (self.last is None or row["at"] - self.last >= gap):
            self.last = row["at"]
            yield (row["rec"], row["at"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: fixed_chunks, equal_chunks, overlapping_chunks, min_gap."""
    for name, maker in (("fixed_chunks", FixedChunks), ("equal_chunks", EqualChunks), ("overlapping_chunks", OverlappingChunks), ("min_gap", MinGap)):
        spark.udtf.register(name, udtf(maker))
