"""Chunkers and the occurrence finder as table functions: usable from SQL with a table argument."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.functions import udtf

from ..operators.chunking import _check, boundary_spans


def _kept(table: AnalyzeArgument, text: str) -> list[StructField]:
    """The argument's columns but its text; a table without that column is an error at analysis."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    if text not in table.dataType.names:
        raise ValueError(f"the table has no column {text}")
    return [f for f in table.dataType.fields if f.name != text]


class _BoundaryChunks:
    """All columns but ``text``, then chunk_index, start, chunk, total_chunks; blank chunks keep their number."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _check(size.value, overlap.value)
        kept = _kept(table, "text")
        return AnalyzeResult(StructType([*kept, StructField("chunk_index", IntegerType()), StructField("start", IntegerType()), StructField("chunk", StringType()), StructField("total_chunks", IntegerType())]))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        text = row["text"] or ""
        kept = [row[c] for c in row.__fields__ if c != "text"]
        spans = boundary_spans(text, size, overlap)
        for k, (a, b) in enumerate(spans):
            if chunk := text[a:b].strip():
                yield (*kept, k, a, chunk, len(spans))


class _Occurrences:
    """All columns but ``text``, then the places (from 1) of each occurrence of a needle in any case, and how many there are."""

    @staticmethod
    def analyze(table: AnalyzeArgument, needle: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType([*_kept(table, "text"), StructField("places", ArrayType(IntegerType())), StructField("n", IntegerType())]))

    def eval(self, row: Row, needle: str) -> Iterator[tuple]:
        low, want = (row["text"] or "").lower(), (needle or "").strip().lower()
        places, at = [], low.find(want) if want else -1
        while at >= 0:
            places.append(at + 1)
            at = low.find(want, at + len(want))
        if places:
            yield (*[row[c] for c in row.__fields__ if c != "text"], places, len(places))


def register(spark: SparkSession) -> None:
    """boundary_chunks(TABLE(...), size, overlap) and occurrences(TABLE(...), needle), for SQL of this session."""
    spark.udtf.register("boundary_chunks", udtf(_BoundaryChunks, useArrow=True))
    # its list column does not come through Arrow where a batch has no rows
    spark.udtf.register("occurrences", udtf(_Occurrences, useArrow=False))
