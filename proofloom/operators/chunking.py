"""Chunks of documents: fixed spans in closed form, boundary spans in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, chunk_index, start, chunk (trimmed), total_chunks, columns ``keep``; blank spans are left out but keep their number."""
    _check(size, overlap)
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    spans = docs.filter(F.coalesce(n, F.lit(0)) > 0).select(doc, text, *keep, (last + 1).alias("total_chunks"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    out = spans.withColumn("start", F.col("chunk_index") * step)
    span = F.substring(F.col(text), F.col("start") + 1, F.lit(size))
    return out.filter(span.rlike(r"\S")).select(doc, "chunk_index", "start", stripped(span).alias("chunk"), "total_chunks", *keep)


def _ends(text: str, start: int, stop: int, size: int, paragraphs: bool) -> int:
    """Where a span that cannot reach the end of the text stops: a paragraph, else a sentence, else a word, else as is."""
    low = start + max(1, size * 6 // 10)
    low = start if low >= stop else low
    if paragraphs and (at := text.rfind("\n\n", low, stop)) > start:
        return at
    for at in range(stop - 1, low, -1):  # the last white space after a full stop; what follows it in the window belongs to it
        if text[at].isspace() and text[at - 1] in ".!?":
            while at + 1 < stop and text[at + 1].isspace():
                at += 1
            return at + 1
    at = text.rfind(" ", low, stop)
    return at if at > start else stop


def boundary_spans(text: str, size: int = 500, overlap: int = 50, paragraphs: bool = True) -> list[tuple[int, int]]:
    """Spans that end at boundaries in their last two fifths; each begins ``overlap`` before the end of the one before."""
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        end = stop if stop == len(text) else _ends(text, start, stop, size, paragraphs)
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def boundary_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, paragraphs: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk_index, start, chunk, total_chunks with spans that end at boundaries. A span depends on the one before."""
    _check(size, overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, t in f.itertuples(index=False):
                spans = boundary_spans(t or "", size, overlap, paragraphs)
                rows += [(key, k, a, c, len(spans)) for k, (a, b) in enumerate(spans) if (c := t[a:b].strip())]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "chunk", "total_chunks"])

    return docs.select(doc, text).mapInPandas(run, "doc_id long, chunk_index int, start int, chunk string, total_chunks int")


def with_metadata(chunks: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunk ids, positions and the columns of their documents."""
    return chunks.join(docs.drop("text"), doc).withColumns({"chunk_id": F.format_string("%s:%d", F.col(doc), F.col("chunk_index")), "position": F.format_string("%d of %d", F.col("chunk_index") + 1, F.col("total_chunks")), "chunk_chars": F.length("chunk")})
