"""E-mail, HTML, DOCX and PDF files, parsed on executors with the standard library."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.retrieval import slices

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Pieces(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.pieces.append(data.strip())


def html_pieces(source: str) -> str:
    """All text of a page, scripts and styles too, pieces one space apart."""
    parser = _Pieces()
    parser.feed(source or "")
    parser.close()
    return " ".join(parser.pieces)


def parse_email(data: bytes) -> tuple:
    """subject, from, to, time in UTC, body, attachment names. Plain text comes before HTML."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    plain, rich, names = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if name := part.get_filename():
            names.append(name)
        elif part.get_content_type() in ("text/plain", "text/html"):
            payload = part.get_payload(decode=True) or b""
            try:
                text = payload.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = payload.decode("utf-8", "replace")
            (plain if part.get_content_type() == "text/plain" else rich).append(text.strip())
    try:
        sent = parsedate_to_datetime(str(m["Date"])) if m["Date"] else None
        sent = sent and (sent.replace(tzinfo=UTC) if sent.tzinfo is None else sent.astimezone(UTC)).replace(tzinfo=None)
    except (TypeError, ValueError):
        sent = None
    to = [x.strip() for x in str(m["To"] or "").split(",") if x.strip()]
    return str(m["Subject"] or ""), str(m["From"] or ""), to, sent, "\n\n".join(plain) if plain else "\n\n".join(html_pieces(r) for r in rich), names


def parse_docx(data: bytes, stem: str) -> tuple:
    """title, headings, table rows, paragraphs, full text; what cannot be read is empty."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return stem, [], [], [], ""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    body = root.find(f"{_W}body")
    headings, paragraphs, rows = [], [], []
    for p in body.findall(f"{_W}p") if body is not None else []:
        if t := text(p):
            paragraphs.append(t)
            style = p.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if m := re.match(r"(?i)heading\s*(\d+)", name):
                headings.append({"level": int(m[1]), "text": t})
    for row in root.iter(f"{_W}tr"):
        rows.append([text(c) for c in row.findall(f"{_W}tc")])
    lines = [*paragraphs, *(" | ".join(r) for r in rows)]
    return (headings[0]["text"] if headings else stem), headings, rows, paragraphs, "\n".join(lines)


def _files(spark: SparkSession, path: str, parse, schema: str, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *parse(bytes(c), p)) for p, c in zip(f["path"], f["content"], strict=True)], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def emails(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, lambda c, _: parse_email(c), schemas.EMAIL, ["path", "subject", "from_addr", "to_addr", "sent", "body", "attachments"])


def docx(spark: SparkSession, path: str) -> DataFrame:
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return _files(spark, path, lambda c, p: parse_docx(c, stem(p)), schemas.DOCX, ["path", "title", "headings", "tables", "paragraphs", "full_text"])


def html_texts(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """key and all text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):  # a batch holds ten thousand pages of any length
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(html_pieces, part.column(1).to_pylist()), pa.string())], [key, "text"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(source).cast("string").alias(source)).mapInArrow(run, f"{key} long, text string")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page_no, text, parser; without a PDF library one row a file with its bytes as Latin-1 text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None  # noqa: N806
        for f in frames:
            out = []
            for p, c in zip(f["path"], f["content"], strict=True):
                if PdfReader is None:
                    out.append((p, 1, bytes(c).decode("latin-1"), "parser_unavailable"))
                else:
                    out += [(p, k, page.extract_text() or "", "pypdf") for k, page in enumerate(PdfReader(io.BytesIO(bytes(c))).pages, 1)]
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "parser"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_no int, text string, parser string")


def kind(path: Column, content: Column) -> Column:
    """eml, pdf, html, docx or text: by the path's ending, else by the first bytes or by header names of messages."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.decode(content, "ISO-8859-1")
    return (
        F.when(ending == "eml", "eml").when(ending == "pdf", "pdf").when(ending.isin("html", "htm"), "html").when(ending == "docx", "docx").when(ending.isin("txt", "md", "csv"), "text")
        .when(head.startswith("%PDF"), "pdf").when(head.contains("Subject:") | head.contains("From:"), "eml").otherwise("text")
    )
