"""Documents of a folder of any mixture of files: each is parsed by its kind, and what cannot be parsed says why."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

PARSED = "path string, kind string, content string, title string, author string, created_at timestamp, extra string, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("title", pa.string()), ("author", pa.string()), ("created_at", pa.timestamp("us", "UTC")), ("extra", pa.string()), ("error", pa.string())])
KINDS = ("eml", "pdf", "html", "docx", "text")


def of_content_type(content_type: Column) -> Column:
    """The kind that a MIME type names; null for others."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.contains("message/rfc822") | t.startswith("email/"), "eml").when(t.contains("pdf"), "pdf").when(t.startswith("text/html"), "html").when(t.startswith("text/"), "text").when(t.contains("wordprocessingml"), "docx")


def decoded(data: bytes) -> str:
    """UTF-8, else Latin-1, which reads any bytes."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _parse(kind: str, path: str, data: bytes) -> tuple[str, str, str | None, object, dict]:
    """(content, title, author, created_at, extra) of a file."""
    name = path.rsplit("/", 1)[-1]
    if kind == "eml":
        subject, sender, to, sent, body, names = files.parse_email(data)
        return body, subject or name, sender.strip() or None, sent, {"subject": subject, "from_addr": sender, "to_addr": ", ".join(to), "attachments": ", ".join(names)}
    if kind == "docx":
        if not zipfile.is_zipfile(io.BytesIO(data)):
            raise ValueError("not a DOCX file")
        title, _, _, _, text = files.parse_docx(data, name.rsplit(".", 1)[0])
        return text, title, None, None, {"filename": name}
    if kind == "html":
        return files.html_pieces(decoded(data)), name, None, None, {"filename": name}
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return decoded(data), name, None, None, {"filename": name, "parser_unavailable": "pypdf"}
        pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
        return "\n\n".join(p for p in pages if p), name, None, None, {"filename": name, "pages": str(len(pages))}
    return decoded(data), name, None, None, {"filename": name}


def parsed(binary: DataFrame, content_type: Column | None = None) -> DataFrame:
    """path, kind, content, title, author, created_at, extra (JSON), error of files given as path and content (bytes).

    The kind follows from the content type where one is given, else from the path's ending, else from the first bytes. A
    file that cannot be parsed has an error and no content: it never fails the others. A null content counts as empty.
    """
    body = F.coalesce("content", F.lit(b""))
    kind = files.kind(F.col("path"), body)
    kind = kind if content_type is None else F.coalesce(of_content_type(content_type), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for path, k, data in zip(*(c.slice(at, 64).to_pylist() for c in b.columns), strict=True):
                    try:
                        text, title, author, sent, extra = _parse(k, path or "", data)
                        out.append((path, k, text.encode("utf-8", "replace").decode(), title, author, sent, json.dumps({x: y for x, y in extra.items() if y}), None))
                    except Exception as fault:  # whatever a broken file does to its parser
                        out.append((path, k, None, None, None, None, None, f"{type(fault).__name__}: {fault}"[:500]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return binary.select("path", kind.alias("kind"), body.alias("content")).mapInArrow(run, PARSED)


def documents(rows: DataFrame) -> DataFrame:
    """Documents with metadata of what ``parsed`` could read: ids follow from source and content."""
    email = F.col("kind") == "eml"
    kind = F.when(email, "email").otherwise("file")
    return rows.filter("error is null").select(
        F.sha2(F.concat_ws("\n", kind, "path", "content"), 256).alias("document_id"), "content", kind.alias("source_type"), F.col("path").alias("source_id"), "title", "author", "created_at",
        F.when(email, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.from_json("extra", "map<string,string>").alias("extra_fields"),
    )


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``parsed`` rows of all files below ``path``, whatever store it is in; ``glob`` reaches the listing of files.

    Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return parsed((reader.option("pathGlobFilter", glob) if glob else reader).load(path))
