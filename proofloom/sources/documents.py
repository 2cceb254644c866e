"""Documents with metadata, from texts and e-mails; the key of an index over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values
SOURCE_TYPES = ("file", "email", "api", "manual")
# --- end of fixed values


def _document(content: Column, kind: str, source: Column, title: Column, author: Column, created: Column, tags: Column, extra: Column) -> list[Column]:
    return [
        F.sha2(F.concat_ws("\n", F.lit(kind), source, content), 256).alias("document_id"), content.alias("content"), F.lit(kind).alias("source_type"), source.alias("source_id"), title.alias("title"),
        author.alias("author"), created.cast("timestamp").alias("created_at"), tags.alias("tags"), extra.alias("extra_fields"),
    ]


def from_texts(texts: DataFrame, path: str = "path", text: str = "text", kind: str = "file") -> DataFrame:
    """One document a text; ids follow from source and content, so the same file gives the same id."""
    none = F.lit(None)
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return texts.select(*_document(F.col(text), kind, F.col(path), name, none.cast("string"), none, F.array().cast("array<string>"), F.create_map(F.lit("filename"), name)))


def from_emails(mails: DataFrame) -> DataFrame:
    """One document a message: the sender is its author; subject, addresses and attachments are extra fields too."""
    joined = lambda c: F.array_join(c, ", ")
    extra = F.create_map(F.lit("subject"), F.col("subject"), F.lit("from_addr"), F.col("from_addr"), F.lit("to_addr"), joined("to_addr"), F.lit("attachments"), joined("attachments"))
    author = F.nullif(F.trim("from_addr"), F.lit(""))
    return mails.select(*_document(F.col("body"), "email", F.col("path"), F.col("subject"), author, F.col("sent"), F.array(F.lit("email")), extra))


def index_key(docs: DataFrame, *parameters: object) -> str:
    """A text that changes with any document's content and with the parameters of an index."""
    row = docs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(document_id, content))").alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(7), "document_id", "content"), F.lit(1 << 40))).alias("s")).first()
    return f"{row['n']}-{(row['x'] or 0) & (2**64 - 1):016x}-{row['s'] or 0}-" + "-".join(map(str, parameters))
